from rivulet.llm.common import told_apart


def test_contents_that_share_one_key_get_ids_of_their_own(spark):
    rows = [(1, 7, 1), (2, 7, 1), (3, 7, 2), (4, 8, 1), (5, 9, 2)]
    found = {r.doc_id: r.id for r in told_apart(spark.createDataFrame(rows, "doc_id long, c long, c2 long")).collect()}
    assert found[4] == 8 and found[5] == 9
    assert found[1] == found[2] != found[3] and 7 not in (found[1], found[3])
