import random

import corpus_pipeline
import public_tokenizers

from rivulet.llm import bpe


def test_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(7)
    words = {"aa": ["foo", "bar", "ofo", "raba", "borf", "fab"], "bb": ["zig", "zug", "gizu", "ugzi", "izzi", "gug"]}
    sentence = lambda lang, n: " ".join(rng.choice(words[lang]) + str(rng.randint(0, 99)) for _ in range(n))
    docs = [(i, sentence(lang, 40), lang, "s", 0) for i in range(40) for lang in [rng.choice(["aa", "bb"])]]
    old = next(d[1] for d in docs if d[2] == "aa")
    long = sentence("aa", 120).split(" ")
    near = long[:60] + ["changed"] + long[61:]
    item = sentence("bb", 14)
    docs += [(100, " ".join(long), "aa", "s", 0), (101, " ".join(near), "aa", "s", 0), (102, sentence("bb", 20) + " " + item + " " + sentence("bb", 20), "bb", "s", 0)]
    docs += [(103, None, "aa", "s", 0), (104, "123 !!", "aa", "s", 0), (105, "new " + sentence("aa", 30) + "\n" + old, "aa", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    frame, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        frame = spark.read.parquet(f"{tmp_path}/out{k}")
        kept[name] = {r.doc_id: r for r in frame.collect()}
        if k < 4:
            assert frame.columns == corpus_pipeline.COLUMNS
    every = {d[0] for d in docs}
    assert set(kept["language_id"]) == every - {103, 104}
    assert all(kept["language_id"][d[0]].lang == d[2] for d in docs[:40])
    assert set(kept["line_dedup"]) == set(kept["language_id"]) - {101}  # its one line matches that of 100
    assert "\n" not in kept["line_dedup"][105].text and kept["line_dedup"][105].n_chars == len(kept["line_dedup"][105].text)
    assert set(kept["decontamination"]) == set(kept["near_dedup"]) - {102}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        coder = bpe.codec(f.read(), public_tokenizers.PATTERN)
    assert all(r.n_tokens == len(coder.encode(kept["decontamination"][i].text)) for i, r in kept["tokenization"].items())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["tokenization"])


def test_near_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 999)}" for _ in range(80)]
    docs = [(None, "alone " + " ".join(base[::-1]), "x", "s", 1), (1, " ".join(base), "x", "s", 1), (2, " ".join(base), "x", "s", 1), (3, " ".join(base[:40] + ["y"] + base[41:]), "x", "s", 1), (4, "", "x", "s", 0), (5, "", "x", "s", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == [0, 1, 4, 5]


def test_near_dedup_catches_copies_whose_lines_differ(spark):
    """Near copies cut into other lines get through line dedup, and go here."""
    rng = random.Random(3)
    docs = []
    for i in range(20):
        w = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
        docs += [(3 * i, "\n".join(" ".join(w[k : k + 30]) for k in range(0, 120, 30)), "x", "s", 1), (3 * i + 1, "\n".join([" ".join(w[:15]), *(" ".join(w[k : k + 30]) for k in range(15, 120, 30))]), "x", "s", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    lined = corpus_pipeline.line_dedup(spark, frame, "")
    assert lined.count() == 40
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, lined, "").collect()) == [3 * i for i in range(20)]


def test_stages_of_odd_tables(spark, tmp_path):
    """Empty tables, null ids and texts, repeated rows, texts without words and columns with clashing names."""
    spark.createDataFrame([(1, "x y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(60))
    a, b = text(), text()
    extra = "n_lines string, n_removed string, lang_pred string, score string, c string, id string, label string, hits string, n_words string, n_tokens string, __text string"
    rows = [(None, a, "aa", "s", 1), (None, None, None, None, None), (1, b, "aa", "s", None), (1, b, "aa", "s", None), (2, "", "aa", "s", 0), (3, "...\n!!", None, None, 6), (4, b + "\n" + a + "\n\n--", "aa", "s", 1)]
    docs = spark.createDataFrame([(*r, *["clash"] * 11) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + extra)
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        found[name] = sorted((r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()), key=str)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert found["language_id"] == [1, 1, 4, None]
    assert found["line_dedup"] == [1, 1, 2, 3, None, None]  # 4 has nothing but earlier lines
    assert found["near_dedup"] == [1, 2, 3, 4, None, None]
    assert found["decontamination"] == found["tokenization"] == [1, 1, 2, 3, 4, None, None]
