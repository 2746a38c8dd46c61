"""Folds and rules about subjects that SQL does not restate."""

from rivulet.functions import parse as P
from rivulet.operators import folds as D
from rivulet.operators import subjects as Z
from pyspark.sql import functions as F


def test_position_clusters():
    two = [20, 21, 22, 20, 80, 81, 79, 80]
    assert Z.position_clusters(two) == [{"center": 20, "count": 4}, {"center": 80, "count": 4}]
    assert Z.position_clusters([50, 51, 52, 50, 51]) == [] and Z.position_clusters([1, 2, 90]) == []
    # a few places in the middle part the two others, and are left out in a second try
    assert [c["center"] for c in Z.position_clusters([*two, 50, 51])] == [20, 80]
    assert [c["center"] for c in Z.position_clusters([10] * 5 + [35] * 5 + [90] * 5)] == [10, 35, 90]


def test_short_stretches_join_neighbours():
    s = lambda *rows: [{"t0": a, "t1": b, "slot": k, "cut": c} for a, b, k, c in rows]
    spans = lambda found: [(x["t0"], x["t1"], x["slot"]) for x in found]
    assert spans(Z.merged_short(s((0, 5, 1, False), (5, 6, 2, False), (6, 15, 3, False)), 2)) == [(0, 5, 1), (5, 15, 3)]
    assert spans(Z.merged_short(s((0, 5, 1, False), (5, 6, 2, False), (6, 8, 2, False)), 2)) == [(0, 5, 1), (5, 8, 2)]
    # never over the border of a shot
    assert spans(Z.merged_short(s((0, 5, 1, False), (5, 6, 2, True), (6, 9, 3, True)), 2)) == [(0, 5, 1), (5, 6, 2), (6, 9, 3)]
    assert spans(Z.merged_short(s((0, 1, 1, False), (1, 2, 1, False), (2, 3, 2, False)), 2)) == [(0, 3, 1)]


def test_tracks_and_paths():
    r = lambda t, x, shot=0: {"t": t, "shot": shot, "x": x, "y": 50.0, "w": 20.0, "h": 20.0}
    rows = [r(0.0, 20.0), r(0.1, 70.0), r(0.3, 22.0), r(0.9, 22.0), r(1.0, 24.0), r(1.1, 24.0, 1)]
    assert [x["track"] for x in Z.tracked(rows)] == [0, 1, 0, 2, 2, 3]
    path = list(Z.motion_path([r(0.0, 10.0), r(0.0, 90.0), r(1.0, 90.0), r(1.1, 5.0, 1)]))
    assert [round(p["x"], 6) for p in path] == [10.0, 35.0, 5.0]


def test_inherited_and_repaired():
    p = lambda *xs: [{"t": float(i), "x": x} for i, x in enumerate(xs)]
    xs = lambda found: [x["x"] for x in found]
    assert xs(D.inherited(p(50, 50, 20, 50, 80))) == [20, 20, 20, 20, 80]
    assert xs(D.inherited(p(50, *[50] * 6, 90))) == [50, 50, 90, 90, 90, 90, 90, 90]
    assert xs(D.gap_repaired(p(20, 60, 22, 60, 60))) == [20, 20, 22, 60, 60]
    waits = [c["waited"] for c in D.admitted([{"s": 0.0}, {"s": 1.0}, {"s": 1.0}, {"s": 200.0}])]
    assert waits == [0.0, 2.0, 5.0, 0.0]


def test_answers(spark):
    def one(column, text):
        return spark.createDataFrame([(text,)], "a string").select(column(F.col("a")).alias("x")).first()[0]

    raw = '{"t": "line\none\ttab \\" quote\\\\", "n": 1}\n'
    assert one(P.escaped_breaks, raw) == '{"t": "line\\none\\ttab \\" quote\\\\", "n": 1}\n'
    assert one(P.escaped_breaks, '"open\n') == '"open\\n' and one(P.escaped_breaks, "") == ""
    for text, want in (
        ('{"a": 1}', '{"a": 1}'),
        ('<think>{"no"}</think>```json\n{"a": "x\ny"}\n```', '{"a": "x\\ny"}'),
        ('Sure: {"a": {"b": 2}} thanks', '{"a": {"b": 2}}'),
        ("<reasoning>never ends {\"a\": 3}", '{"a": 3}'),
        ("nothing", None),
        ('{"a": ', None),
    ):
        assert one(P.json_text, text) == want, text
    cut = '<think>"clips": [{"no": 1}]</think> {"clips" : [ {"a": 1, "b": {"c": "x\ny"}}, {bad}, {"a": 2}, {"a": 3'
    assert one(P.partial_objects, cut) == ['{"a": 1, "b": {"c": "x\\ny"}}', '{"a": 2}']
    assert one(P.partial_objects, '{"clips": [{"a": 1}], "other": [{"a": 9}]}') == ['{"a": 1}'] and one(P.partial_objects, "none") == []
    assert one(lambda c: P.corrections(c, F.lit(2)), '```\n["a", "b"]\n```') == ["a", "b"] and one(lambda c: P.corrections(c, F.lit(3)), '["a", "b"]') is None
