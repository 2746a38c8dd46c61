"""Segments joined and dropped, by hand-computed rows."""

from rivulet.operators import condense as C


def s(t0, t1, text):
    return {"t0": t0, "t1": t1, "text": text}


def texts(found):
    return [(x["t0"], x["t1"], x["text"]) for x in found]


def test_micro_segments_join_forward_then_backward():
    rows = [s(0, 0.3, "Oh"), s(0.5, 3, "that is it."), s(3.1, 3.3, "Yes"), s(9, 12, "far away now")]
    assert texts(C.micro_joined(rows)) == [(0, 3.3, "Oh that is it. Yes"), (9, 12, "far away now")]
    assert texts(C.micro_joined([s(0, 0.1, "a")])) == [(0, 0.1, "a")] and texts(C.micro_joined([])) == []


def test_short_runs_join_within_bounds():
    rows = [s(0, 1, "one two"), s(1.5, 2, "three"), s(2.5, 4, "four five six seven"), s(4.2, 5, "and five more words here"), s(20, 21, "late")]
    assert texts(C.short_joined(rows)) == [(0, 4, "one two three four five six seven"), (4.2, 5, "and five more words here"), (20, 21, "late")]
    long = "x" * 70
    assert texts(C.short_joined([s(0, 1, "a b"), s(1, 2, long + " " + long)])) == [(0, 1, "a b"), (1, 2, long + " " + long)]


def test_repeats_within_thirty_seconds_go():
    rows = [s(0, 2, "this is a sentence"), s(5, 6, "This is a sentence"), s(8, 9, "a sentence"), s(10, 12, "this is a longer sentence"), s(40, 42, "this is a sentence"), s(41, 42, "short"), s(41.5, 42, "short")]
    assert [x["t0"] for x in C.without_repeats(rows)] == [0, 8, 40, 41, 41.5]
