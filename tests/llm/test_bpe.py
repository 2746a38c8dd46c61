import hashlib

import numpy as np
import public_tokenizers as P
import pytest

from rivulet.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as f:
        return bpe.codec(f.read(), P.PATTERN)


@pytest.mark.parametrize("text", ["", " ", "Hello  world\n\n it's 42x! été ßü 漢字  x", "don't" * 40000, "ab 12 " * 40000, "!'s" * 60000, "a" * 200000, "x" + " " * 300000 + "y", "é" * 150000, "a'" * 70000 + "  " * 40000, "1a" * 50000 + "\r\n\t" * 9])
def test_pieces_equal_the_library_on_the_whole_text(coder, text):
    ids = coder.encode(text)
    assert ids == coder._encoding.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


def test_runs_beyond_the_library_stack(coder):
    text = "a" + " " * 1_500_000 + "b" + "\n" * 1_500_000
    ids = coder.encode(text)
    assert coder.decode(ids) == text.encode()


def test_special_tokens_are_plain_text(coder):
    assert coder.decode(coder.encode("<|endoftext|>")) == b"<|endoftext|>"
    assert len(coder.encode("<|endoftext|>")) > 1


def test_round_trip_of_nulls_repeats_and_clashing_columns(spark, coder):
    rows = [(1, None, "x"), (2, "", "x"), (3, "été\n", "y"), (3, "été\n", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, RANKS, P.PATTERN).collect()}
    none = hashlib.sha256(b"").hexdigest()
    ids = coder.encode("été\n")
    assert found == {(1, 0, none, none), (2, 0, none, none), (3, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256("été\n".encode()).hexdigest())}
    assert bpe.round_trip(docs, RANKS, P.PATTERN).count() == 4
    assert bpe.round_trip(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_encode_then_decode(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    back = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert {(r.doc_id, bytes(r.decoded)) for r in back} == {(1, b"a b"), (2, b"")}
