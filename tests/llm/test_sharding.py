import random
import zlib

import pytest

from rivulet.llm import sharding


def brute(sizes, shards):
    low = max([0, *sizes])
    while sharding.greedy(sizes, low, shards) is None:
        low += 1
    return low


def test_smallest_capacity_is_minimal():
    rng = random.Random(5)
    for _ in range(100):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(0, 25))]
        assert sharding.smallest_capacity(sizes, 4) == brute(sizes, 4)


@pytest.mark.parametrize("blocks_bits", [12, 3])
def test_shards_are_minimax_over_the_hash_order(spark, monkeypatch, blocks_bits):
    monkeypatch.setattr(sharding, "_BITS", blocks_bits)
    monkeypatch.setattr(sharding, "BLOCKS", 1 << blocks_bits)
    rng = random.Random(blocks_bits)
    texts = [None, "", "dup"] + ["x" * rng.randint(0, 300) + str(i) for i in range(150)]
    rows = [(i, rng.choice(texts), "clash") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = sharding.shard(docs, shards=5).collect()
    assert len(out) == 500
    load, slots, of_text = {}, {}, {}
    for r in out:
        text = dict((a, b) for a, b, _ in rows)[r.doc_id] or ""
        assert r.size == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode())
        load[r.shard] = load.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        of_text.setdefault(text, set()).add(r.shard)
    assert all(len(s) == 1 for s in of_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    keys = spark.createDataFrame([(t,) for t in of_text], "t string").selectExpr("t", "xxhash64(t) h").collect()
    sizes = {}
    for _, t, _ in rows:
        sizes[t or ""] = sizes.get(t or "", 0) + len((t or "").encode()) + 1
    ordered = [sizes[r.t] for r in sorted(keys, key=lambda r: r.h)]
    assert max(load.values()) == brute(ordered, 5)


def test_a_group_of_a_third_has_its_shard_and_the_rest_is_even(spark):
    rows = [(i, "hot" * 20) for i in range(400)] + [(1000 + i, f"{i} " + "y" * (i % 50)) for i in range(1500)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).groupBy("shard").sum("size").collect()
    loads = sorted(r[1] for r in out)
    assert len(loads) == 8 and loads[-1] == 400 * 61
    assert loads[-2] <= 1.05 * sum(loads[:-1]) / 7


def test_empty_table_and_single_text(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = sharding.shard(spark.createDataFrame([(1, None), (1, None)], "doc_id long, text string")).collect()
    assert sorted((r["size"], r.slot, r.text_crc32) for r in out) == [(1, 0, 0), (1, 1, 0)]
