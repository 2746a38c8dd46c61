"""Groups as column arrays: every group once and whole, whatever batches it comes in."""

from collections import defaultdict

import numpy as np

from rivulet.operators.grouped import per_group


def test_groups_over_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        rng = np.random.default_rng(1)
        rows = [(None if k == 3 else int(k), f"p{k % 2}", int(i), float(rng.integers(0, 9))) for k in range(9) for i in range(int(rng.integers(1, 40)))]
        table = spark.createDataFrame(rows, "job_id long, part string, i long, x double").repartition(5)
        out = per_group(table, ["job_id", "part"], ["i"], lambda c: {"n": [len(c["i"])], "ordered": [bool((np.diff(c["i"]) > 0).all())], "total": [c["x"].sum()]}, "n long, ordered boolean, total double").collect()
        want = defaultdict(list)
        for job, part, _, x in rows:
            want[job, part].append(x)
        assert {(r.job_id, r.part): (r.n, r.ordered, r.total) for r in out} == {k: (len(v), True, sum(v)) for k, v in want.items()} and len(out) == len(want)
        many = per_group(table, ["job_id"], ["i"], lambda c: {"v": np.repeat(c["x"], 3)}, "v double")
        assert many.count() == 3 * len(rows) and many.columns == ["job_id", "v"]
        assert per_group(table, ["job_id"], ["i"], lambda c: {"v": []}, "v double").count() == 0
        assert per_group(table.limit(0), ["job_id"], ["i"], lambda c: {"v": c["x"]}, "v double").count() == 0
    finally:
        spark.conf.set(key, before)
