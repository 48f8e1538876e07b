"""Kernels of the search for the number of domains: products of matrices against plain sums, and what they cost."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesselar.operators import kselect as K


def test_silhouettes_cost_less_than_sums(monkeypatch):
    rng = np.random.default_rng(1)
    x, x0 = rng.normal(size=(512, 62)), rng.normal(size=(4000, 62))
    l0 = rng.integers(0, 3, (4000, 1))
    rows = pa.RecordBatch.from_pydict({"i": pa.array(range(9000, 9512), pa.int64()), "vec": pa.array(list(x), pa.list_(pa.float64())), "labels": pa.array([[v % 3] for v in range(512)], pa.list_(pa.int32()))})
    run = K._silhouettes(x0, np.arange(4000), l0, [np.bincount(l0[:, 0], minlength=3)])

    def least(f):
        took = []
        for _ in range(3):
            start = time.thread_time()
            f()
            took.append(time.thread_time() - start)
        return min(took)

    sums = least(lambda: [np.stack([((x[lo : lo + 256] - y) ** 2).sum(1) for y in x0], 1) for lo in (0, 256)])
    assert least(lambda: list(run([rows]))) < 0.7 * sums


@pytest.mark.parametrize("far", [0.0, 1e7])
def test_products_are_the_sums(far):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(200, 5)), 1) + far
    tables = [np.concatenate([x[:k], x[:1]]) for k in (1, 2, 5)]  # the first centre twice: ties go to the first
    for one, lab in zip(tables, K._nearest(x, tables), strict=True):
        want = K._apart(x, one)
        assert (lab == want.argmin(1)).all()
        assert K._products(x, one) == pytest.approx(want, rel=1e-8) and (K._products(x, one)[want == 0] == 0).all()


def test_smoothed_across_batches(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9, 4))
    pairs = [(i, (i + s) % 9) for i in range(8) for s in (1, 2, 3)]  # the last has no neighbours
    vecs = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, vec array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = {r.i: r.vec for r in K.smoothed(vecs, spark.createDataFrame(pairs, "i long, j long"), 0.75).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i in range(9):
        near = x[[i, *[j for a, j in pairs if a == i]]]
        assert found[i] == pytest.approx(list(0.25 * x[i] + 0.75 * near.mean(0)))


def test_references_are_the_draws(spark):
    vecs = spark.createDataFrame([(i, [float(i), -2.0 * i]) for i in range(5)], "i long, vec array<double>")
    plan = K.references(vecs, 2)
    found = {(r["set"], r.i): r.vec for r in plan.collect()}
    draw = {(f"reference{r.r}", r.i, r.g): r.u for r in spark.sql("select explode(array(1, 2)) as r, i, g from range(5) as t(i) cross join range(2) as d(g)").withColumn("u", K.uniform("r", "i", "g")).withColumn("r", F.col("r")).collect()}
    assert len(found) == 10 and all(found[s, i] == [4 * draw[s, i, 0], -8 + 8 * draw[s, i, 1]] for s, i in found)
