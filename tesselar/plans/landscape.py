"""Runs of methods over data sets: a table of jobs, of which those without a row in the run log are still to do.

A job is a data set, a method with its version and parameters, and a seed; its name is the hash of those. Every job leaves
one row in the log, whatever becomes of it: a failure is a row with its error and no score, and the others go on. A job's
row is written under its name, so a job that ran twice has one row, and a run that was stopped goes on where it ended. Jobs
are Spark jobs of their own; several are handed to the cluster at a time.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, labels, svg
from . import methods
from .methods import Sample

RUNS = "job string, dataset string, category string, method string, version string, seed int, params string, status string, score double, seconds double, error string"
#: Genes that a method's result is judged by, as far as the sample has as many markers.
TOP_GENES = 50


@dataclass(frozen=True)
class Job:
    dataset: str
    category: str
    method: str
    version: str = ""
    seed: int = 0
    params: str = "{}"

    @property
    def name(self) -> str:
        return hashlib.sha256(json.dumps([self.dataset, self.category, self.method, self.version, self.seed, self.params]).encode()).hexdigest()[:32]


def planned(datasets: Iterable[str], category: str, names: Iterable[str], params: dict[str, dict[str, Any]] | None = None, seeds: Iterable[int] = (0,)) -> list[Job]:
    """Every method on every data set. Of a data set's ``params`` a method is given those that it declares; a method that is not
    known is a job too, which will fail."""
    jobs = []
    for name in names:
        try:
            m = methods.get_method(category, name)
            known, version = {p.name for p in m.params}, m.version
        except KeyError:
            known, version = set(), ""
        for dataset in datasets:
            given = {k: v for k, v in (params or {}).get(dataset, {}).items() if k in known}
            jobs += [Job(dataset, category, name, version, s, json.dumps(given, sort_keys=True)) for s in seeds]
    return jobs


def jobs_table(spark: SparkSession, jobs: list[Job]) -> DataFrame:
    return spark.createDataFrame([(j.name, j.dataset, j.category, j.method, j.version, j.seed, j.params) for j in jobs], RUNS.partition(", status")[0])


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The run log; empty where nothing ran yet."""
    try:
        found = spark.read.schema(RUNS).parquet(f"{path}/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUNS)
    return found


def pending(spark: SparkSession, jobs: list[Job], path: str, again: tuple[str, ...] = ()) -> DataFrame:
    """Jobs without a row in the log, or with a status among ``again``."""
    done = runs(spark, path).filter(~F.col("status").isin(*again)) if again else runs(spark, path)
    return jobs_table(spark, jobs).join(done.select("job"), "job", "left_anti")


def scored(sample: Sample, result: Sample, category: str) -> float | None:
    """Between 0 and 1, 1 being best; none where the sample has no truth of the category's kind.

    Domains: adjusted Rand index against ``truth(i, label)``. Spatially variable genes: share of the first ``TOP_GENES`` found
    among ``true_markers(gene)``. Deconvolution: 1 less the root mean squared difference from ``true_proportions(i, label, p)``.
    """
    if category == "domain_detection" and "truth" in sample:
        both = sample["truth"].join(result["domains"].select("i", F.col("domain").cast("string").alias("pred")), "i").select(F.col("label").cast("string").alias("label"), F.coalesce("pred", F.lit("noise")).alias("pred"))
        return labels.adjusted_rand(labels.contingency(both)).first()[0]
    if category == "spatially_variable_genes" and "true_markers" in sample:
        n = min(TOP_GENES, sample["true_markers"].count())
        found = result["svg"]
        top = svg.top_genes(found, max(n, 1), "score" if "score" in found.columns else "morans_i")
        most = min(top.count(), n)
        return top.join(sample["true_markers"], "gene", "left_semi").count() / most if most else 0.0
    if category == "deconvolution" and "true_proportions" in sample:
        d = sample["true_proportions"].join(result["proportions"].select("i", "label", F.col("p").alias("q")), ["i", "label"], "left")
        return d.agg((1 - F.sqrt(F.avg((F.col("p") - F.coalesce("q", F.lit(0.0))) * (F.col("p") - F.coalesce("q", F.lit(0.0)))))).alias("s")).first()["s"]
    return None


def _one(spark: SparkSession, job: dict[str, Any], samples: dict[str, Sample], path: str) -> None:
    start, score, error = time.perf_counter(), None, None
    try:
        sample = samples[job["dataset"]]
        m = methods.get_method(job["category"], job["method"], job["version"] or None)
        if lacks := [t for t in m.needs if t not in sample]:
            raise ValueError(f"{m.name} needs {', '.join(lacks)}")
        score = scored(sample, m.run(dict(sample), **m.bound(json.loads(job["params"]))), job["category"])
        status = "ok"
    except Exception as e:  # whatever a method raises is its result: the row says so, and the other jobs go on
        status, error = "failed", f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:500]
    row = (*(job[c] for c in ("job", "dataset", "category", "method", "version", "seed", "params")), status, None if score is None else float(score), round(time.perf_counter() - start, 4), error)
    spark.createDataFrame([row], RUNS).coalesce(1).write.mode("overwrite").parquet(f"{path}/{job['job']}")


def run(spark: SparkSession, samples: dict[str, Sample], jobs: list[Job], path: str, workers: int = 4, most: int | None = None, again: tuple[str, ...] = ()) -> DataFrame:
    """Do what is pending, ``most`` jobs at most, and give the jobs' rows of the log. ``path``: a folder that all machines share."""
    todo = [r.asDict() for r in pending(spark, jobs, path, again).orderBy("category", "method", "dataset", "seed").collect()][:most]  # jobs, not data
    with ThreadPoolExecutor(workers) as pool:
        list(pool.map(lambda j: _one(spark, j, samples, path), todo))
    return runs(spark, path).join(jobs_table(spark, jobs).select("job"), "job", "left_semi")


def run_tasks(spark: SparkSession, samples: dict[str, Sample], tasks: dict[str, list[str]], path: str, params: dict[str, dict[str, Any]] | None = None, **options: Any) -> DataFrame:
    """Every category's methods on every data set, in one log."""
    return run(spark, samples, [j for c, names in tasks.items() for j in planned(sorted(samples), c, names, params)], path, **options)


def landscape(log: DataFrame) -> DataFrame:
    """``category, dataset, config, score, secs, n``: means over seeds of the jobs that gave a score."""
    return log.filter("status = 'ok' and score is not null").groupBy("category", "dataset", F.col("method").alias("config")).agg(F.avg("score").alias("score"), F.avg("seconds").alias("secs"), F.count("*").alias("n"))


def winners(scores: DataFrame) -> DataFrame:
    """``category, dataset, config, score, niches``: of each data set the best method, and all that come within 95 % of it."""
    found = None
    for (category,) in scores.select("category").distinct().collect():  # a handful of categories
        own = scores.filter(F.col("category") == category)
        near = evidence.niches(own).groupBy("dataset").agg(F.array_sort(F.collect_set("config")).alias("niches"))
        best = own.groupBy("dataset").agg(F.max("score").alias("score"))
        best = own.join(best, ["dataset", "score"]).groupBy("dataset").agg(F.min("config").alias("config"), F.first("score").alias("score"))
        one = best.join(near, "dataset").select(F.lit(category).alias("category"), "dataset", "config", "score", "niches")
        found = one if found is None else found.unionByName(one)
    return scores.select("category", "dataset", "config", "score").limit(0).withColumn("niches", F.array().cast("array<string>")) if found is None else found


def embedded(features: DataFrame) -> DataFrame:
    """``dataset, x, y``: data sets on the first two components of their standardised features ``(dataset, vec)``.

    Missing values take their feature's median, 0 where none is known; features that are the same everywhere say nothing.
    The features' moments and products are aggregated, and only features by features reach the driver; a component's sign
    makes its largest loading positive.
    """
    x = features.select("dataset", F.posexplode("vec").alias("g", "v")).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    x = x.join(F.broadcast(x.groupBy("g").agg(F.coalesce(F.median("v"), F.lit(0.0)).alias("mid"))), "g").select("dataset", "g", F.coalesce("v", "mid").alias("v"))
    m = x.groupBy("g").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    z = x.join(F.broadcast(m), "g").select("dataset", "g", ((F.col("v") - F.col("m")) / F.when(F.col("sd") < 1e-12, 1.0).otherwise(F.col("sd"))).alias("z"))
    gram = z.join(z.withColumnsRenamed({"g": "h", "z": "zh"}), "dataset").groupBy("g", "h").agg(F.sum(F.col("z") * F.col("zh")).alias("s")).collect()
    p = 1 + max((r["g"] for r in gram), default=-1)
    a = np.zeros((max(p, 2), max(p, 2)))
    for r in gram:
        a[r["g"], r["h"]] = r["s"]
    axes = np.linalg.eigh(a)[1][:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), [0, 1]])
    rows = [(g, float(axes[g, 0]), float(axes[g, 1])) for g in range(p)]
    w = F.broadcast(features.sparkSession.createDataFrame(rows, "g int, a double, b double"))
    return z.join(w, "g").groupBy("dataset").agg(F.sum(F.col("z") * F.col("a")).alias("x"), F.sum(F.col("z") * F.col("b")).alias("y"))
