"""Features of a data set, information over space, and regression from image patches to expression."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..plans.tables import saved
from .graph import knn, knn_between


def expression_features(expr: DataFrame, n_vars: DataFrame) -> DataFrame:
    """One row: observations, genes, density, mean and spread of depth and of detected genes, entropy of genes in bits."""
    s = expr.groupBy("obs_id").agg(F.sum("value").alias("t"), F.count("*").alias("g"))
    a = s.agg(F.count("*").alias("n_obs"), F.avg("t").alias("mean_depth"), ratio(F.stddev_pop("t"), F.avg("t")).alias("cv_depth"), F.avg("g").alias("mean_genes"), F.sum("g").alias("entries"))
    g = expr.groupBy("gene_id").agg(F.sum("value").alias("s")).withColumn("p", F.col("s") / F.sum("s").over(Window.partitionBy()))
    h = g.agg((-F.sum(F.col("p") * F.log2("p"))).alias("gene_entropy"))
    out = a.crossJoin(h).crossJoin(n_vars.toDF("n_genes"))
    return out.withColumn("density", F.col("entries") / (F.col("n_obs") * F.col("n_genes"))).drop("entries")


def grid_features(points: DataFrame, cells: int = 10) -> DataFrame:
    """Spread of the counts of filled cells of a ``cells`` by ``cells`` grid, and their entropy in bits."""
    b = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = lambda v, lo, hi: F.least(F.floor((F.col(v) - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1e-12)) * cells), F.lit(cells - 1))
    g = points.crossJoin(F.broadcast(b)).groupBy(at("x", "x0", "x1").alias("cx"), at("y", "y0", "y1").alias("cy")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy())
    return g.withColumn("p", p).agg(ratio(F.stddev_pop("n"), F.avg("n")).alias("density_cv"), (-F.sum(F.col("p") * F.log2("p"))).alias("grid_entropy"))


def gram(v: DataFrame) -> DataFrame:
    """``g, h, s``: sums of products of centred genes; genes of a block are few, observations are not."""
    m = v.groupBy("gene").agg(F.avg("v").alias("m"))
    c = v.join(m, "gene").select("i", "gene", (F.col("v") - F.col("m")).alias("v"))
    return c.select("i", F.col("gene").alias("g"), F.col("v").alias("a")).join(c.select("i", F.col("gene").alias("h"), F.col("v").alias("b")), "i").filter("g <= h").groupBy("g", "h").agg(F.sum(F.col("a") * F.col("b")).alias("s"))


def singular_values(v: DataFrame) -> np.ndarray:
    """Of the centred matrix, from the largest on, by way of its Gram matrix; more than ``GENES`` genes are refused."""
    n = v.select("gene").distinct().count()
    if n > GENES:
        raise ValueError(f"{n} genes by genes are too many for a driver; take the {GENES} that vary most")
    rows = gram(v).collect()
    at = {g: i for i, g in enumerate(sorted({r["g"] for r in rows} | {r["h"] for r in rows}))}
    m = np.zeros((len(at), len(at)))
    for r in rows:
        m[at[r["g"]], at[r["h"]]] = m[at[r["h"]], at[r["g"]]] = r["s"]
    return np.sqrt(np.clip(np.linalg.eigvalsh(m), 0, None))[::-1]


def effective_rank(v: DataFrame) -> float:
    """exp of the entropy of the singular values' shares."""
    s = singular_values(v)
    p = s[s > 0] / s.sum()
    return float(np.exp(-(p * np.log(p)).sum())) if len(p) else 0.0


def top_variance_genes(v: DataFrame, n: int) -> DataFrame:
    return v.groupBy("gene").agg(F.var_pop("v").alias("variance")).orderBy(F.desc(F.round("variance", 9)), "gene").limit(n)


def binned_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information in nats of two binned columns, from their counts."""
    c = df.groupBy(a, b).agg(F.count("*").alias("n"))
    w = lambda *k: Window.partitionBy(*k)
    c = c.withColumn("na", F.sum("n").over(w(a))).withColumn("nb", F.sum("n").over(w(b))).withColumn("all", F.sum("n").over(w()))
    return c.agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("mi"))


def spatial_information_ratio(points: DataFrame, bins: int = 4) -> DataFrame:
    """How much of a label's information position gives beyond chance: observed against a hash-shuffled null."""
    q = lambda c: F.ntile(bins).over(Window.orderBy(c, "i"))
    b = points.select("i", "label", (q("x") * bins + q("y")).alias("cell"))
    shuffled = b.select("label", F.row_number().over(Window.orderBy(F.md5(F.col("i").cast("string")), "i")).alias("r"))
    cells = b.select("cell", F.row_number().over(Window.orderBy("i")).alias("r"))
    null = binned_information(shuffled.join(cells, "r"), "cell", "label").withColumnRenamed("mi", "null_mi")
    return binned_information(b, "cell", "label").crossJoin(null).withColumn("ratio", ratio(F.col("mi") - F.col("null_mi"), F.col("mi")))


def patch_features(pixels: DataFrame, spots: DataFrame, size: float) -> DataFrame:
    """``i, mean, sd``: of the pixels (``px, py, band``) in the square of ``size`` around each spot, by grid cells."""
    half = size / 2.0
    cell = lambda df, x, y: df.withColumn("cx", F.floor(F.col(x) / size)).withColumn("cy", F.floor(F.col(y) / size))
    around = F.sequence(F.lit(-1), F.lit(1))
    s = cell(spots.select("i", "x", "y"), "x", "y").withColumn("cx", F.explode(F.transform(around, lambda d: F.col("cx") + d))).withColumn("cy", F.explode(F.transform(around, lambda d: F.col("cy") + d)))
    j = s.join(cell(pixels, "px", "py"), ["cx", "cy"]).filter((F.abs(F.col("px") - F.col("x")) <= half) & (F.abs(F.col("py") - F.col("y")) <= half))
    return j.groupBy("i").agg(F.avg("band").alias("mean"), F.stddev_pop("band").alias("sd"), F.count("*").alias("n"))


def ridge(x: DataFrame, y: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Predictions ``i, gene, v`` (not below 0) of ``y(i, gene, v)`` from ``x(i, vec)`` and a constant by normal equations;
    all coefficients, the constant's too, are drawn towards 0.

    Sums of products are aggregated; only the systems, features by features and features by genes, reach the driver.
    """
    d = x.select("i", F.concat(F.array(F.lit(1.0)), "vec").alias("f"))
    terms = d.select(F.posexplode("f").alias("p", "a"), "f").select("p", "a", F.posexplode("f").alias("q", "b")).groupBy("p", "q").agg(F.sum(F.col("a") * F.col("b")).alias("s")).collect()
    n = max((r["p"] for r in terms), default=-1) + 1
    a = np.zeros((n, n))
    for r in terms:
        a[r["p"], r["q"]] = r["s"]
    right = y.join(d, "i").select("gene", "v", F.posexplode("f").alias("p", "a")).groupBy("gene", "p").agg(F.sum(F.col("a") * F.col("v")).alias("s")).collect()
    genes = {g: k for k, g in enumerate(sorted({r["gene"] for r in right}))}
    b = np.zeros((n, len(genes)))
    for r in right:
        b[r["p"], genes[r["gene"]]] = r["s"]
    w = np.linalg.solve(a + alpha * np.eye(n), b)
    coef = x.sparkSession.createDataFrame([(g, w[:, k].tolist()) for g, k in genes.items()], "gene int, w array<double>")
    value = F.aggregate(F.zip_with("f", "w", lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    return d.join(F.broadcast(coef)).select("i", "gene", F.greatest(value, F.lit(0.0)).alias("v"))  # a row for each gene that is predicted


def standardized_vectors(vecs: DataFrame) -> DataFrame:
    """``i, vec`` with every component centred and in units of its deviation; 0 where that is below 1e-8."""
    long = vecs.select("i", F.posexplode("vec").alias("g", "v"))
    m = long.groupBy("g").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    z = long.join(F.broadcast(m), "g").select("i", "g", F.when(F.col("sd") > 1e-8, (F.col("v") - F.col("m")) / F.col("sd")).otherwise(0.0).alias("v"))  # a row for each component
    return z.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "v"))), lambda x: x["v"]).alias("vec"))


def pooled(vecs: DataFrame, edges: DataFrame) -> DataFrame:
    """``i, vec``: the mean of the neighbours' vectors."""
    long = edges.join(vecs.select(F.col("i").alias("j"), "vec"), "j").select("i", F.posexplode("vec").alias("g", "v"))
    return long.groupBy("i", "g").agg(F.avg("v").alias("v")).groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "v"))), lambda x: x["v"]).alias("vec"))


def virtual_expression(patches: DataFrame, points: DataFrame, y: DataFrame, family: str = "morphology", k: int = 6, n_genes: int = 64, alpha: float = 1.0) -> DataFrame:
    """Expression predicted from image patches ``i, vec``, of the ``n_genes`` genes that vary most, by one of three families.

    morphology: ridge on the standardised patches. scellst: patches and the mean of k/2 neighbours' side by side, fitted on
    log1p. storm: patches and the mean of k neighbours', weighted by softmax of how far each is from average, fitted on what
    is left of the genes' means.
    """
    some = y.join(F.broadcast(top_variance_genes(y, n_genes).select("gene")), "gene")
    x = saved(standardized_vectors(patches), "patches")
    if family == "morphology":
        return ridge(x, some, alpha)
    if family == "scellst":
        near = pooled(x, knn(points, max(2, k // 2)))
        both = standardized_vectors(x.join(near.withColumnRenamed("vec", "near"), "i").select("i", F.concat("vec", "near").alias("vec")))
        out = ridge(saved(both, "bags"), some.withColumn("v", F.log1p(F.greatest("v", F.lit(0.0)))), alpha)
        return out.withColumn("v", F.expm1(F.least("v", F.lit(20.0))))
    if family != "storm":
        raise ValueError(f"no family {family!r}")
    near = saved(standardized_vectors(pooled(x, knn(points, k))), "near_patches")
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + F.abs(v)) / F.size(c)
    both = x.join(near.withColumnRenamed("vec", "near"), "i").withColumns({"a": F.exp(size(F.col("vec"))), "b": F.exp(size(F.col("near")))})
    part = lambda c, w: F.transform(c, lambda v: v * F.col(w) / (F.col("a") + F.col("b")))
    fused = saved(standardized_vectors(both.select("i", F.concat(part("vec", "a"), part("near", "b")).alias("vec"))), "fused")
    mean = F.broadcast(some.groupBy("gene").agg(F.avg("v").alias("m")))  # a row for each gene that is predicted
    left = some.join(mean, "gene").select("i", "gene", (F.col("v") - F.col("m")).alias("v"))
    return ridge(fused, left, alpha).join(mean, "gene").select("i", "gene", F.greatest(F.col("v") + F.col("m"), F.lit(0.0)).alias("v"))


def hopkins(points: DataFrame, samples: int = 50, seed: int = 42) -> float:
    """Near 1 where points cluster, 0.5 where they lie at random: distances to the nearest point from random places of the
    bounding box as a share of those and of the distances from as many points. Draws come from hashes."""
    from ..sources.synthetic import uniform

    b = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")).first()
    n = min(samples, b["n"])
    if n < 2:
        return float("nan")
    drawn = points.sparkSession.range(n).withColumnRenamed("id", "i").select("i", *[(b[f"{c}0"] + uniform(seed, c, "i") * (b[f"{c}1"] - b[f"{c}0"])).alias(c) for c in ("x", "y")])
    some = points.orderBy(F.xxhash64(F.lit(seed), "i"), "i").limit(n).select("i")
    w = knn_between(drawn, points).agg(F.sum(F.sqrt("d2"))).first()[0]
    u = knn(points, 1).join(F.broadcast(some), "i").agg(F.sum(F.sqrt("d2"))).first()[0]
    return float(w / (u + w + 1e-12))


#: Genes by genes that a driver decomposes at most.
GENES = 500


def dataset_features(expr: DataFrame, var: DataFrame, points: DataFrame, v: DataFrame, labels: DataFrame | None = None, geometry: bool = True) -> DataFrame:
    """One row with the features that data sets are compared by.

    expr: sparse ``obs_id, gene_id, value``; var: ``gene_id``; v: the same matrix, dense, of the genes that vary, as ``i, gene,
    v``; points: ``i, x, y``; labels: ``i, label`` of the truth, where there is one. geometry: with the features that need a
    decomposition on the driver, of at most ``GENES`` genes, or draws.
    """
    from .svg import morans_i

    t = expr.groupBy("obs_id").agg(F.sum("value").alias("t"), F.count_if(F.col("value") > 0).alias("g"), F.sum(F.when(F.col("value") > 0, F.col("value"))).alias("p"))
    a = t.agg(F.count("*").alias("n_obs"), F.avg("t").alias("library_mean"), F.stddev_pop("t").alias("sd"), F.sum("g").alias("filled"), F.sum("p").alias("positive"))
    genes = expr.groupBy("gene_id").agg(F.greatest(F.sum("value"), F.lit(0.0)).alias("s"))
    whole = F.broadcast(genes.agg(F.sum("s").alias("all")))
    share = F.col("s") / F.col("all")
    h = genes.crossJoin(whole).agg(F.coalesce(-F.sum(F.when(F.col("s") > 0, share * F.log2(share))), F.lit(0.0)).alias("expression_entropy"))
    out = a.crossJoin(h).crossJoin(var.agg(F.count("*").alias("n_vars")))  # one row each, as all that follow
    out = out.select(
        F.col("n_obs").cast("double"), F.col("n_vars").cast("double"), (F.col("n_vars") / F.greatest("n_obs", F.lit(1))).alias("aspect_ratio"), (1 - F.col("filled") / (F.col("n_obs") * F.col("n_vars"))).alias("sparsity"),
        F.coalesce(F.col("positive") / F.col("filled"), F.lit(0.0)).alias("mean_nonzero"), "library_mean", (F.col("sd") / (F.col("library_mean") + 1e-8)).alias("library_cv"), "expression_entropy",
    )
    edges = knn(points, 6)
    top = F.broadcast(top_variance_genes(v, 10).select("gene"))
    out = out.crossJoin(morans_i(v.join(top, "gene"), edges, 6).agg(F.avg("morans_i").alias("spatial_autocorrelation")))
    area = points.agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    side = F.when((F.col("w") > 0) & (F.col("h") > 0), F.col("w") * F.col("h")).when(F.greatest("w", "h") > 0, F.greatest("w", "h")).otherwise(1.0)
    near = edges.agg(F.avg(F.sqrt("d2")).alias("d")).crossJoin(area).select((F.col("d") / (F.sqrt(side) + 1e-12)).alias("mean_nn_distance"))
    out = out.crossJoin(near).crossJoin(grid_features(points).select(F.col("density_cv").alias("spatial_density_cv"), F.col("grid_entropy").alias("spatial_entropy")))
    if labels is not None:
        n = labels.groupBy("label").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
        kinds = n.agg(F.count("*").cast("double").alias("n_domains"), (-F.sum(F.col("p") * F.log("p")) / F.greatest(F.log(F.count("*")), F.lit(1e-12))).alias("domain_balance"))
        each = F.broadcast(n.select(F.col("label").alias("gene")))  # labels are few
        ones = labels.join(each).select("i", "gene", (F.col("label") == F.col("gene")).cast("double").alias("v"))
        out = out.crossJoin(kinds).crossJoin(morans_i(ones, edges, 6).agg(F.avg("morans_i").alias("domain_spatial_coherence")))
    if not geometry:
        return out
    s = singular_values(v.join(F.broadcast(top_variance_genes(v, GENES).select("gene")), "gene"))
    p = s**2 / (s**2).sum() if (s**2).sum() > 0 else s
    total = np.cumsum(p)
    rank = lambda share: float(np.searchsorted(total, share) + 1) if p.sum() > 0 else 0.0
    entropy = float(-(p * np.log(np.clip(p, 1e-12, None))).sum() / max(math.log(len(p)), 1e-12)) if p.sum() > 0 else 0.0
    return saved(out, "features").withColumns({"effective_rank_90": F.lit(rank(0.9)), "effective_rank_95": F.lit(rank(0.95)), "sv_entropy": F.lit(entropy), "cluster_tendency": F.lit(hopkins(points))})
