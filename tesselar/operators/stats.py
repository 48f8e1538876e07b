"""Tests, information and model choice over evidence and points, from aggregates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import erfc

#: Cut-offs of the information ratio, and of its z score against shuffled places (fixed values).
RATIO_LOW, RATIO_HIGH, Z_CRITICAL = 0.1, 0.3, 3.0
#: Rows of all labels in a cell of a search by nearest neighbours, about; half as many of one label.
BLOCK = 1024
#: Up to so many differences without ties the signed-rank test is exact.
EXACT = 50


def signed_rank_table(most: int = EXACT) -> list[tuple[int, int, float]]:
    """(n, w, p): two-sided probability of a rank sum of w or less on the smaller side, from the number of subsets."""
    out, ways = [], np.array([1.0])
    for n in range(1, most + 1):
        new = np.zeros(len(ways) + n)
        new[: len(ways)] += ways
        new[n:] += ways
        ways = new
        below = np.cumsum(ways) / 2.0**n
        out += [(n, w, float(min(1.0, 2 * below[w]))) for w in range(n * (n + 1) // 4 + 1)]
    return out


def signed_rank(diffs: DataFrame, by: list[str], value: str = "d", exact: bool = True) -> DataFrame:
    """Wilcoxon's signed-rank test in each group: ``n, w, p_value``, two-sided; zeros are left out, ties share their rank.

    Exact up to ``EXACT`` differences without ties or zeros, else by the normal approximation with the ties' correction. A
    group without a difference has p 1.
    """
    d = diffs.withColumn("_z", F.coalesce((F.col(value) == 0).cast("int"), F.lit(1)))
    groups = d.groupBy(*by).agg(F.sum("_z").alias("zeros"), F.avg(value).alias("mean_difference"), F.median(value).alias("median_difference"), F.count("*").alias("n_pairs"))
    d = d.filter("_z = 0").withColumn("_a", F.abs(value))
    w, same = Window.partitionBy(*by).orderBy("_a"), Window.partitionBy(*by, "_a")
    d = d.withColumn("_t", F.count("*").over(same)).withColumn("_r", F.rank().over(w) + (F.col("_t") - 1) / 2.0)
    s = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col(value) > 0, F.col("_r")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col(value) < 0, F.col("_r")).otherwise(0.0)).alias("minus"), F.sum(F.col("_t") * F.col("_t") - 1).alias("ties"))
    s = groups.join(s, by, "left").withColumn("w", F.least("plus", "minus"))
    mean, var = F.col("n") * (F.col("n") + 1) / 4.0, F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24.0 - F.col("ties") / 48.0
    p = F.when(F.col("n").isNull() | (var <= 0), 1.0).otherwise(F.least(F.lit(1.0), erfc(F.abs(F.col("w") - mean) / F.sqrt(var) / math.sqrt(2.0))))
    if exact:
        table = F.broadcast(diffs.sparkSession.createDataFrame(signed_rank_table(), "n long, w0 long, _p double"))  # a fixed number of rows
        plain = (F.col("ties") == 0) & (F.col("zeros") == 0) & (F.col("n") <= EXACT)
        s = s.withColumn("w0", F.when(plain, F.col("w").cast("long"))).join(table, ["n", "w0"], "left")
        p = F.coalesce("_p", p)
    return s.select(*by, "n_pairs", "mean_difference", "median_difference", "w", p.alias("p_value"))


def checked(df: DataFrame, p: str) -> DataFrame:
    """The table, if all its p values are numbers from 0 to 1; raises otherwise."""
    bad = df.filter(F.col(p).isNull() | F.isnan(p) | (F.col(p) < 0) | (F.col(p) > 1)).take(1)
    if bad:
        raise ValueError(f"{bad[0][p]} is no p value")
    return df


def imputed(df: DataFrame, columns: list[str], reference: DataFrame | None = None) -> DataFrame:
    """Missing values replaced by the column's median, then standardised; medians and moments are those of ``reference``.

    A column without a value is 0 everywhere; one without spread is only centred.
    """
    ref = reference if reference is not None else df
    good = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    med = ref.agg(*[F.coalesce(F.median(good(c)), F.lit(0.0)).alias(c) for c in columns]).first()
    filled = lambda d: d.withColumns({c: F.coalesce(good(c), F.lit(med[c])) for c in columns})
    stats = filled(ref).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    scaled = {c: (F.col(c) - (stats[f"m{i}"] or 0.0)) / (stats[f"s{i}"] if (stats[f"s{i}"] or 0.0) >= 1e-12 else 1.0) for i, c in enumerate(columns)}
    return filled(df).withColumns(scaled)


def digamma(n: Column) -> Column:
    """For n from 1 on, by an asymptotic series six steps further up."""
    x = n.cast("double") + 6
    f = 1 / (x * x)
    series = F.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))
    return series - sum((1 / (n.cast("double") + i) for i in range(1, 6)), 1 / n.cast("double"))


def mutual_information(rows: DataFrame, k: int = 3) -> DataFrame:
    """One row, ``mi``: information in nats between ``label`` and ``vec`` of ``rows(i, label, vec)``, by nearest neighbours.

    Of every row the k-th least distance within its label (fewer in small labels), and how many rows of all lie no farther,
    both by the largest difference in a coordinate, as ``information.information`` finds them for any number of groups.
    """
    from .information import information

    one = rows.select(F.lit(0).cast("long").alias("g"), "i", "label", "vec")
    return information(one, k, BLOCK).agg(F.coalesce(F.max("mi"), F.lit(0.0)).alias("mi"))


def information_ratio(expression: DataFrame, both: DataFrame, k: int = 3) -> DataFrame:
    """``i_expression, i_both, conditional, ratio``: what places add to what expression tells about a label.

    expression, both: ``i, label, vec`` without and with the coordinates, standardised.
    """
    e, b = mutual_information(expression, k).withColumnRenamed("mi", "i_expression"), mutual_information(both, k).withColumnRenamed("mi", "i_both")
    out = e.crossJoin(b).withColumn("conditional", F.greatest(F.col("i_both") - F.col("i_expression"), F.lit(0.0)))  # one row each
    return out.withColumn("ratio", F.when(F.col("i_expression") > 1e-9, F.col("conditional") / F.col("i_expression")))


def ratio_band(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "undetermined").when(value < RATIO_LOW, "expression-sufficient").when(value <= RATIO_HIGH, "modest-spatial-signal").otherwise("spatial-critical")


def permutation_band(p: Column, z: Column, alpha: float = 0.05) -> Column:
    return F.when(p.isNull() | F.isnan(p), "undetermined").when(p >= alpha, "not_above_null").when(F.coalesce(z, F.lit(0.0)) >= Z_CRITICAL, "spatial-critical").otherwise("modest-spatial-signal")


def gmm_bic(points: DataFrame, columns: list[str], label: str) -> DataFrame:
    """``k, bic``: of a mixture with diagonal variances (1e-6 more) and every row in its own cluster for certain; less is better."""
    d = len(columns)
    c = points.groupBy(label).agg(F.count("*").alias("n"), *[(F.var_pop(x) + 1e-6).alias(f"v{i}") for i, x in enumerate(columns)], *[F.var_pop(x).alias(f"s{i}") for i, x in enumerate(columns)])
    fit = sum((F.log(2 * math.pi * F.col(f"v{i}")) + F.col(f"s{i}") / F.col(f"v{i}") for i in range(d)), F.lit(0.0))
    total = c.withColumn("all", F.sum("n").over(Window.partitionBy()))
    s = total.agg(F.sum(F.col("n") * (F.log(F.col("n") / F.col("all")) - 0.5 * fit)).alias("log_likelihood"), F.count("*").alias("k"), F.max("all").alias("n"))
    return s.select("k", "log_likelihood", (F.log("n") * (2 * F.col("k") * d + F.col("k") - 1) - 2 * F.col("log_likelihood")).alias("bic"))


def main_effects(rows: DataFrame, factors: list[str], value: str) -> DataFrame:
    """``factor, sum_of_squares, share``: type II sums of squares of main effects - what a factor explains beyond all others.

    The model's normal equations come from counts and sums of pairs of levels, so only levels by levels reach the driver.
    """
    levels = {f: sorted(r[0] for r in rows.select(f).distinct().collect()) for f in factors}  # levels, not rows
    at, p = {}, 1
    for f in factors:
        for x in levels[f][1:]:
            at[f, x] = p
            p += 1
    a, b = np.zeros((p, p)), np.zeros(p)
    for f in factors:
        for r in rows.groupBy(f).agg(F.count("*").alias("n"), F.sum(value).alias("s")).collect():
            if (f, r[f]) in at:
                j = at[f, r[f]]
                a[0, j] = a[j, 0] = a[j, j] = r["n"]
                b[j] = r["s"]
    for x, f in enumerate(factors):
        for g in factors[x + 1 :]:
            for r in rows.groupBy(f, g).agg(F.count("*").alias("n")).collect():
                if (f, r[f]) in at and (g, r[g]) in at:
                    i, j = at[f, r[f]], at[g, r[g]]
                    a[i, j] = a[j, i] = r["n"]
    whole = rows.agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")).first()
    a[0, 0], b[0] = whole["n"], whole["s"]
    explained = lambda keep: float(b[keep] @ np.linalg.lstsq(a[np.ix_(keep, keep)], b[keep], rcond=None)[0])
    every = list(range(p))
    total = whole["q"] - whole["s"] ** 2 / whole["n"]
    out = [(f, max(0.0, explained(every) - explained([j for j in every if j not in {at.get((f, x)) for x in levels[f]}]))) for f in factors]
    out.append(("residual", max(0.0, float(whole["q"]) - explained(every))))
    return rows.sparkSession.createDataFrame([(f, s, s / total if total else 0.0) for f, s in out], "factor string, sum_of_squares double, share double")
