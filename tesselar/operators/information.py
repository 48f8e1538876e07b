"""What places tell about labels beyond expression: many estimates in one search, a null of shuffled places, gains foretold.

``rows(g, i, label, vec)`` holds any number of groups (slices, shuffles); the neighbours of all of them are sought by the
same cells, so a null of many draws is one job and not a loop.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import saved
from .nearest import Search
from .stats import Z_CRITICAL, digamma, permutation_band

#: Information below which a ratio to it says nothing, and deviations below which a null is constant; fixed values.
NO_INFORMATION, NO_SPREAD = 1e-9, 1e-12
#: Slices from which a correlation is taken for informative; fixed value.
MIN_SLICES = 8


def information(rows: DataFrame, k: int = 3, cell: int | None = None) -> DataFrame:
    """``g, mi``: of every group the information in nats between label and vector, by nearest neighbours, as
    ``stats.mutual_information`` has it for one. ``cell``: rows of a cell, about; it changes no result."""
    counts = saved(rows.groupBy("g", "label").agg(F.count("*").alias("n")), "label_counts")
    size, labels, groups = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_distinct("g")).first()
    search = Search(rows, k, size, groups, labels, cell)
    total = counts.groupBy("g").agg(F.sum("n").alias("all"))
    terms = search.within(search.kth()).join(counts, ["g", "label"]).join(total, "g")
    each = digamma(F.col("all")) - digamma(F.col("n")) + digamma(F.col("local_k")) - digamma(F.greatest("m", F.lit(1)))
    found = terms.groupBy("g").agg(F.greatest(F.sum(each) / F.max("all"), F.lit(0.0)).alias("mi"))
    return total.select("g").join(found, "g", "left").select("g", F.coalesce("mi", F.lit(0.0)).alias("mi"))


def ratios(rows: DataFrame, k: int = 3) -> DataFrame:
    """``g, i_expression, i_both, conditional, ratio`` from ``rows(g, i, label, places, expression)``."""
    vec = lambda c: rows.select("g", "i", "label", c.alias("vec"))
    e = information(vec(F.col("expression")), k).withColumnRenamed("mi", "i_expression")
    b = information(vec(F.concat("places", "expression")), k).withColumnRenamed("mi", "i_both")
    out = e.join(b, "g").withColumn("conditional", F.greatest(F.col("i_both") - F.col("i_expression"), F.lit(0.0)))
    return out.withColumn("ratio", F.when(F.col("i_expression") > NO_INFORMATION, F.col("conditional") / F.col("i_expression")))


def shuffled_places(rows: DataFrame, draws: int) -> DataFrame:
    """``rows`` without g for draw 0, and for each draw with the places of another row: the order of a hash against that of the
    ids. Narrow rows, those of one draw in one task each."""
    d = rows.withColumn("g", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    own = d.select("g", "i", "label", "expression", F.row_number().over(Window.partitionBy("g").orderBy("i")).alias("r"))
    other = d.select("g", "places", F.row_number().over(Window.partitionBy("g").orderBy(F.md5(F.concat_ws(":", "g", "i")), "i")).alias("r"))
    drawn = own.join(other, ["g", "r"]).drop("r")
    return rows.select(F.lit(0).alias("g"), "i", "label", "places", "expression").unionByName(drawn.select("g", "i", "label", "places", "expression")).withColumn("g", F.col("g").cast("long"))


def _z(observed: Column, mean: Column, sd: Column) -> Column:
    plain = F.when(observed > mean + NO_SPREAD, float("inf")).when(observed < mean - NO_SPREAD, float("-inf")).otherwise(0.0)
    return F.when(sd.isNull(), None).when(sd < NO_SPREAD, plain).otherwise((observed - mean) / sd)


def permutation_null(rows: DataFrame, draws: int = 19, k: int = 3, alpha: float = 0.05) -> DataFrame:
    """One row: the ratio and the residual information of ``rows(i, label, places, expression)`` against those of shuffled places.

    Empirical p values count the observed draw; the thresholds are the null ratios' quantile and their mean plus
    ``Z_CRITICAL`` deviations. The band follows the residual information, which is defined where the ratio is not.
    """
    every = information(shuffled_places(rows, draws).select("g", "i", "label", F.concat("places", "expression").alias("vec")), k)
    base = information(rows.select(F.lit(0).cast("long").alias("g"), "i", "label", F.col("expression").alias("vec")), k).select(F.col("mi").alias("i_expression"))
    d = every.crossJoin(F.broadcast(base)).withColumn("conditional", F.round(F.greatest(F.col("mi") - F.col("i_expression"), F.lit(0.0)), 12))
    d = d.withColumn("ratio", F.when(F.col("i_expression") > NO_INFORMATION, F.col("conditional") / F.col("i_expression")))
    null = F.col("g") > 0
    here = d.filter("g = 0").select("i_expression", F.col("mi").alias("i_both"), F.col("conditional").alias("o"), F.col("ratio").alias("r"))
    stats = d.crossJoin(F.broadcast(here.select("o", "r"))).agg(
        F.count_if(null).alias("n_null"), *[f(F.when(null, F.col(c))).alias(f"{n}_{c}") for c in ("conditional", "ratio") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))],
        ((F.count_if(null & (F.col("conditional") >= F.col("o"))) + 1.0) / (F.count_if(null) + 1)).alias("p_conditional"), ((F.count_if(null & (F.col("ratio") >= F.col("r"))) + 1.0) / (F.count_if(null & F.col("ratio").isNotNull()) + 1)).alias("p_ratio"),
        F.percentile(F.when(null, F.col("ratio")), 1 - alpha).alias("threshold_significant"),
    )
    z = _z(F.col("o"), F.col("mean_conditional"), F.col("sd_conditional"))
    out = here.crossJoin(stats).withColumns({"z_conditional": z, "z_ratio": _z(F.col("r"), F.col("mean_ratio"), F.col("sd_ratio"))})
    return out.select(
        "i_expression", "i_both", F.col("o").alias("conditional"), F.col("r").alias("ratio"), "n_null", "mean_conditional", "sd_conditional", "mean_ratio", "sd_ratio", "p_conditional", F.when(F.col("r").isNotNull(), F.col("p_ratio")).alias("p_ratio"), "z_conditional", "z_ratio",
        (F.col("p_conditional") < alpha).alias("significant"), "threshold_significant", (F.col("mean_ratio") + Z_CRITICAL * F.col("sd_ratio")).alias("threshold_critical"), permutation_band(F.col("p_conditional"), F.col("z_conditional"), alpha).alias("band"),
    )


def spatial_gains(perf: DataFrame, baseline: str = "@sw0.0") -> DataFrame:
    """``dataset, gain``: the mean over methods of their best score under a spatial weight less that without one.

    Configurations are named ``method@weight``; a method without baseline, or with nothing else, takes no part.
    """
    m = perf.filter(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("dataset", "config").agg(F.avg("score").alias("score"))
    m = m.withColumn("method", F.substring_index("config", "@", 1))
    own = F.col("config") == F.concat("method", F.lit(baseline))
    per = m.groupBy("dataset", "method").agg(F.max(F.when(own, F.col("score"))).alias("none"), F.max(F.when(~F.col("config").endswith(baseline), F.col("score"))).alias("best"))
    return per.filter("none is not null and best is not null").groupBy("dataset").agg(F.avg(F.col("best") - F.col("none")).alias("gain"))


def student_tail(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with whole degrees of freedom, by its finite series."""
    theta = F.atan(F.try_divide(F.abs(t), F.sqrt(df)))
    c2 = F.cos(theta) * F.cos(theta)
    odd = df % 2 == 1
    # Terms of the series are products of ratios: (2j)/(2j+1) for odd, (2j-1)/(2j) for even degrees of freedom.
    count = F.when(odd, F.floor((df - 1) / 2) - 1).otherwise(F.floor(df / 2) - 1)
    none = F.array().cast("array<int>")
    steps = F.when(count >= 1, F.sequence(F.lit(1), F.greatest(count, F.lit(1)).cast("int"))).otherwise(none)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] * c2 * F.when(odd, 2.0 * j / (2.0 * j + 1)).otherwise((2.0 * j - 1) / (2.0 * j))
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = F.aggregate(steps, start, step, lambda s: s["sum"])
    inner = F.when(odd, 2 / math.pi * (theta + F.when(df > 1, F.sin(theta) * F.cos(theta) * series).otherwise(0.0))).otherwise(F.sin(theta) * series)
    return F.greatest(1 - inner, F.lit(0.0))


def _ranked(pairs: DataFrame) -> DataFrame:
    """Both columns' ranks, ties averaged: as many rows as there are slices."""
    whole = Window.partitionBy(F.lit(0))
    rank = lambda c: F.rank().over(whole.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0
    return pairs.withColumns({"rx": rank("x"), "ry": rank("y")})


def finite_pairs(records: DataFrame, x: str = "ratio", y: str = "gain") -> DataFrame:
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) < float("inf"))
    return records.filter(ok(x) & ok(y)).select("dataset", F.round(F.col(x).cast("double"), 9).alias("x"), F.round(F.col(y).cast("double"), 9).alias("y"))


def predictor(records: DataFrame, alpha: float = 0.05, min_slices: int = MIN_SLICES) -> DataFrame:
    """One row: whether the ratio follows the gain over slices - ``n_slices, rho, p, status, reasons``.

    supported: significant, positive and over enough slices; underpowered: too few; failed; undefined: fewer than two, or a
    constant on either side.
    """
    r = _ranked(finite_pairs(records)).agg(F.count("*").alias("n_slices"), F.count_distinct("x").alias("ux"), F.count_distinct("y").alias("uy"), F.try_divide(F.covar_pop("rx", "ry"), F.sqrt(F.var_pop("rx") * F.var_pop("ry"))).alias("rho"))
    constant = (F.col("ux") < 2) | (F.col("uy") < 2)
    n, rho = F.col("n_slices"), F.when((F.col("n_slices") >= 2) & ~constant, F.round("rho", 12))
    df = (n - 2).cast("double")
    p = F.when(rho.isNotNull() & (n > 2), F.when(F.abs(rho) >= 1, 0.0).otherwise(student_tail(rho * F.sqrt(F.try_divide(df, 1 - rho * rho)), df)))
    r = r.withColumns({"rho": rho, "p": p})
    few = n < min_slices
    status = F.when(F.col("rho").isNull() | F.col("p").isNull(), "undefined").when(few, "underpowered").when((F.col("rho") > 0) & (F.col("p") < alpha), "supported").otherwise("failed")
    alone = F.when(n < 2, "fewer_than_two_finite_pairs").when(constant, "zero_variance_in_ratio_or_gain")
    listed = F.array_compact(F.array(F.when(few, "sample_size_below_minimum"), F.when(F.col("p").isNull(), "correlation_undefined"), F.when(F.col("p").isNotNull() & (F.col("rho") <= 0), "correlation_nonpositive"), F.when(F.col("p") >= alpha, "correlation_not_significant")))
    return r.select("n_slices", "rho", "p", status.alias("status"), F.when(alone.isNotNull(), alone).otherwise(F.array_join(listed, ",")).alias("reasons"))


def gain_calibration(records: DataFrame, alpha: float = 0.05, min_slices: int = MIN_SLICES) -> DataFrame:
    """One row: the line from ratio to gain, its fit, the error when a slice is left out, and how far it may be relied on.

    Left-out errors are the residuals over one less their leverage, so no line is fitted twice.
    """
    p = finite_pairs(records)
    s = p.agg(F.count("*").alias("n_slices"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cxy"))
    s = s.withColumn("slope", F.when(F.col("n_slices") >= 2, F.when(F.col("n_slices") * F.col("vx") >= NO_SPREAD, F.try_divide("cxy", "vx")).otherwise(0.0)))
    s = s.withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    e = p.crossJoin(F.broadcast(s)).withColumn("e", F.col("y") - F.col("intercept") - F.col("slope") * F.col("x"))
    n = F.col("n_slices")
    off = F.col("x") - F.col("mx")
    rest_x = n * F.col("vx") - F.try_divide(off * off * n, n - 1)  # squares about the mean of the others
    leverage = 1 / n + F.coalesce(F.try_divide(off * off, n * F.col("vx")), F.lit(0.0))
    # Without a slice the others may have one ratio only: then their mean foretells it.
    alone = F.when(rest_x <= NO_SPREAD * (n - 1), F.try_divide((F.col("y") - F.col("my")) * n, n - 1)).otherwise(F.try_divide(F.col("e"), 1 - leverage))
    errors = e.agg(F.sum(F.col("e") * F.col("e")).alias("ss"), F.avg(F.when(n >= 3, alone * alone)).alias("loo"))
    q = predictor(records, alpha, min_slices).select("rho", "p", "status")
    reliability = F.when(F.col("status") == "supported", "moderate").when(F.col("status") == "underpowered", "low").when(F.col("status") == "failed", "unsupported").otherwise("undefined")
    flat = n * F.col("vx") < NO_SPREAD
    residual = F.when(n >= 2, F.sqrt(F.col("ss") / F.greatest(n - F.when(flat, 1).otherwise(2), F.lit(1))))
    return s.crossJoin(errors).crossJoin(q).select(
        "n_slices", "slope", "intercept", residual.alias("residual_std"), F.when(n >= 2, F.coalesce(F.sqrt("loo"), residual)).alias("loo_rmse"),
        F.when(n >= 2, F.when(~flat & (n * F.col("vy") > NO_SPREAD), 1 - F.try_divide(F.col("ss"), n * F.col("vy"))).otherwise(0.0)).alias("r_squared"), "rho", "p", "status", F.when(n < 2, "undefined").otherwise(reliability).alias("reliability"),
    )


def expected_gains(ratios_: DataFrame, calibration: DataFrame, z: float = 1.96) -> DataFrame:
    """Of every data set the gain that its ratio leads to expect, with bounds by the error of left-out slices."""
    c = F.broadcast(calibration.select("slope", "intercept", "loo_rmse", "reliability"))
    known = F.col("ratio").isNotNull() & ~F.isnan("ratio") & F.col("slope").isNotNull()
    d = ratios_.select("dataset", "ratio").crossJoin(c).withColumn("gain", F.when(known, F.col("intercept") + F.col("slope") * F.round("ratio", 9)))
    return d.select("dataset", "ratio", F.col("gain").alias("expected"), (F.col("gain") - z * F.col("loo_rmse")).alias("low"), (F.col("gain") + z * F.col("loo_rmse")).alias("high"), F.when(known, F.col("reliability")).otherwise("undefined").alias("reliability"))
