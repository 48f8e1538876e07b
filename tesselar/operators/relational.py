"""Joins with a contract, merges with a priority, ranks, and the aligned parts of one annotated matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import saved


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", complete: bool = False) -> DataFrame:
    """A join of tables that hold every key once. Raises where one repeats a key, or (``complete``) lacks one of the other's.

    The checks are aggregations of the keys alone; the join is lazy.
    """
    for name, df in (("left", left), ("right", right)):
        if found := repeated_keys(df, keys).take(1):
            raise ValueError(f"the {name} table repeats the key {[found[0][k] for k in keys]}")
    if complete:
        for a, b in ((left, right), (right, left)):
            if found := a.select(*keys).join(b.select(*keys), keys, "left_anti").take(1):
                raise ValueError(f"only one table has the key {[found[0][k] for k in keys]}")
    return left.join(right, keys, how)


def with_suffixes(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_x", "_y"), how: str = "inner") -> DataFrame:
    """A join in which columns that both tables have besides the keys get a suffix."""
    both = (set(left.columns) & set(right.columns)) - set(keys)
    named = lambda df, end: df.select(*[F.col(c).alias(c + end) if c in both else F.col(c) for c in df.columns])
    return named(left, suffixes[0]).join(named(right, suffixes[1]), keys, how)


def merged_with_override(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both by name, a column that one lacks null there; of equal keys the row of ``other`` counts.

    A key that one table repeats keeps one of its rows.
    """
    both = base.withColumn("_of", F.lit(0)).unionByName(other.withColumn("_of", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_of")))).filter("_n = 1").drop("_n", "_of")


def merged_units(units: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Tables of several units under each other, with the unit's name; a key may stand in one unit only."""
    every = None
    for name in sorted(units):
        one = units[name].withColumn("unit", F.lit(name))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    shared = every.groupBy(*keys).agg(F.countDistinct("unit").alias("n")).filter("n > 1").take(1)
    if shared:
        raise ValueError(f"two units hold the key {[shared[0][k] for k in keys]}")
    return every


def ordered_unique(items: Column) -> Column:
    """The distinct entries of an array in order of their first place, without nulls."""
    return F.array_distinct(F.array_compact(items))


def in_ranked_order(order: Column, front: Column) -> Column:
    """Those entries of ``order`` that ``front`` holds, in that order."""
    return F.filter(order, lambda x: F.array_contains(front, x))


def ordinal_rank(df: DataFrame, value: str, input_order: str, by: str | None = None, name: str = "rank", descending: bool = False) -> DataFrame:
    """Ranks from 1 as a stable sort gives them: ties in the order of input, every rank once."""
    w = Window.partitionBy(by) if by else Window.partitionBy()
    return df.withColumn(name, F.row_number().over(w.orderBy(F.desc(value) if descending else F.asc(value), input_order)))


def spearman_ordinal(df: DataFrame, a: str, b: str, key: str, by: str) -> DataFrame:
    """Correlation of ordinal ranks in each group, 0 where one has no spread."""
    r = ordinal_rank(ordinal_rank(df, a, key, by, "_a"), b, key, by, "_b")
    sd = F.stddev_pop("_a") * F.stddev_pop("_b")
    return r.groupBy(by).agg(F.count("*").alias("n"), F.when(sd > 0, F.covar_pop("_a", "_b") / sd).otherwise(0.0).alias("rho"))


def response(wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean over some columns of all rows of a key; nulls and not-a-numbers are left out."""
    long = wide.select(*keys, F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("v"))
    return long.filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy(*keys).agg(F.avg("v").alias("mean"), F.count("*").alias("n"))


def unpivoted(wide: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return wide.unpivot(keys, columns, name, value)


def annotated(obs: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """All observations, with the columns of the first note on each in order of its columns; null without one."""
    cols = [c for c in notes.columns if c != key]
    one = notes.groupBy(key).agg(F.min(F.struct(*cols)).alias("_n")).select(key, *[F.col(f"_n.{c}").alias(c) for c in cols])
    return obs.join(one, key, "left")


def robust_fractions(sweep: DataFrame, limit: float, rows: str, columns: str, names: list) -> DataFrame:
    """Share of runs at or above a limit, one row for each of ``rows`` and one column for each of ``names``."""
    return sweep.groupBy(rows).pivot(columns, names).agg(F.avg((F.col("score") >= limit).cast("double")))


class Aligned:
    """One annotated matrix: ``obs(obs_id, ...)``, ``var(gene_id, ...)`` and long tables that belong to them.

    expr: ``obs_id, gene_id, value`` and perhaps ``layer``; others: tables by name, with ``obs_id`` or ``gene_id`` or both.
    """

    def __init__(self, obs: DataFrame, var: DataFrame, expr: DataFrame, **others: DataFrame):
        self.obs, self.var, self.expr, self.others = obs, var, expr, others

    def subset_obs(self, keep: Column) -> Aligned:
        """The observations for which ``keep`` is true, in all tables alike."""
        obs = self.obs.filter(keep)
        ids = obs.select("obs_id")
        cut = lambda df: df.join(ids, "obs_id", "left_semi") if "obs_id" in df.columns else df
        return Aligned(obs, self.var, cut(self.expr), **{n: cut(df) for n, df in self.others.items()})

    def subset_var(self, keep: Column) -> Aligned:
        var = self.var.filter(keep)
        ids = var.select("gene_id")
        cut = lambda df: df.join(ids, "gene_id", "left_semi") if "gene_id" in df.columns else df
        return Aligned(self.obs, var, cut(self.expr), **{n: cut(df) for n, df in self.others.items()})

    def layer(self, name: str | None = None) -> DataFrame:
        """The values of a layer, or (None) those of the matrix itself; raises where there is no such layer."""
        if "layer" not in self.expr.columns:
            if name is not None:
                raise KeyError(f"there is no layer {name!r}")
            return self.expr
        found = self.expr.filter(F.col("layer").isNull() if name is None else F.col("layer") == name).drop("layer")
        if name is not None and found.isEmpty():
            raise KeyError(f"there is no layer {name!r}")
        return found


def average_ranks(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """``by, value, name``: of every distinct value its rank in its group, ties averaged; equal values are counted first."""
    n = df.groupBy(by, value).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    return n.select(by, value, (before + (F.col("_n") + 1) / 2.0).alias(name))


def rank_correlation(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """``by, rho``: Spearman's correlation of two columns in each group, ties averaged; 0 where one is constant."""
    d = df.select(by, a, b).join(average_ranks(df, by, a, "_ra"), [by, a]).join(average_ranks(df, by, b, "_rb"), [by, b])
    return d.groupBy(by).agg(F.coalesce(F.try_divide(F.covar_pop("_ra", "_rb"), F.sqrt(F.var_pop("_ra") * F.var_pop("_rb"))), F.lit(0.0)).alias("rho"))


def range_ranks(df: DataFrame, by: list[str], value: str, key: str, name: str, keep: bool = False) -> DataFrame:
    """``df`` with the place (from 1) of each row in its group by value, then key: groups of any size are ranked by many tasks.

    Rows are dealt by ranges of group and value and sorted; a row's place is its place in its task, less where the group
    begins there, plus what the group has in the tasks before, which is a table of a row for each group and task. ``keep``:
    with ``_p``, the number of the row's range, in order of their places.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(df.repartitionByRange(parts, *by, value, key).sortWithinPartitions(*by, value, key).withColumn("_id", F.monotonically_increasing_id()), "ranges")
    dealt = dealt.withColumn("_p", F.shiftright("_id", 33))
    held = dealt.groupBy(*by, "_p").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select(*by, "_p", "_first", before.alias("_before"))
    out = dealt.join(starts, [*by, "_p"]).withColumn(name, F.col("_id") - F.col("_first") + F.col("_before") + 1)
    return out.drop("_id", "_first", "_before", *([] if keep else ["_p"]))
