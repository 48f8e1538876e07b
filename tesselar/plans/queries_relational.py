"""Registered queries of joins, merges, ranks, tests and information, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import erfc_sql
from ..operators import evidence as E
from ..operators import graph, normalize, qc, svg
from ..operators import relational as J
from ..operators import stats as S
from . import adapters as A
from .adapters import knn_sql, with_
from .queries_evidence import MEANS, means
from .queries_matrix import STATS, SYM, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def entry(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@entry("one_to_one_join", "SELECT c_custkey AS k, c_nationkey, s_nationkey FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def one_to_one_join(s, d):
    c, p = A.table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey"), A.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    return J.one_to_one(c, p, ["k"])


@entry("truth_join", "SELECT a.vec_id AS i, a.label AS truth, CASE WHEN b.embedding[3] > 0 THEN 1 ELSE 0 END AS pred FROM embeddings a JOIN embeddings b USING (vec_id)")
def truth_join(s, d):
    """Truth and prediction by observation, both complete and without repeats, or an error."""
    e = A.table(s, d, "embeddings")
    return J.one_to_one(e.select(F.col("vec_id").alias("i"), F.col("label").alias("truth")), e.select(F.col("vec_id").alias("i"), F.when(F.col("embedding")[2] > 0, 1).otherwise(0).alias("pred")), ["i"], "inner", complete=True)


@entry("suffix_join", with_("perf", "a AS (SELECT dataset, config, avg(score) AS score FROM perf WHERE seed <= 3 GROUP BY 1, 2)", "b AS (SELECT dataset, config, avg(score) AS score FROM perf WHERE seed > 3 GROUP BY 1, 2)") + "SELECT dataset, config, round(a.score, 6) AS score_early, round(b.score, 6) AS score_late FROM a JOIN b USING (dataset, config)")
def suffix_join(s, d):
    p = A.perf(s, d)
    part = lambda c: p.filter(c).groupBy("dataset", "config").agg(F.avg("score").alias("score"))
    return rounded(J.with_suffixes(part("seed <= 3"), part("seed > 3"), ["dataset", "config"], ("_early", "_late")), "score_early", "score_late")


@entry("landscape_override", with_("perf", MEANS, "nw AS (SELECT dataset, config, max(score) AS score FROM perf WHERE status = 'R' GROUP BY 1, 2)") + "SELECT dataset, config, round(coalesce(nw.score, means.score), 6) AS score, CASE WHEN nw.score IS NULL THEN means.n END AS n FROM means FULL JOIN nw USING (dataset, config)")
def landscape_override(s, d):
    """Later evidence takes the place of earlier; a column it lacks is null there."""
    new = A.perf(s, d).filter("status = 'R'").groupBy("dataset", "config").agg(F.max("score").alias("score"))
    return rounded(J.merged_with_override(means(s, d).select("dataset", "config", "score", "n"), new, ["dataset", "config"]), "score")


@entry("units_merged", with_("perf", MEANS) + "SELECT r_name AS unit, dataset, config, round(score, 6) AS score FROM means JOIN nation ON dataset = n_name JOIN region ON n_regionkey = r_regionkey")
def units_merged(s, d):
    """Landscapes of one region each, put together again."""
    home = A.table(s, d, "nation").join(A.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("dataset"), "r_name")
    m = means(s, d).select("dataset", "config", "score").join(F.broadcast(home), "dataset")
    regions = [r[0] for r in A.table(s, d, "region").select("r_name").collect()]
    return rounded(J.merged_units({r: m.filter(F.col("r_name") == r).drop("r_name") for r in regions}, ["dataset", "config"]), "score")


@entry("leaderboard_rank", with_("perf", MEANS) + "SELECT dataset, config, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY dataset ORDER BY round(score, 6) DESC, config) AS INTEGER) AS rank FROM means")
def leaderboard_rank(s, d):
    return J.ordinal_rank(rounded(means(s, d).select("dataset", "config", "score"), "score"), "score", "config", "dataset", descending=True)


@entry("spearman_ordinal", with_("perf", MEANS, "r AS (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY round(score, 6), config) AS a, row_number() OVER (PARTITION BY dataset ORDER BY round(secs, 6), config) AS b FROM means)") + "SELECT dataset, count(*) AS n, round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) AS rho FROM r GROUP BY 1")
def spearman_ordinal(s, d):
    return rounded(J.spearman_ordinal(rounded(means(s, d), "score", "secs"), "score", "secs", "config", "dataset"), "rho")


@entry("front_in_ranked_order", with_("perf", MEANS, "o AS (SELECT dataset, list(config ORDER BY round(score, 9) DESC, config) AS ord FROM means GROUP BY 1)", "f AS (SELECT dataset, list(config) AS front FROM means a WHERE NOT EXISTS (SELECT 1 FROM means b WHERE b.dataset = a.dataset AND round(b.score, 9) >= round(a.score, 9) AND round(b.secs, 9) <= round(a.secs, 9) AND (round(b.score, 9) > round(a.score, 9) OR round(b.secs, 9) < round(a.secs, 9))) GROUP BY 1)") + "SELECT dataset, array_to_string(list_filter(ord, lambda c: list_contains(front, c)), ',') AS front FROM o JOIN f USING (dataset)")
def front_in_ranked_order(s, d):
    m = means(s, d).select("dataset", "config", F.round("score", 9).alias("accuracy"), F.round("secs", 9).alias("speed"))
    front = E.pareto_frontier(m, {"accuracy": "max", "speed": "min"}, 0.0, "dataset").groupBy("dataset").agg(F.collect_list("config").alias("f"))
    order = m.groupBy("dataset").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("accuracy")).alias("a"), "config"))), lambda x: x["config"]).alias("o"))
    return order.join(front, "dataset").select("dataset", F.array_join(J.in_ranked_order(F.col("o"), F.col("f")), ",").alias("front"))


@entry("ordered_unique", "SELECT o_custkey AS k, array_to_string(list(s ORDER BY f), ',') AS statuses FROM (SELECT o_custkey, o_orderstatus AS s, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) GROUP BY 1")
def ordered_unique(s, d):
    o = A.table(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]).alias("all"))
    return o.select("k", F.array_join(J.ordered_unique(F.col("all")), ",").alias("statuses"))


@entry("platform_response", with_("perf", "w AS (SELECT dataset, config, avg(score) FILTER (WHERE seed = 1) AS a, avg(score) FILTER (WHERE seed = 2) AS b, avg(score) FILTER (WHERE seed = 3) AS c FROM perf GROUP BY 1, 2)") + "SELECT dataset, round(avg(v), 6) AS mean, count(v) AS n FROM (SELECT dataset, unnest([a, b, c]) AS v FROM w) GROUP BY 1 HAVING count(v) > 0")
def platform_response(s, d):
    w = A.perf(s, d).groupBy("dataset", "config").agg(*[F.avg(F.when(F.col("seed") == n, F.col("score"))).alias(c) for n, c in ((1, "a"), (2, "b"), (3, "c"))])
    return rounded(J.response(w, ["dataset"], ["a", "b", "c"]), "mean")


@entry("unpivot", "SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) AS name, unnest([CAST(l_quantity AS DOUBLE), CAST(l_discount AS DOUBLE), CAST(l_tax AS DOUBLE)]) AS value FROM lineitem")
def unpivot(s, d):
    cols = ["l_quantity", "l_discount", "l_tax"]
    return J.unpivoted(A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double") for c in cols]), ["l_orderkey", "l_linenumber"], cols)


@entry("annotation_join", "SELECT c_custkey, o.o_orderpriority AS priority, o.o_orderstatus AS status FROM customer LEFT JOIN (SELECT o_custkey, o_orderpriority, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus) = 1) o ON c_custkey = o_custkey")
def annotation_join(s, d):
    notes = A.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return J.annotated(A.table(s, d, "customer").select("c_custkey"), notes, "c_custkey")


@entry("robust_fraction_matrix", with_("perf") + "SELECT config, " + ", ".join(f"round(avg(CASE WHEN score >= 0.05 THEN 1.0 ELSE 0 END) FILTER (WHERE seed = {n}), 6) AS s{n}" for n in range(1, 8)) + " FROM perf GROUP BY 1")
def robust_fraction_matrix(s, d):
    out = J.robust_fractions(A.perf(s, d), 0.05, "config", "seed", list(range(1, 8)))
    return rounded(out.select("config", *[F.col(str(n)).alias(f"s{n}") for n in range(1, 8)]), *[f"s{n}" for n in range(1, 8)])


@entry("qc_group_medians", with_("expr", "var", STATS) + "SELECT o_orderstatus AS grp, count(*) AS n, round(median(total), 6) AS total, round(median(n_genes), 6) AS n_genes, round(median(mito_pct), 6) AS mito_pct FROM st JOIN orders ON obs_id = o_orderkey GROUP BY 1")
def qc_group_medians(s, d):
    st = qc.obs_stats(A.expr(s, d), A.var(s, d))
    o = A.table(s, d, "orders").select(F.col("o_orderkey").alias("obs_id"), F.col("o_orderstatus").alias("grp"))
    return rounded(st.join(o, "obs_id").groupBy("grp").agg(F.count("*").alias("n"), F.median("total").alias("total"), F.median("n_genes").alias("n_genes"), F.median("mito_pct").alias("mito_pct")), "total", "n_genes", "mito_pct")


@entry("aligned_subset", "SELECT o_orderstatus AS status, count(DISTINCT o_orderkey) AS observations, count(l_partkey) AS entries, round(sum(l_quantity), 4) AS total FROM orders LEFT JOIN (SELECT l_orderkey, l_partkey, sum(l_quantity) AS l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey AND p_size > 20 GROUP BY 1, 2) ON o_orderkey = l_orderkey WHERE o_totalprice > 100000 GROUP BY 1")
def aligned_subset(s, d):
    """Observations by price and genes by size, all parts of the matrix alike."""
    obs = A.table(s, d, "orders").select(F.col("o_orderkey").alias("obs_id"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    var = A.table(s, d, "part").select(F.col("p_partkey").alias("gene_id"), "p_size")
    t = J.Aligned(obs, var, A.expr(s, d)).subset_obs(F.col("o_totalprice") > 100000).subset_var(F.col("p_size") > 20)
    j = t.obs.join(t.layer(), "obs_id", "left")
    return rounded(j.groupBy("status").agg(F.countDistinct("obs_id").alias("observations"), F.count("gene_id").alias("entries"), F.sum("value").alias("total")), "total", dp=4)


@entry("layer_selection", "SELECT l_orderkey AS obs_id, l_partkey AS gene_id, round(sqrt(sum(l_quantity)), 6) AS value FROM lineitem GROUP BY 1, 2")
def layer_selection(s, d):
    e = A.expr(s, d)
    layers = e.withColumn("layer", F.lit(None).cast("string")).unionByName(normalize.sqrt_transform(e).withColumn("layer", F.lit("sqrt")))
    o = A.table(s, d, "orders").select(F.col("o_orderkey").alias("obs_id"))
    return rounded(J.Aligned(o, A.var(s, d), layers).layer("sqrt").select("obs_id", "gene_id", "value"), "value")


SIGNED = """df AS (SELECT a.config AS a, b.config AS b, round(a.score - b.score, 9) AS d FROM means a JOIN means b ON a.dataset = b.dataset AND a.config < b.config),
rk AS (SELECT a, b, d, count(*) OVER (PARTITION BY a, b, abs(d)) AS t, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2.0 AS r FROM df WHERE d <> 0),
sm AS (SELECT a, b, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w, sum(t * t - 1) AS ties FROM rk GROUP BY 1, 2),
zz AS (SELECT a, b, w, abs(w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) / sqrt(2.0) AS x FROM sm),
al AS (SELECT a, b, count(*) AS n_pairs, avg(d) AS mean_difference, median(d) AS median_difference FROM df GROUP BY 1, 2)"""


@entry("signed_rank_test", with_("perf", MEANS, SIGNED) + "SELECT a, b, n_pairs, round(mean_difference, 6) AS mean_difference, round(median_difference, 6) AS median_difference, round(w, 4) AS w, round(least(1, " + erfc_sql("x") + "), 5) AS p_value FROM al JOIN zz USING (a, b)")
def signed_rank_test(s, d):
    """All pairs of configurations by the normal approximation, which SQL can follow; the exact test is in the tests."""
    m = means(s, d)
    one, two = m.select("dataset", F.col("config").alias("a"), F.col("score").alias("sa")), m.select("dataset", F.col("config").alias("b"), F.col("score").alias("sb"))
    pairs = one.join(two, "dataset").filter("a < b").select("a", "b", F.round(F.col("sa") - F.col("sb"), 9).alias("d"))
    out = S.signed_rank(pairs, ["a", "b"], exact=False)
    return rounded(rounded(rounded(out, "mean_difference", "median_difference"), "w", dp=4), "p_value", dp=5)


IMP = "im AS (SELECT dataset, config, CASE WHEN config LIKE '%1' THEN NULL ELSE score END AS a, secs AS b FROM means)"


@entry("impute_and_standardize", with_("perf", MEANS, IMP, "md AS (SELECT median(a) AS ma, median(b) AS mb FROM im)", "fl AS (SELECT dataset, config, coalesce(a, ma) AS a, coalesce(b, mb) AS b FROM im, md)") + "SELECT dataset, config, round((a - avg(a) OVER ()) / stddev_pop(a) OVER (), 5) AS a, round((b - avg(b) OVER ()) / stddev_pop(b) OVER (), 5) AS b FROM fl")
def impute_and_standardize(s, d):
    im = means(s, d).select("dataset", "config", F.when(~F.col("config").endswith("1"), F.col("score")).alias("a"), F.col("secs").alias("b"))
    return rounded(S.imputed(im, ["a", "b"]), "a", "b", dp=5)


def _psi(x: str) -> str:
    f = f"(1.0 / (({x} + 6.0) * ({x} + 6.0)))"
    return f"(ln({x} + 6.0) - 0.5 / ({x} + 6.0) - {f} * (1.0 / 12 - {f} * (1.0 / 120 - {f} * (1.0 / 252 - {f} / 240.0)))" + "".join(f" - 1.0 / ({x} + {i}.0)" for i in range(6)) + ")"


def _mi(name: str, vec: str, k: int = 3) -> str:
    """The estimate's SQL, over all pairs."""
    far = f"list_max(list_transform(range(1, len(a.{vec}) + 1), lambda g: abs(a.{vec}[g] - b.{vec}[g])))"
    return f"""{name}d AS (SELECT a.i, a.label AS la, b.i AS j, b.label AS lb, {far} AS d FROM vv a JOIN vv b ON a.i <> b.i),
{name}k AS (SELECT i, la, max(d) AS d, count(*) AS lk FROM (SELECT * FROM {name}d WHERE la = lb QUALIFY row_number() OVER (PARTITION BY i ORDER BY d) <= {k}) GROUP BY 1, 2),
{name}m AS (SELECT a.i, a.la, any_value(a.lk) AS lk, greatest(count(*) FILTER (WHERE b.d <= a.d), 1) AS m FROM {name}k a JOIN {name}d b ON a.i = b.i GROUP BY 1, 2),
{name} AS (SELECT greatest(sum({_psi('n.al')} - {_psi('n.n')} + {_psi('lk')} - {_psi('m')}) / any_value(n.al), 0) AS mi FROM {name}m JOIN (SELECT label, count(*) AS n, (SELECT count(*) FROM vv) AS al FROM vv GROUP BY 1) n ON la = label)"""


def _labelled(s, d):
    e = A.table(s, d, "embeddings")
    take = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: x.cast("double"))
    return e.select(F.col("vec_id").alias("i"), F.col("label").cast("long").alias("label"), take(3, 3).alias("e"), take(1, 5).alias("b"))


@entry("information_ratio", with_("vv AS (SELECT vec_id AS i, CAST(label AS BIGINT) AS label, list_transform(range(3, 6), lambda g: CAST(embedding[g] AS DOUBLE)) AS e, list_transform(range(1, 6), lambda g: CAST(embedding[g] AS DOUBLE)) AS b FROM embeddings)", _mi("me", "e"), _mi("mb", "b")) + "SELECT round(me.mi, 6) AS i_expression, round(mb.mi, 6) AS i_both, round(greatest(mb.mi - me.mi, 0), 6) AS conditional, round(CASE WHEN me.mi > 1e-9 THEN greatest(mb.mi - me.mi, 0) / me.mi END, 4) AS ratio, CASE WHEN me.mi <= 1e-9 THEN 'undetermined' WHEN greatest(mb.mi - me.mi, 0) / me.mi < 0.1 THEN 'expression-sufficient' WHEN greatest(mb.mi - me.mi, 0) / me.mi <= 0.3 THEN 'modest-spatial-signal' ELSE 'spatial-critical' END AS band FROM me, mb")
def information_ratio(s, d):
    """What two coordinates add to three components, by nearest neighbours among all rows."""
    v = _labelled(s, d)
    out = S.information_ratio(v.select("i", "label", F.col("e").alias("vec")), v.select("i", "label", F.col("b").alias("vec")))
    return rounded(rounded(out.withColumn("band", S.ratio_band(F.col("ratio"))), "i_expression", "i_both", "conditional"), "ratio", dp=4)


@entry("information_bands", "SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'undetermined' WHEN value / 100 < 0.1 THEN 'expression-sufficient' WHEN value / 100 <= 0.3 THEN 'modest-spatial-signal' ELSE 'spatial-critical' END AS band, CASE WHEN event_id % 17 = 0 THEN 'undetermined' WHEN value / 100 >= 0.05 THEN 'not_above_null' WHEN event_id % 5 >= 3 THEN 'spatial-critical' ELSE 'modest-spatial-signal' END AS permutation_band FROM events")
def information_bands(s, d):
    v = F.when(F.col("event_id") % 17 != 0, F.col("value") / 100)
    return A.table(s, d, "events").select("event_id", S.ratio_band(v).alias("band"), S.permutation_band(v, (F.col("event_id") % 5).cast("double")).alias("permutation_band"))


@entry("mixture_bic", with_("pts", "c AS (SELECT label, count(*) AS n, var_pop(x) AS sx, var_pop(y) AS sy FROM pts GROUP BY 1)", "l AS (SELECT count(*) AS k, sum(n) AS al, sum(n * (ln(n / (SELECT count(*) FROM pts)::DOUBLE) - 0.5 * (ln(2 * pi() * (sx + 1e-6)) + sx / (sx + 1e-6) + ln(2 * pi() * (sy + 1e-6)) + sy / (sy + 1e-6)))) AS ll FROM c)") + "SELECT k, round(ll, 4) AS log_likelihood, round(ln(al) * (4 * k + k - 1) - 2 * ll, 4) AS bic FROM l")
def mixture_bic(s, d):
    return rounded(S.gmm_bic(A.points(s, d), ["x", "y"], "label"), "log_likelihood", "bic", dp=4)


@entry("variance_shares")
def variance_shares(s, d):
    """Normal equations are solved on the driver; in the tests against a least-squares loop."""
    return rounded(rounded(S.main_effects(A.perf(s, d).withColumn("score", F.col("score").cast("double")), ["dataset", "config", "seed", "status"], "score"), "sum_of_squares", dp=4), "share")


MORAN = "tg AS (SELECT gene FROM cnt GROUP BY 1 ORDER BY round(var_pop(v), 9) DESC, gene LIMIT 10), mo AS (SELECT gene, avg(v) AS m, count(*) AS n, var_pop(v) * count(*) AS ss FROM cnt JOIN tg USING (gene) GROUP BY 1), nu AS (SELECT a.gene, sum((a.v - m) * (b.v - m)) AS num FROM sym JOIN cnt a ON sym.i = a.i JOIN cnt b ON sym.j = b.i AND a.gene = b.gene JOIN mo ON a.gene = mo.gene GROUP BY 1)"


@entry("top_gene_autocorrelation", with_("pts", "val", "cnt", knn_sql(6), SYM, MORAN) + "SELECT round(avg(n / (SELECT count(*) FROM sym)::DOUBLE * num / (ss + 1e-12)), 6) AS spatial_autocorrelation FROM nu JOIN mo USING (gene)")
def top_gene_autocorrelation(s, d):
    from ..operators.features import top_variance_genes

    v = A.counts(s, d)
    some = v.join(F.broadcast(top_variance_genes(v, 10).select("gene")), "gene")
    return rounded(svg.morans_i(some, graph.knn(A.points(s, d), 6), 6).agg(F.avg("morans_i").alias("spatial_autocorrelation")), "spatial_autocorrelation")


@entry("top_spatial_genes", with_("pts", "val", "cnt", knn_sql(6), "z AS (SELECT i, gene, (ln(1 + v) - avg(ln(1 + v)) OVER (PARTITION BY gene)) / stddev_pop(ln(1 + v)) OVER (PARTITION BY gene) AS v FROM cnt)", "l AS (SELECT k.i, a.gene, (any_value(a.v) + sum(b.v)) / 7 AS l FROM knn k JOIN z a ON k.i = a.i JOIN z b ON k.j = b.i AND a.gene = b.gene GROUP BY 1, 2)", "sc AS (SELECT gene, round(avg(l * l), 6) AS score FROM l GROUP BY 1)") + "SELECT gene, score, CAST(row_number() OVER (ORDER BY score DESC, gene) AS INTEGER) AS rank FROM sc ORDER BY score DESC, gene LIMIT 20")
def top_spatial_genes(s, d):
    return svg.top_genes(rounded(svg.hotspot(A.counts(s, d), graph.knn(A.points(s, d), 6)), "score"), 20)


@entry("bootstrap_bounds", with_("perf", MEANS, "dr AS (SELECT b, config, dataset, score, ascii(left(md5(b || ':' || dataset), 1)) % 4 AS t FROM means, (SELECT unnest(range(1, 33)) AS b))", "mb AS (SELECT config, b, sum(t * score) / nullif(sum(t), 0) AS m FROM dr GROUP BY 1, 2)", "ci AS (SELECT config, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM mb GROUP BY 1)") + "SELECT round(avg(lo), 6) AS lower, round(avg(hi), 6) AS upper, count(*) AS configs FROM ci")
def bootstrap_bounds(s, d):
    """Mean over configurations of the bounds of each; a data set's weight in a draw comes from a hash."""
    t = F.ascii(F.left(F.md5(F.concat_ws(":", "b", "dataset").cast("binary")), F.lit(1))) % 4
    dr = means(s, d).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(32)))).withColumn("t", t)
    mb = dr.groupBy("config", "b").agg((F.sum(F.col("t") * F.col("score")) / F.nullif(F.sum("t"), F.lit(0))).alias("m"))
    ci = mb.groupBy("config").agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
    return rounded(ci.agg(F.avg("lo").alias("lower"), F.avg("hi").alias("upper"), F.count("*").alias("configs")), "lower", "upper")


@entry("r_lognorm", with_("expr") + "SELECT obs_id, gene_id, round(ln(1 + value * 10000 / sum(value) OVER (PARTITION BY obs_id)), 6) AS value FROM expr")
def r_lognorm(s, d):
    return rounded(normalize.log1p_cp10k(A.expr(s, d)), "value")
