"""Agreement of labels, cluster validity and marker genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import choose2, ratio
from ..plans.tables import saved
from .graph import positive_scale


def contingency(df: DataFrame, truth: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    """From a contingency table; 1 where there is no pair, or only one way to pair."""
    ij = table.agg(F.sum(choose2(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    a = table.groupBy("truth").agg(F.sum("n").alias("n")).agg(F.sum(choose2(F.col("n"))).alias("a"))
    b = table.groupBy("pred").agg(F.sum("n").alias("n")).agg(F.sum(choose2(F.col("n"))).alias("b"))
    total = choose2(F.col("n"))
    expected = F.col("a") * F.col("b") / total
    most = (F.col("a") + F.col("b")) / 2
    return ij.crossJoin(a).crossJoin(b).select(F.when((total == 0) | (most == expected), 1.0).otherwise((F.col("ij") - expected) / (most - expected)).alias("ari"))


def normalized_mutual_information(table: DataFrame) -> DataFrame:
    """Mutual information over the mean of the entropies; 1 where both are 0."""
    w = Window.partitionBy()
    s = table.withColumn("t", F.sum("n").over(Window.partitionBy("truth"))).withColumn("p", F.sum("n").over(Window.partitionBy("pred"))).withColumn("all", F.sum("n").over(w))
    share = F.col("n") / F.col("all")
    out = s.agg(F.sum(share * F.log(F.col("n") * F.col("all") / (F.col("t") * F.col("p")))).alias("mi"), (-F.sum(share * F.log(F.col("t") / F.col("all")))).alias("ht"), (-F.sum(share * F.log(F.col("p") / F.col("all")))).alias("hp"))
    return out.select(F.when(F.col("ht") + F.col("hp") > 0, 2 * F.col("mi") / (F.col("ht") + F.col("hp"))).otherwise(1.0).alias("nmi"))


def per_class(table: DataFrame) -> DataFrame:
    """``class, precision, recall, f1, support`` for every true class."""
    t = table.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    p = table.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("called"))
    j = t.join(p, "class", "left")
    precision, recall = ratio(F.col("hit"), F.coalesce("called", F.lit(0))), ratio(F.col("hit"), F.col("support"))
    return j.select("class", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), "support")


def macro_scores(table: DataFrame) -> DataFrame:
    return per_class(table).agg(F.avg("f1").alias("macro_f1"), F.avg("recall").alias("balanced_accuracy"))


def average_precision(df: DataFrame, score: str, positive: str, by: str | None = None) -> DataFrame:
    """Area under precision by recall, equal scores taken together."""
    keys = [by] if by else []
    g = df.groupBy(*keys, score).agg(F.sum(F.when(F.col(positive), 1).otherwise(0)).alias("tp"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    p = g.withColumn("ctp", F.sum("tp").over(w)).withColumn("cn", F.sum("n").over(w))
    return p.groupBy(*keys).agg(ratio(F.sum(F.col("tp") * F.col("ctp") / F.col("cn")), F.sum("tp").cast("double")).alias("average_precision"))


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Rank-sum form with averaged ties: counts of equal scores are enough."""
    g = df.groupBy(score).agg(F.sum(F.when(F.col(positive), 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
    w = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    r = g.withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2.0)
    np_, nn = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    return r.agg(F.when((np_ > 0) & (nn > 0), (F.sum(F.col("p") * F.col("rank")) - np_ * (np_ + 1) / 2.0) / (np_ * nn)).alias("auc"))


def centroids(points: DataFrame, label: str = "label") -> DataFrame:
    return points.groupBy(F.col(label).alias("c")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"))


def calinski_harabasz(points: DataFrame, label: str = "label") -> DataFrame:
    c = centroids(points, label)
    w = points.join(F.broadcast(c), F.col(label) == F.col("c"))
    d2 = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    within = w.agg(F.sum(d2).alias("within"), F.count("*").alias("n"), (F.var_pop("x") * F.count("*") + F.var_pop("y") * F.count("*")).alias("total"))
    k = c.agg(F.count("*").alias("k"))
    between = F.col("total") - F.col("within")
    return within.crossJoin(k).select(((between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("ch"))


def davies_bouldin(points: DataFrame, label: str = "label") -> DataFrame:
    """Mean over clusters of the worst ratio of spreads to distance; clusters are few, their pairs are formed."""
    c = centroids(points, label)
    d = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")))
    s = points.join(F.broadcast(c), F.col(label) == F.col("c")).groupBy("c").agg(F.avg(d).alias("s"), F.first("cx").alias("cx"), F.first("cy").alias("cy"))
    o = F.broadcast(s.select(F.col("c").alias("c2"), F.col("s").alias("s2"), F.col("cx").alias("cx2"), F.col("cy").alias("cy2")))
    gap = F.sqrt((F.col("cx") - F.col("cx2")) * (F.col("cx") - F.col("cx2")) + (F.col("cy") - F.col("cy2")) * (F.col("cy") - F.col("cy2")))
    worst = s.join(o, F.col("c") != F.col("c2")).groupBy("c").agg(F.max((F.col("s") + F.col("s2")) / gap).alias("r"))
    return worst.agg(F.avg("r").alias("db"))


def silhouette_simplified(points: DataFrame, label: str = "label") -> DataFrame:
    """Silhouette by distances to centroids: linear in the points, unlike the mean over all pairs."""
    c = F.broadcast(centroids(points, label).drop("n"))
    d = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")))
    p = points.crossJoin(c).withColumn("d", d).groupBy("i").agg(F.max(F.when(F.col(label) == F.col("c"), F.col("d"))).alias("a"), F.min(F.when(F.col(label) != F.col("c"), F.col("d"))).alias("b"))
    m = F.greatest("a", "b")
    return p.agg(F.avg(F.when(m > 0, (F.col("b") - F.col("a")) / m).otherwise(0.0)).alias("silhouette"))


def spatial_kappa(edges: DataFrame, points: DataFrame, label: str = "label") -> DataFrame:
    """Agreement of neighbours' labels beyond chance."""
    l = points.select("i", F.col(label).alias("l"))
    obs = edges.join(l, "i").join(l.toDF("j", "l2"), "j").agg(F.avg(F.when(F.col("l") == F.col("l2"), 1.0).otherwise(0.0)).alias("po"))
    f = l.groupBy("l").agg(F.count("*").alias("n")).withColumn("f", F.col("n") / F.sum("n").over(Window.partitionBy())).agg(F.sum(F.col("f") * F.col("f")).alias("pe"))
    return obs.crossJoin(f).select(((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def neighbour_entropy(edges: DataFrame, points: DataFrame, label: str = "label") -> DataFrame:
    """Entropy in bits of the labels around each point: its boundary uncertainty."""
    l = points.select(F.col("i").alias("j"), F.col(label).alias("l"))
    c = edges.join(l, "j").groupBy("i", "l").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("i")))
    return c.groupBy("i").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def boundary_f1(edges: DataFrame, points: DataFrame, truth: str = "label", pred: str = "pred") -> DataFrame:
    """F1 of the edges that cross a predicted border against those that cross a true one."""
    t = points.select("i", F.col(truth).alias("t"), F.col(pred).alias("p"))
    e = edges.join(t, "i").join(t.toDF("j", "t2", "p2"), "j").select((F.col("t") != F.col("t2")).alias("a"), (F.col("p") != F.col("p2")).alias("b"))
    tp, fp, fn = F.count_if(F.col("a") & F.col("b")), F.count_if(~F.col("a") & F.col("b")), F.count_if(F.col("a") & ~F.col("b"))
    return e.agg(ratio(2.0 * tp, (2 * tp + fp + fn).cast("double")).alias("boundary_f1"))


def top_markers(v: DataFrame, labels: DataFrame, n: int = 2) -> DataFrame:
    """Per label the genes whose mean inside exceeds that outside most; sums are taken once."""
    g = v.join(labels, "i").groupBy("l", "gene").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("gene")
    rest_n = F.sum("n").over(w) - F.col("n")
    diff = F.col("s") / F.col("n") - F.when(rest_n > 0, (F.sum("s").over(w) - F.col("s")) / rest_n).otherwise(0.0)
    out = g.withColumn("diff", diff)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("l").orderBy(F.desc(F.round("diff", 9)), "gene"))).filter(F.col("rank") <= n).select("l", "gene", "diff", "rank")


def resolve_markers(markers: DataFrame, var: DataFrame) -> DataFrame:
    """``label, seq, alias`` matched to genes by name, else by a case-folded name that only one gene has."""
    exact = var.groupBy(F.col("feature_name").alias("alias")).agg(F.min("gene_id").alias("exact"))
    folded = var.groupBy(F.lower("feature_name").alias("low")).agg(F.min("gene_id").alias("folded"), F.count("*").alias("c")).filter("c = 1")
    m = markers.join(exact, "alias", "left").withColumn("low", F.lower("alias")).join(folded.drop("c"), "low", "left")
    return m.select("label", "seq", "alias", F.coalesce("exact", "folded").alias("gene_id"))


def marker_scores(v: DataFrame, markers: DataFrame, eps: float = 1e-8) -> DataFrame:
    """``i, label, s``: mean z-score (with ``eps``) of the label's genes."""
    m = v.groupBy("gene").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    z = v.join(F.broadcast(m), "gene").withColumn("z", (F.col("v") - F.col("m")) / (F.col("sd") + eps))
    return z.join(F.broadcast(markers.select("label", "gene")), "gene").groupBy("i", "label").agg(F.avg("z").alias("s"))


def annotate(scores: DataFrame) -> DataFrame:
    """The label with the best score, the first in order on ties, its score and its lead over the next."""
    w = Window.partitionBy("i").orderBy(F.desc(F.round("s", 9)), "label")
    r = scores.withColumn("r", F.row_number().over(w)).filter("r <= 2")
    return r.groupBy("i").agg(F.max(F.when(F.col("r") == 1, F.col("label"))).alias("cell_type"), F.max(F.when(F.col("r") == 1, F.col("s"))).alias("score"), (F.max(F.when(F.col("r") == 1, F.col("s"))) - F.max(F.when(F.col("r") == 2, F.col("s")))).alias("margin"))


def smoothed_scores(scores: DataFrame, edges: DataFrame, weight: float = 0.35) -> DataFrame:
    """Scores blended with the neighbours' mean."""
    near = edges.join(scores.select(F.col("i").alias("j"), "label", "s"), "j").groupBy("i", "label").agg(F.avg("s").alias("m"))
    return scores.join(near, ["i", "label"], "left").select("i", "label", ((1 - weight) * F.col("s") + weight * F.coalesce("m", F.col("s"))).alias("s"))


def proportions(scores: DataFrame) -> DataFrame:
    """Softmax of the scores of each observation."""
    w = Window.partitionBy("i")
    e = F.exp(F.col("s") - F.max("s").over(w))
    return scores.withColumn("e", e).select("i", "label", (F.col("e") / F.sum("e").over(w)).alias("p"))


def marker_evidence(v: DataFrame, markers: DataFrame) -> DataFrame:
    """``i, label, p``: mean of log1p over the label's genes as a share of the observation's; equal shares without any."""
    e = v.join(F.broadcast(markers.select("label", "gene")), "gene").groupBy("i", "label").agg(F.avg(F.log1p("v")).alias("e"))
    w = Window.partitionBy("i")
    return e.select("i", "label", F.when(F.sum("e").over(w) > 0, F.col("e") / F.sum("e").over(w)).otherwise(1.0 / F.count("*").over(w)).alias("p"))


def on_simplex(x: Column) -> Column:
    """The nearest array of shares that are not negative and sum to one: all less one amount, cut off at zero."""
    high = F.sort_array(x, asc=False)
    sums = F.transform(high, lambda _, i: F.aggregate(F.slice(high, 1, i + 1), F.lit(0.0), lambda s, y: s + y))
    amounts = F.zip_with(high, F.zip_with(sums, F.sequence(F.lit(1), F.size(x)), lambda s, n: (s - 1.0) / n), lambda h, a: F.when(h - a > 0, a))
    amount = F.element_at(F.filter(amounts, lambda a: a.isNotNull()), -1)
    return F.transform(x, lambda y: F.greatest(y - amount, F.lit(0.0)))


#: Change of a proportion below which a further round changes nothing.
SETTLED = 1e-12


def simplex_deconv(evidence: DataFrame, edges: DataFrame, strength: float = 0.5, rounds: int = 100) -> DataFrame:
    """``evidence(i, label, p)`` drawn towards the neighbours' proportions: projected gradient steps on the squared distance
    to the evidence plus ``strength`` times the graph's Laplacian form.

    Edges weigh exp(-d / median d), the larger of both directions. Rounds end early when nothing moves by more than
    ``SETTLED``. Their joins are merges: broadcasts would hand all proportions to the driver in every round.
    """
    scale = positive_scale(edges.select(F.sqrt("d2").alias("d")), "d")
    weight = F.exp(-F.sqrt("d2") / scale)
    one = edges.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max(weight).alias("w"))
    both = saved(one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")), "laplacian")
    degree = both.groupBy("i").agg(F.sum("w").alias("degree"))
    most = degree.agg(F.max("degree")).first()[0] or 0.0
    step = 1.0 / (1.0 + 2.0 * strength * max(most, 0.0))
    rows = evidence.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("label", "p"))).alias("e"))
    state = saved(rows.join(degree, "i", "left").select("i", F.col("e.label").alias("labels"), F.col("e.p").alias("target"), F.coalesce("degree", F.lit(0.0)).alias("degree"), F.col("e.p").alias("p")), "simplex")
    width = state.agg(F.max(F.size("p"))).first()[0] or 0  # labels of an observation
    for _ in range(rounds):
        near = both.join(state.select(F.col("i").alias("j"), F.col("p").alias("q")).hint("merge"), "j").groupBy("i").agg(*[F.sum(F.col("w") * F.get("q", F.lit(at))).alias(f"s{at}") for at in range(width)])
        pulled = near.select("i", F.filter(F.array(*[f"s{at}" for at in range(width)]), lambda s: s.isNotNull()).alias("pull"))
        moved = F.zip_with(F.zip_with("p", "target", lambda p, t: F.struct(p.alias("p"), (p - t).alias("off"))), F.coalesce("pull", F.transform("p", lambda p: p * 0.0)), lambda x, s: x["p"] - step * (x["off"] + strength * (F.col("degree") * x["p"] - s)))
        new = state.join(pulled.hint("merge"), "i", "left").select("i", "labels", "target", "degree", F.col("p").alias("was"), on_simplex(moved).alias("p"))
        new = saved(new, "simplex")
        change = new.agg(F.max(F.array_max(F.zip_with("p", "was", lambda a, b: F.abs(a - b))))).first()[0]
        state = new.drop("was")
        if change is None or change <= SETTLED:
            break
    return state.select("i", F.explode(F.arrays_zip("labels", "p")).alias("e")).select("i", F.col("e.labels").alias("label"), F.col("e.p").alias("p"))


def stratified_sample(df: DataFrame, label: str, key: str, limit: int) -> DataFrame:
    """About ``limit`` rows, each label by its share and at least one, in the order of a hash of the key."""
    n = df.groupBy(label).agg(F.count("*").alias("_n")).withColumn("_quota", F.greatest(F.lit(1), F.round(F.col("_n") / F.sum("_n").over(Window.partitionBy()) * limit)))
    order = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.join(F.broadcast(n), label).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.col("_quota")).drop("_n", "_quota", "_r")
