"""What a method's output is worth against a truth it has not seen: one evaluator for each kind of output.

Every evaluator gives ``metric, value, normalized, primary, direction``: the value as it is, and between 0 and 1 with 1 as
best. Truths and outputs are tables that are joined by the ids of observations, genes, edges or pixels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, ratio
from ..plans.tables import saved
from . import labels
from .graph import components, fused_pairs, undirected
from .relational import rank_correlation
from .svg import rows_of

#: Share of false discoveries that is tolerated, and the overlap from which an instance is found; fixed values.
ALPHA, FOUND = 0.05, 0.5


def _metrics(one: DataFrame, primary: str, minimized: dict[str, Column] | None = None) -> DataFrame:
    """A row of metrics as rows. ``minimized``: metrics that are best when small, with what they are worth."""
    low, found = minimized or {}, None
    for m in one.columns:
        row = one.select(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), clip(low.get(m, F.col(m)).cast("double"), 0, 1).alias("normalized"), F.lit(m == primary).alias("primary"), F.lit("minimize" if m in low else "maximize").alias("direction"))
        found = row if found is None else found.unionByName(row)
    return found


def fdr_control(false_share: Column, alpha: float = ALPHA) -> Column:
    """1 up to the tolerated share of false discoveries, falling to 0 where all are false."""
    f = clip(false_share, 0, 1)
    return F.when(f <= alpha, 1.0).otherwise(1 - (f - alpha) / (1 - alpha))


def spatial_scores(v: DataFrame, edges: DataFrame) -> DataFrame:
    """``gene, score``: size of the rank correlation of a gene with its mean over each observation's neighbours."""
    row = rows_of(v, "v").withColumnRenamed("i", "j")  # whole rows go to their neighbours, and are taken apart where they lie by i
    near = edges.select("i", "j").join(row, "j").repartition("i").select("i", F.explode(F.arrays_zip("genes", "v")).alias("e"))
    m = near.groupBy("i", F.col("e.genes").alias("gene")).agg(F.avg("e.v").alias("m"))
    both = v.join(m, ["i", "gene"]).select(F.col("gene").alias("g"), F.col("v").alias("a"), F.col("m").alias("b"))
    return rank_correlation(both, "g", "a", "b").select(F.col("g").alias("gene"), F.abs("rho").alias("score"))


def signal_retention(before: DataFrame, after: DataFrame, edges: DataFrame, truth: DataFrame) -> DataFrame:
    """One row, ``signal``: how well spatial scores still find the spatial genes, as a share of how well they did before.

    before, after: ``i, gene, v``; only observations of both count, with their neighbours among ``edges``. truth: ``gene,
    spatial``. 0 with fewer than three observations or without a spatial gene.
    """
    common = saved(before.select("i").distinct().join(after.select("i").distinct(), "i"), "common")
    near = edges.select("i", "j").join(common, "i", "left_semi").join(common.select(F.col("i").alias("j")), "j", "left_semi")
    ap = lambda v, name: labels.average_precision(spatial_scores(v.join(common, "i", "left_semi"), near).select("gene", F.round("score", 9).alias("score")).join(truth, "gene"), "score", "spatial").withColumnRenamed("average_precision", name)
    n = common.agg(F.count("*").alias("n")).crossJoin(truth.agg(F.count_if("spatial").alias("genes")))
    s = ap(before, "a").crossJoin(ap(after, "b")).crossJoin(n)  # one row each
    return s.select(F.when((F.col("n") < 3) | (F.col("genes") == 0), 0.0).otherwise(F.coalesce(clip(F.col("b") / F.greatest("a", F.lit(1e-12)), 0, 1), F.lit(0.0))).alias("signal"))


def qc(truth: DataFrame, retained: DataFrame, signal: DataFrame) -> DataFrame:
    """truth: ``i, bad``; retained: ``i`` of what the method keeps; signal: of ``signal_retention``."""
    d = truth.join(retained.select("i", F.lit(1).alias("kept")), "i", "left").select("bad", F.when(F.col("kept").isNull(), 1.0).otherwise(0.0).alias("flagged"))
    kept = d.agg(F.coalesce(F.avg(F.when(~F.col("bad"), 1 - F.col("flagged"))), F.lit(1.0)).alias("normal_retention"))
    ap = labels.average_precision(d, "flagged", "bad").select(F.coalesce("average_precision", F.lit(0.0)).alias("qc_auprc"))
    return _metrics(ap.crossJoin(kept).crossJoin(signal.withColumnRenamed("signal", "phenomenon_signal_retention")), "qc_auprc")


def normalization(before: DataFrame, after: DataFrame, signal: DataFrame) -> DataFrame:
    """before, after: ``i, gene, v`` of all genes."""
    means = before.groupBy("gene").agg(F.avg("v").alias("a")).join(after.groupBy("gene").agg(F.avg("v").alias("b")), "gene")
    rho = rank_correlation(means.select(F.lit(0).alias("g"), F.round("a", 9).alias("a"), F.round("b", 9).alias("b")), "g", "a", "b").select(((F.col("rho") + 1) / 2).alias("marker_rank_preservation"))
    cv = lambda v, name: v.groupBy("i").agg(F.sum("v").alias("t")).agg((F.stddev_pop("t") / F.greatest(F.abs(F.avg("t")), F.lit(1e-12))).alias(name))
    nuisance = cv(before, "raw").crossJoin(cv(after, "out")).select((1 - F.least(F.col("out") / F.greatest("raw", F.lit(1e-12)), F.lit(1.0))).alias("library_nuisance_removal"))
    return _metrics(signal.withColumnRenamed("signal", "phenomenon_signal_retention").crossJoin(rho).crossJoin(nuisance), "phenomenon_signal_retention")


def _matched(pairs: pd.DataFrame) -> pd.DataFrame:
    """The one-to-one matching of greatest total overlap within one component, by shortest augmenting paths."""
    rows, cols = sorted(set(pairs["t"])), sorted(set(pairs["p"]))
    turned = len(rows) > len(cols)
    if turned:
        rows, cols = cols, rows
    at, to = ({x: k for k, x in enumerate(c)} for c in (rows, cols))
    cost = np.zeros((len(rows), len(cols)))
    for t, p, iou in pairs[["t", "p", "iou"]].itertuples(index=False):
        cost[(at[p], to[t]) if turned else (at[t], to[p])] = -iou
    n, m = cost.shape
    u, w, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        best, came, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j0]:
            used[j0] = True
            i0 = owner[j0]
            reduced = cost[i0 - 1] - u[i0] - w[1:]
            better = ~used[1:] & (reduced < best[1:])
            best[1:][better], came[1:][better] = reduced[better], j0
            free = np.flatnonzero(~used[1:]) + 1
            j1 = free[best[free].argmin()]
            delta = best[j1]
            u[owner[used]] += delta
            w[used] -= delta
            best[~used] -= delta
            j0 = j1
        while j0:
            owner[j0] = owner[came[j0]]
            j0 = came[j0]
    ious = [-cost[owner[j] - 1, j - 1] for j in range(1, m + 1) if owner[j]]
    return pd.DataFrame({"iou": [float(x) for x in ious if x > 0]})


def overlaps(pixels: DataFrame) -> DataFrame:
    """``t, p, iou`` of all instances that share pixels; 0 is background. pixels: ``truth, pred``."""
    inside = lambda c: F.col(c) != 0
    both = pixels.filter(inside("truth") & inside("pred")).groupBy(F.col("truth").alias("t"), F.col("pred").alias("p")).agg(F.count("*").alias("n"))
    a = pixels.filter(inside("truth")).groupBy(F.col("truth").alias("t")).agg(F.count("*").alias("nt"))
    b = pixels.filter(inside("pred")).groupBy(F.col("pred").alias("p")).agg(F.count("*").alias("np"))
    return both.join(a, "t").join(b, "p").select("t", "p", (F.col("n") / (F.col("nt") + F.col("np") - F.col("n"))).alias("iou"))


def segmentation(pixels: DataFrame) -> DataFrame:
    """Instances are matched one to one for the greatest total overlap. Only instances that share pixels are joined, and every
    connected group of them is matched by itself, so no matrix of all instances is made. Pairs without overlap fill up the
    smaller side and count as 0."""
    o = saved(overlaps(pixels), "overlaps")
    linked = o.select((F.col("t") * 2).alias("i"), (F.col("p") * 2 + 1).alias("j"))
    part = components(linked) if not o.isEmpty() else linked.select("i", F.col("j").alias("component")).limit(0)
    ious = o.withColumn("i", F.col("t") * 2).join(part, "i").groupBy("component").applyInPandas(_matched, "iou double")
    n = pixels.agg(F.count_distinct(F.when(F.col("truth") != 0, F.col("truth"))).alias("nt"), F.count_distinct(F.when(F.col("pred") != 0, F.col("pred"))).alias("np"))
    s = ious.agg(F.coalesce(F.sum("iou"), F.lit(0.0)).alias("sum"), F.count_if(F.round("iou", 12) >= FOUND).alias("tp")).crossJoin(n)
    union = F.col("nt") + F.col("np") - F.col("tp")
    one = s.select(
        F.when(union > 0, F.try_divide("tp", union)).otherwise(1.0).alias("instance_ap50"), F.coalesce(F.try_divide("sum", F.least("nt", "np")), F.lit(0.0)).alias("mean_matched_iou"), (F.abs(F.col("np") - F.col("nt")) / F.greatest("nt", F.lit(1))).alias("count_error")
    )
    return _metrics(one, "instance_ap50", {"count_error": 1 - F.least("count_error", F.lit(1.0))})


def annotation(obs: DataFrame) -> DataFrame:
    """obs: ``truth, pred``. Classes that are only predicted count in the macro mean with 0. The rare type is the truth's least
    frequent one, the last in order among equals."""
    table = labels.contingency(obs, "truth", "pred")
    per = labels.per_class(table)
    extra = table.select(F.col("pred").alias("class")).distinct().join(per.select("class"), "class", "left_anti").agg(F.count("*").alias("extra"))
    macro = per.agg(F.sum(F.coalesce("f1", F.lit(0.0))).alias("f"), F.count("*").alias("n"), F.avg("recall").alias("balanced_accuracy"), F.min_by("recall", F.struct("support", "class")).alias("rare_type_recall")).crossJoin(extra)
    return _metrics(macro.select((F.col("f") / (F.col("n") + F.col("extra"))).alias("macro_f1"), "balanced_accuracy", "rare_type_recall"), "macro_f1")


def domains(obs: DataFrame, edges: DataFrame) -> DataFrame:
    """obs: ``i, truth, pred``. The boundary is where a neighbour has another label."""
    table = labels.contingency(obs, "truth", "pred")
    a, b = obs.select("i", "truth", "pred"), obs.select(F.col("i").alias("j"), F.col("truth").alias("t2"), F.col("pred").alias("p2"))
    e = edges.select("i", "j").join(a, "i").join(b, "j").groupBy("i").agg(F.max(F.col("truth") != F.col("t2")).alias("t"), F.max(F.col("pred") != F.col("p2")).alias("p"))
    tp, fp, fn = F.count_if(F.col("t") & F.col("p")), F.count_if(~F.col("t") & F.col("p")), F.count_if(F.col("t") & ~F.col("p"))
    f1 = e.agg(F.coalesce(F.try_divide(2.0 * tp, (2 * tp + fp + fn).cast("double")), F.lit(0.0)).alias("boundary_f1"))
    one = labels.adjusted_rand(table).crossJoin(labels.normalized_mutual_information(table)).crossJoin(f1)
    one = one.select(F.greatest((F.col("ari") + F.col("nmi")) / 2, F.lit(0.0)).alias("phenomenon_recovery"), F.col("ari").alias("adjusted_rand_index"), "boundary_f1")
    out = _metrics(one, "phenomenon_recovery")
    return out.withColumn("normalized", F.when(F.col("metric") == "adjusted_rand_index", (F.col("value") + 1) / 2).otherwise(F.col("normalized")))


def deconvolution(both: DataFrame) -> DataFrame:
    """both: ``i, label, p, q`` with the true and the estimated share of every label."""
    p, q, eps = F.col("p"), F.col("q"), 1e-12
    mid = (p + q) / 2
    js = 0.5 * p * F.log((p + eps) / (mid + eps)) + 0.5 * q * F.log((q + eps) / (mid + eps))
    per = both.groupBy("i").agg(F.sum(js).alias("js"))
    rho = rank_correlation(both.select(F.col("label").alias("g"), F.round("p", 9).alias("a"), F.round("q", 9).alias("b")), "g", "a", "b").agg(((F.avg("rho") + 1) / 2).alias("cell_type_correlation"))
    one = both.agg(F.sqrt(F.avg((p - q) * (p - q))).alias("proportion_rmse")).crossJoin(per.agg((1 - F.avg("js") / F.log(F.lit(2.0))).alias("jensen_shannon_similarity"))).crossJoin(rho)
    return _metrics(one, "proportion_rmse", {"proportion_rmse": 1 - F.least("proportion_rmse", F.lit(1.0))})


def variable_genes(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """scores: ``gene, score``; truth: ``gene, spatial`` of all genes. As many genes as are spatial are taken from the top."""
    d = truth.join(scores, "gene", "left").select("gene", "spatial", F.coalesce(F.round("score", 9), F.lit(0.0)).alias("score"))
    k = d.agg(F.count_if("spatial").alias("k"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.desc("gene"))  # as many rows as genes
    top = d.withColumn("r", F.row_number().over(order)).crossJoin(F.broadcast(k)).filter(F.col("r") <= F.col("k")).agg(F.coalesce(F.avg(F.col("spatial").cast("double")), F.lit(0.0)).alias("precision_at_k"))
    one = labels.average_precision(d, "score", "spatial").select(F.coalesce("average_precision", F.lit(0.0)).alias("gene_pr_auc")).crossJoin(top)
    return _metrics(one.withColumn("null_fdr_calibration", fdr_control(1 - F.col("precision_at_k"))), "gene_pr_auc")


def neighborhood(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Edges without direction."""
    t, f = (undirected(x.select("i", "j")).select("i", "j") for x in (truth, found))
    n = t.agg(F.count("*").alias("nt")).crossJoin(f.agg(F.count("*").alias("nf"))).crossJoin(t.join(f, ["i", "j"], "left_semi").agg(F.count("*").alias("both")))
    p, r = F.coalesce(F.try_divide("both", "nf"), F.lit(0.0)), F.coalesce(F.try_divide("both", "nt"), F.lit(0.0))
    return _metrics(n.select(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("edge_f1"), p.alias("edge_precision"), r.alias("edge_recall")), "edge_f1")


def communication(found: DataFrame, truth: DataFrame) -> DataFrame:
    """found: ``source, target, ligand, receptor, rank`` in the method's order; truth: the pairs, with ``active``."""
    key = ["source", "target", "ligand", "receptor"]
    active = truth.filter("active").select(*key).distinct()
    k = active.agg(F.greatest(F.count("*"), F.lit(1)).alias("k"))
    order = Window.partitionBy(F.lit(0)).orderBy("rank", *key)
    top = found.withColumn("r", F.row_number().over(order)).crossJoin(F.broadcast(k)).filter(F.col("r") <= F.col("k")).select(*key).distinct()
    hit = top.join(active, key, "left_semi").agg(F.count("*").alias("hits")).crossJoin(k).select((F.col("hits") / F.col("k")).alias("lr_pr_auc"))
    one = hit.select("lr_pr_auc", F.col("lr_pr_auc").alias("lr_precision_at_k"), fdr_control(1 - F.col("lr_pr_auc")).alias("null_fdr_calibration"))
    return _metrics(one, "lr_pr_auc")


def integration(vectors: DataFrame, obs: DataFrame, k: int = 8) -> DataFrame:
    """vectors: ``i, vec`` of the integrated observations; obs: ``i, label, batch``. Each observation's k nearest in the
    embedding should share its label and not its batch; equal votes go to the first label in order."""
    p = saved(vectors.select("i", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "vec"), "integrated")
    near = saved(fused_pairs(p, p, k, 0.0, 1.0).select("i", "j"), "integrated_neighbours")
    a, b = obs.select("i", "label", "batch"), obs.select(F.col("i").alias("j"), F.col("label").alias("l2"), F.col("batch").alias("b2"))
    e = near.join(a, "i").join(b, "j")
    agree = e.agg(F.avg((F.col("label") == F.col("l2")).cast("double")).alias("biological_neighborhood_conservation"), F.avg((F.col("batch") != F.col("b2")).cast("double")).alias("mixed"))
    f = obs.groupBy("batch").agg(F.count("*").alias("n")).withColumn("f", F.col("n") / F.sum("n").over(Window.partitionBy())).agg((1 - F.sum(F.col("f") * F.col("f"))).alias("chance"), F.count("*").alias("batches"))
    votes = e.groupBy("i", "label", "l2").agg(F.count("*").alias("n")).groupBy("i", "label").agg(F.min_by("l2", F.struct(-F.col("n"), F.col("l2"))).alias("vote"))
    nmi = labels.normalized_mutual_information(labels.contingency(votes, "label", "vote")).withColumnRenamed("nmi", "phenomenon_recoverability")
    var = vectors.select(F.posexplode("vec").alias("g", "v")).groupBy("g").agg(F.var_pop("v").alias("s")).agg(F.greatest(1 - F.least(F.sum("s") / F.count("*"), F.lit(1.0)), F.lit(0.0)).alias("oversmoothing_penalty"))
    one = agree.crossJoin(f).crossJoin(nmi).crossJoin(var)
    mixing = F.when(F.col("batches") < 2, 1.0).otherwise(F.least(F.col("mixed") / F.greatest("chance", F.lit(1e-12)), F.lit(1.0)))
    return _metrics(one.select("biological_neighborhood_conservation", mixing.alias("batch_mixing"), "phenomenon_recoverability", "oversmoothing_penalty"), "biological_neighborhood_conservation", {"oversmoothing_penalty": 1 - F.col("oversmoothing_penalty")})
