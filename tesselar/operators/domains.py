"""Spatial domains: an embedding blended with its neighbours' mean, then clustering.

Distributed estimators come from ``pyspark.ml``. Mean shift and Ward's tree deal their searches over tasks, which hold all points;
the reachability order runs in one Arrow batch for each sample, which must fit in a worker.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans, PowerIterationClustering
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import saved
from .graph import _around, close_cells, radius_components, symmetric


def wide(v: DataFrame) -> DataFrame:
    """``i, vec``: the values of ``v(i, gene, v)`` in order of gene."""
    return v.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("gene", "v"))), lambda x: x["v"]).alias("vec"))


def long(vecs: DataFrame) -> DataFrame:
    return vecs.select("i", F.posexplode("vec").alias("gene", "v"))


def standardized(v: DataFrame) -> DataFrame:
    from .svg import standardized as z

    return z(v, logged=False)


def expression_embedding(v: DataFrame, n_pcs: int = 8) -> DataFrame:
    """``i, vec``: scores on the first components of standardised log1p values; all of them where there are fewer genes."""
    genes = v.select("gene").distinct().count()
    return saved(pca(v.select("i", "gene", F.log1p("v").alias("v")), max(1, min(n_pcs, genes))), "expression_embedding")


#: Genes by genes that are decomposed on the driver at most.
MOST_GENES = 2_000


def _products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sum of the products of all pairs of genes, a row for each gene."""
    total = None
    for b in batches:
        if b.num_rows:
            x = np.array(b.column("vec").to_pylist(), float)
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_pydict({"g": pa.array(range(len(total)), pa.int32()), "row": pa.array(total.tolist(), pa.list_(pa.float64()))})


def pca(v: DataFrame, n: int) -> DataFrame:
    """``i, vec``: scores on the first ``n`` components of standardised genes; a component's largest loading is positive.

    Products of genes are added up in each task and by gene after that; genes by genes reach the driver, ``MOST_GENES`` at most.
    """
    x = saved(wide(standardized(v)), "standardized")
    rows = x.select("vec").mapInArrow(_products, "g int, row array<double>").select("g", F.posexplode("row").alias("h", "s")).groupBy("g", "h").agg(F.sum("s").alias("s")).collect()
    p = 1 + max((r["g"] for r in rows), default=-1)
    if p > MOST_GENES:
        raise ValueError(f"{p} genes; at most {MOST_GENES} are decomposed")
    gram = np.zeros((p, p))
    for r in rows:
        gram[r["g"], r["h"]] = r["s"]
    axes = np.linalg.eigh(gram)[1][:, ::-1][:, :n]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0) if p else axes

    def scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("i"), pa.array((np.array(b.column("vec").to_pylist(), float) @ axes).tolist(), pa.list_(pa.float64()))], names=["i", "vec"])

    return x.select("i", "vec").mapInArrow(scores, f"i {x.schema['i'].dataType.simpleString()}, vec array<double>")


def blended(vecs: DataFrame, edges: DataFrame, weight: float = 0.3) -> DataFrame:
    """(1 - w) of the standardised scores and w of the neighbourhood's standardised mean, itself included."""
    z = standardized(long(vecs))
    near = edges.join(z.select(F.col("i").alias("j"), "gene", F.col("v").alias("vj")), "j").select("i", "gene", "vj").unionByName(z.select("i", "gene", F.col("v").alias("vj")))
    m = standardized(near.groupBy("i", "gene").agg(F.avg("vj").alias("v"))).withColumnRenamed("v", "m")
    return wide(z.join(m, ["i", "gene"]).select("i", "gene", ((1 - weight) * F.col("v") + weight * F.col("m")).alias("v")))


def embedding(v: DataFrame, edges: DataFrame, n_pcs: int = 4, weight: float = 0.3) -> DataFrame:
    return saved(blended(pca(v, n_pcs), edges, weight), "embedding")


def _fit(est, emb: DataFrame) -> DataFrame:
    x = emb.select("i", array_to_vector("vec").alias("features"))
    return est.setFeaturesCol("features").fit(x).transform(x)


def kmeans(emb: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    return _fit(KMeans(k=k, seed=seed, maxIter=100), emb).select("i", F.col("prediction").alias("domain"))


def minibatch_kmeans(emb: DataFrame, k: int = 3, seed: int = 0, fraction: float = 0.5) -> DataFrame:
    """Centres from a sample, all points assigned: the distributed counterpart of mini-batches."""
    x = emb.select("i", array_to_vector("vec").alias("features"))
    some = x.filter(F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1000)) < int(1000 * fraction))
    model = KMeans(k=k, seed=seed, featuresCol="features").fit(some)
    return model.transform(x).select("i", F.col("prediction").alias("domain"))


def bisecting_kmeans(emb: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    return _fit(BisectingKMeans(k=k, seed=seed), emb).select("i", F.col("prediction").alias("domain"))


def gaussian_mixture(emb: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """With the probability of the domain chosen."""
    return _fit(GaussianMixture(k=k, seed=seed), emb).select("i", F.col("prediction").alias("domain"), F.array_max(vector_to_array("probability")).alias("probability"))


def spectral(edges: DataFrame, k: int = 3) -> DataFrame:
    """Power iteration on the neighbour graph, an approximation of its leading eigenvectors."""
    sym = symmetric(edges).filter("i < j").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(1.0).alias("weight"))
    out = PowerIterationClustering(k=k, maxIter=10, weightCol="weight").assignClusters(sym)
    return out.select(F.col("id").alias("i"), F.col("cluster").alias("domain"))


def dbscan(points: DataFrame, eps: float, min_samples: int = 5) -> DataFrame:
    """Clusters of core points within ``eps``, named by their least id; border points join the least; noise is null."""
    own = close_cells(points, eps)
    # all points of a cell are within eps, so only those of cells with few points look for neighbours
    few = own.filter(F.col("n") < min_samples).select("i", "x", "y", "cx", "cy")
    other = own.select(F.col("i").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), "cx", "cy")
    d2 = (F.col("x") - F.col("xj")) * (F.col("x") - F.col("xj")) + (F.col("y") - F.col("yj")) * (F.col("y") - F.col("yj"))
    near = saved(_around(few, 2).join(other, ["cx", "cy"]).filter("i <> j").filter(d2 <= eps * eps).select("i", "j"), "eps")
    core = own.filter(F.col("n") >= min_samples).select("i").unionByName(near.groupBy("i").agg((F.count("*") + 1).alias("n")).filter(F.col("n") >= min_samples).select("i"))
    if min_samples <= 1:
        core = points.select("i")
    core = saved(core, "core")
    part = radius_components(points.join(core, "i", "left_semi"), eps)
    named = saved(core.join(part, "i", "left").select("i", F.coalesce("component", "i").alias("domain")), "core_domains")
    edge = near.join(core, "i", "left_anti").join(named.select(F.col("i").alias("j"), "domain"), "j").groupBy("i").agg(F.min("domain").alias("near"))
    return points.select("i").join(named, "i", "left").join(edge, "i", "left").select("i", F.coalesce("domain", "near").alias("domain"))


def per_sample(emb: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A numpy clusterer over each ``sample`` (one, if there is no such column)."""
    has = "sample" in emb.columns
    d = emb if has else emb.withColumn("sample", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pd.DataFrame({"i": pdf["i"].to_numpy(), "domain": kernel(np.array(pdf["vec"].tolist(), float)).astype(int)})

    return d.groupBy("sample").applyInPandas(run, "i long, domain int")


def _squares(axes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances of ``rows`` to the points whose coordinates are the rows of ``axes``, an axis at a time."""
    out = np.zeros((len(rows), axes.shape[1]))
    for k, axis in enumerate(axes):
        off = axis[None] - rows[:, k, None]
        off *= off
        out += off
    return out


#: Clusters, or points, of a part of the places that are looked at together, and others that they are compared with at once.
LEAF, COLUMNS = 32, 1_024


def _leaves(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Numbers of the rows, in parts of at most ``size`` that lie together: halved at the median of the widest axis."""
    held, out = [np.arange(len(x))], []
    while held:
        at = held.pop()
        if len(at) <= size:
            out.append(at)
            continue
        axis, half = np.ptp(x[at], axis=0).argmax(), len(at) // 2
        order = np.argpartition(x[at, axis], half)
        held += [at[order[half:]], at[order[:half]]]
    return out


def _nearest_clusters(stale: np.ndarray, centre: np.ndarray, size: np.ndarray, perm: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of clusters ``stale`` which other one, the first of equal ones, joins each at the least growth, and that growth.

    ``perm`` has the clusters by parts that begin at ``starts``. A part is looked into if its box and its least cluster let one
    in it be as near as those found in the closest parts. Products tell which growths may be the least; those are taken exactly.
    """
    ends = np.append(starts[1:], len(perm))
    lo, hi, small = np.minimum.reduceat(centre[perm], starts), np.maximum.reduceat(centre[perm], starts), np.minimum.reduceat(size[perm], starts)
    part = np.empty(len(centre), int)
    part[perm] = np.repeat(np.arange(len(starts)), ends - starts)
    near, least = np.full(len(centre), -1), np.full(len(centre), np.inf)
    asked = stale[np.argsort(part[stale], kind="stable")]
    for q in np.split(asked, np.flatnonzero(np.diff(part[asked])) + 1):
        x, n = centre[q], size[q]
        gap = np.maximum(np.maximum(lo - x.max(0), x.min(0) - hi), 0)
        bound = n.min() * small / (n.min() + small) * (gap * gap).sum(1) * (1 - 1e-9)
        seen, some = np.zeros(len(starts), bool), 3
        middle = x.mean(0)
        mine = x - middle
        left = np.column_stack([-2 * mine, (mine * mine).sum(1), np.ones(len(q))])
        while True:
            limit = least[q].max()
            if np.isfinite(limit):
                new = np.flatnonzero((bound <= limit) & ~seen)
            else:  # the closest parts first, more while there is none but itself
                new = np.argpartition(bound, some - 1)[:some] if some < len(bound) else np.arange(len(bound))
                new = new[~seen[new]]
                some *= 4
            if not len(new):
                break
            seen[new] = True
            at = np.sort(np.concatenate([perm[starts[m] : ends[m]] for m in new.tolist()]))
            for first in range(0, len(at), COLUMNS):
                other = at[first : first + COLUMNS]
                off = centre[other] - middle
                far = (off * off).sum(1)
                about = left @ np.column_stack([off, np.ones(len(off)), far]).T
                about /= (1 / n)[:, None] + 1 / size[other]
                own = np.searchsorted(other, q)
                here = np.flatnonzero(other[np.minimum(own, len(other) - 1)] == q)
                about[here, own[here]] = np.inf
                limits = np.minimum(about.min(1), least[q]) + 1e-13 * n * (left[:, -2] + far.max())
                r, c = np.nonzero((about <= limits[:, None]) & (about < np.inf))
                grow = n[r] * size[other[c]] / (n[r] + size[other[c]]) * ((x[r] - centre[other[c]]) ** 2).sum(1)
                order = np.lexsort((other[c], grow, r))
                order = order[np.flatnonzero(np.diff(r[order], prepend=-1))]
                r, found, which = q[r[order]], grow[order], other[c[order]]
                closer = (found < least[r]) | ((found == least[r]) & (which < near[r]))
                least[r[closer]], near[r[closer]] = found[closer], which[closer]
    return near[stale], least[stale]


def ward(k: int, look: Callable[..., tuple[np.ndarray, np.ndarray]] = _nearest_clusters) -> Callable[[np.ndarray], np.ndarray]:
    """Agglomeration by least growth of the squared error, after equal points are one.

    Pairs of which each is the other's nearest are joined in rounds: no join makes a cluster nearer to others than its two were,
    so they are joins of the whole tree in any order, and the lowest are taken. Nearest clusters are looked for in parts of
    the places, by ``look``, so memory grows with the points and time little faster. Equal growths may be joined in another order.
    """

    def run(x: np.ndarray) -> np.ndarray:
        n = len(x)
        _, first, same, count = np.unique(x, axis=0, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(first)
        rank = np.empty(len(order), int)
        rank[order] = np.arange(len(order))
        ids, same, size = first[order], rank[same.ravel()], count[order].astype(float)  # clusters are in the order of their first points
        u, merged, k_ = len(ids), np.arange(n), max(k, 1)
        if k_ >= u:
            again = np.flatnonzero(ids[same] != merged)
            again = again[np.argsort(same[again], kind="stable")][: max(n - k_, 0)]
            merged[again] = ids[same[again]]
            return np.unique(merged, return_inverse=True)[1]
        centre, alive, top = x[ids].astype(float), np.ones(u, bool), np.zeros(u)
        near, least, stale, joins = np.full(u, -1), np.full(u, np.inf), np.arange(u), []
        left, built, perm, starts = u, math.inf, np.arange(0), np.arange(0)
        while left > 1:
            live = np.flatnonzero(alive)
            if left <= 0.75 * built:
                parts, built = _leaves(centre[live], LEAF), left
                perm, starts = live[np.concatenate(parts)], np.cumsum([0, *[len(p) for p in parts[:-1]]])
            near[stale], least[stale] = look(stale, centre, size, perm, starts)
            a = live[(near[near[live]] == live) & (live < near[live])]
            if not len(a):  # equal growths went round in a ring
                stale = live
                continue
            b = near[a]
            top[a] = np.maximum(least[a], np.maximum(top[a], top[b]))
            joins.append((a, b, top[a]))
            centre[a] = (size[a, None] * centre[a] + size[b, None] * centre[b]) / (size[a] + size[b])[:, None]
            size[a] += size[b]
            alive[b] = False
            left -= len(a)
            touched = np.zeros(u, bool)
            touched[a] = touched[b] = True
            stale = np.flatnonzero(alive & (touched | touched[near]))
            part = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(perm))))[alive[perm]]
            perm = perm[alive[perm]]
            starts = np.flatnonzero(np.diff(part, prepend=-1))
        a, b, height = (np.concatenate(c) for c in zip(*joins, strict=True))
        low = np.argsort(height, kind="stable")[: u - k_]
        to = np.arange(u)
        to[b[low]] = a[low]
        while (to[to] != to).any():
            to = to[to]
        return np.unique(to[same], return_inverse=True)[1]

    return run


#: Rows and columns of distances that are counted at once, so that they stay in a core's cache.
TILE = (32, 4_096)
#: Points of a piece of work, points that climb together, and clusters to be looked for from which on that is dealt over tasks.
DEALT, CLIMBING, DEALT_FROM = 512, 128, 8_192
Counts = dict[int, dict[int, int]]


def _counted(x: np.ndarray, rows: slice, heads: set[int], shift: int, above: int) -> Counts:
    """How often each key is a squared distance's, for each of its first bits ``heads``: of ``rows`` and all others once, both
    ways, with those that later rows have counted already."""
    axes, out = np.ascontiguousarray(x.T), {h: {} for h in heads}
    for lo in range(rows.start, min(rows.stop, len(x)), TILE[0]):
        hi = min(lo + TILE[0], rows.stop, len(x))
        for at, end, weight in ((lo, hi, 1), *((c, min(c + TILE[1], len(x)), 2) for c in range(hi, len(x), TILE[1]))):
            key = _squares(axes[:, at:end], x[lo:hi]).ravel().view(np.int64)  # not negative: ordered as numbers
            for h in heads:
                mine = key if above == 63 else key[key >> above == h]
                if not len(mine):
                    continue
                held = out[h]
                if shift:
                    np.add.at(held.setdefault(-1, np.zeros(1 << 16, np.int64)), (mine >> shift) & 0xFFFF, weight)
                else:
                    for v, c in zip(*(r.tolist() for r in np.unique(mine, return_counts=True)), strict=True):
                        held[v] = held.get(v, 0) + weight * c
    return {h: {k: int(v[k]) for v in [held[-1]] for k in np.flatnonzero(v).tolist()} if -1 in held else held for h, held in out.items()}


def distance_quantile(x: np.ndarray, q: float, count: Callable[[set[int], int, int], Counts] | None = None) -> float:
    """The quantile of all distances, those to themselves too, as ``np.quantile`` has it, without holding them: squares are
    counted by their first 16 bits, of the bin that has the place by the next 16, and what is left by value. ``count`` counts
    elsewhere than here."""
    n = len(x)
    count = count or (lambda heads, shift, above: _counted(x, slice(0, n), heads, shift, above))
    place = q * (n * n - 1)
    ranks = sorted({int(place), min(int(place) + 1, n * n - 1)})
    at = {r: (0, r) for r in ranks}  # first bits, and the place among those that have them
    for shift, above in ((47, 63), (31, 47), (0, 31)):
        counts = count({h for h, _ in at.values()}, shift, above)
        for r, (h, rest) in at.items():
            keys = np.array(sorted(counts[h]), np.int64)
            ends = np.cumsum([counts[h][k] for k in keys.tolist()])
            k = int(np.searchsorted(ends, rest, side="right"))
            at[r] = (h << 16 | int(keys[k]) if shift else int(keys[k]), rest - (int(ends[k - 1]) if k else 0))
    found = [float(np.sqrt(np.int64(h).view(np.float64))) for h, _ in (at[r] for r in ranks)]
    low, high, t = found[0], found[-1], place - int(place)
    return high - (high - low) * (1 - t) if t >= 0.5 else low + (high - low) * t


def _climbed(x: np.ndarray, y: np.ndarray, h: float) -> np.ndarray:
    """Of each row of ``y`` the mean of the rows of ``x`` within ``h``. Rows that lie together share what is near or far for
    all of them; only what is on the edge is measured one by one."""
    out, axes, ones = np.empty_like(y), np.ascontiguousarray(x.T), np.column_stack([x, np.ones(len(x))])
    for at in _leaves(y, CLIMBING):
        some = y[at]
        centre = some.mean(0)
        mine = some - centre
        size = (mine * mine).sum(1)
        r, d = np.sqrt(size.max()), np.sqrt(_squares(axes, centre[None])[0])
        slack = 1e-9 * (h + r)
        inside = d < h - r - slack
        edge = np.flatnonzero((d <= h + r + slack) & ~inside)
        sums = np.tile(inside.astype(float) @ ones, (len(at), 1))
        left = np.column_stack([-2 * mine, size - h * h, np.ones(len(at))])
        for lo in range(0, len(edge), TILE[1]):
            part = edge[lo : lo + TILE[1]]
            off = x[part] - centre
            apart = left @ np.column_stack([off, np.ones(len(off)), (off * off).sum(1)]).T
            within = apart <= 0
            a, b = np.nonzero(np.abs(apart) <= 1e-12 * (h + 2 * r) ** 2)
            if len(a):
                within[a, b] = ((x[part[b]] - some[a]) ** 2).sum(1) <= h * h
            sums += within.astype(float) @ ones[part]
        out[at] = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
    return out


def _modes(y: np.ndarray, h: float) -> np.ndarray:
    """Of each end the first mode within ``h``; an end without one is the next mode."""
    out, axes, found = np.full(len(y), -1), np.ascontiguousarray(y.T), 0
    open_ = np.arange(len(y))
    while len(open_):
        near = _squares(axes[:, open_], y[open_[:1]])[0] <= h * h
        near[0] = True
        out[open_[near]] = found
        open_, found = open_[~near], found + 1
    return out


def _climb(x: np.ndarray, y: np.ndarray, h: float, rounds: int) -> Iterator[tuple[float, np.ndarray]]:
    """Before each round the points, and how far it moves them; at last where they are. A point that stays is not looked at again."""
    moving = np.arange(len(y))
    for _ in range(rounds):
        new = y.copy()
        new[moving] = _climbed(x, y[moving], h)
        yield float(np.abs(new - y).max(initial=0)), y
        moving, y = np.flatnonzero((new != y).any(1)), new
    yield 0.0, y


def mean_shift(bandwidth: float | None = None, rounds: int = 30) -> Callable[[np.ndarray], np.ndarray]:
    """Every point climbs the flat kernel's density; ends within a bandwidth are one domain.

    Points climb by parts that lie together, so memory grows with the points; time grows with their square while the parts are
    wide, and with less once they have met.
    """

    def run(x: np.ndarray) -> np.ndarray:
        h = bandwidth or max(distance_quantile(x, 0.3), 1e-12)
        return _modes(next(y for n, (moved, y) in enumerate(_climb(x, x, h, rounds)) if n == rounds or moved < 1e-6 * h), h)

    return run


def _gathered(emb: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and their vectors, on the driver."""
    held = emb.select(F.col("i").cast("long").alias("i"), "vec").orderBy("i").toArrow().combine_chunks()
    ids = held["i"].to_numpy()
    return ids, held["vec"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)


def warded(emb: DataFrame, k: int) -> DataFrame:
    """``ward`` with the search for nearest clusters dealt over tasks while many are looked for. Each task holds all clusters of
    the round, and the driver all points."""
    if "sample" in emb.columns:
        return per_sample(emb, ward(k))
    spark, (ids, x) = emb.sparkSession, _gathered(emb)
    if not len(ids):
        return spark.createDataFrame([], "i long, domain int")

    def look(stale: np.ndarray, centre: np.ndarray, size: np.ndarray, perm: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(stale) < DEALT_FROM:
            return _nearest_clusters(stale, centre, size, perm, starts)
        live, at = np.sort(perm), np.empty(len(centre), int)
        at[perm] = np.arange(len(perm))  # so that parts stay together
        order = np.argsort(at[stale])
        shared = spark.sparkContext.broadcast((np.searchsorted(live, stale[order]), centre[live], size[live], np.searchsorted(live, perm), starts))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for p in b.column("id").to_pylist():
                    asked, *rest = shared.value
                    near, least = _nearest_clusters(asked[p * DEALT : (p + 1) * DEALT], *rest)
                    yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int64()), "near": pa.array([near.astype(np.int64).tobytes()], pa.binary()), "least": pa.array([least.tobytes()], pa.binary())})

        n = -(-len(stale) // DEALT)
        rows = sorted(spark.range(0, n, 1, min(256, n)).mapInArrow(run, "part long, near binary, least binary").collect())  # 16 bytes for each that is looked for
        shared.destroy()
        near, least = np.empty(len(stale), int), np.empty(len(stale))
        near[order], least[order] = live[np.frombuffer(b"".join(r["near"] for r in rows), np.int64)], np.frombuffer(b"".join(r["least"] for r in rows))
        return near, least

    return spark.createDataFrame(pa.table({"i": pa.array(ids, pa.int64()), "domain": pa.array(ward(k, look)(x), pa.int32())}))


def mean_shifted(emb: DataFrame, bandwidth: float | None = None, rounds: int = 30) -> DataFrame:
    """``mean_shift`` with the counting of distances and the climbing dealt over tasks, each of which holds all points (and the
    driver, once). A task lets its points climb to the end; where they are at the round that ends the search for all is taken."""
    if "sample" in emb.columns:
        return per_sample(emb, mean_shift(bandwidth, rounds))
    spark, (ids, x) = emb.sparkSession, _gathered(emb)
    if not len(ids):
        return spark.createDataFrame([], "i long, domain int")
    leaves = np.concatenate(_leaves(x, CLIMBING))
    shared = spark.sparkContext.broadcast((x[leaves], ids[leaves]))
    parts = spark.range(0, -(-len(x) // DEALT), 1, min(256, -(-len(x) // DEALT)))

    def count(heads: set[int], shift: int, above: int) -> Counts:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for p in b.column("id").to_pylist():
                    found = _counted(shared.value[0], slice(p * DEALT, (p + 1) * DEALT), heads, shift, above)
                    rows = [(h, k, n) for h, counts in found.items() for k, n in counts.items()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["h", "k", "n"])

        out: Counts = {h: {} for h in heads}
        for r in parts.mapInArrow(run, "h long, k long, n long").groupBy("h", "k").agg(F.sum("n").alias("n")).collect():  # one row for each key, 65,536 or values of 32 equal bits
            out[r["h"]][r["k"]] = r["n"]
        return out

    h = bandwidth or max(distance_quantile(x, 0.3, count), 1e-12)

    def climb(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column("id").to_pylist():
                all_ = shared.value[0]
                for n, (moved, y) in enumerate(_climb(all_, all_[p * DEALT : (p + 1) * DEALT], h, rounds)):
                    here = y.tobytes() if n == rounds or moved < 1e-6 * h else None
                    yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int64()), "n": pa.array([n], pa.int32()), "moved": [moved], "y": pa.array([here], pa.binary())})
                    if moved == 0:
                        break

    ends = saved(parts.mapInArrow(climb, "part long, n int, moved double, y binary"), "climbed")
    still = {r["n"] for r in ends.filter(F.col("moved") >= 1e-6 * h).select("n").distinct().collect()}  # rounds that move a part
    last = next(n for n in range(rounds + 1) if n not in still)

    def label(group: pa.Table) -> pa.Table:
        points, own = shared.value
        y = np.empty_like(points)
        for p, v in zip(group["part"].to_pylist(), group["y"], strict=True):
            y[p * DEALT : (p + 1) * DEALT] = np.frombuffer(v.as_buffer(), float).reshape(-1, y.shape[1])
        order = np.argsort(own, kind="stable")
        return pa.table({"i": pa.array(own[order], pa.int64()), "domain": pa.array(_modes(y[order], h), pa.int32())})

    at = ends.filter(F.col("y").isNotNull() & (F.col("n") <= last)).groupBy("part").agg(F.max_by("y", "n").alias("y"))
    return at.groupBy(F.lit(0).alias("one")).applyInArrow(label, "i long, domain int")


def _boxes(x: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([x[p].min(0) for p in parts]), np.array([x[p].max(0) for p in parts])


def _gaps(lo: np.ndarray, hi: np.ndarray, at: int) -> np.ndarray:
    """No more than the distances of the points of a box to those of each."""
    gap = np.maximum(np.maximum(lo - hi[at], lo[at] - hi), 0)
    return np.sqrt((gap * gap).sum(1)) * (1 - 1e-9)


def _core_distances(x: np.ndarray, kth: int, parts: list[np.ndarray]) -> np.ndarray:
    """Of each point the distance to its ``kth`` other one, looked for in boxes that may hold it."""
    out, (lo, hi), sizes = np.empty(len(x)), _boxes(x, parts), np.array([len(p) for p in parts])
    for own, part in enumerate(parts):
        gaps = _gaps(lo, hi, own)
        enough = int(sizes[own]) > kth
        near = [own] if enough else np.argsort(gaps, kind="stable")[: 1 + int(np.searchsorted(np.cumsum(sizes[np.argsort(gaps, kind="stable")]), kth, side="right"))]
        least, seen = np.zeros((len(part), 0)), np.zeros(len(parts), bool)
        while len(near):
            seen[near] = True
            others = np.concatenate([parts[m] for m in near])
            for first in range(0, len(others), COLUMNS):
                axes = np.ascontiguousarray(x[others[first : first + COLUMNS]].T)
                least = np.concatenate([least, _squares(axes, x[part])], axis=1)
                if least.shape[1] > kth + 1:
                    least = np.partition(least, kth, axis=1)[:, : kth + 1].copy()
            limit = np.sqrt(least.max())
            near = np.flatnonzero((gaps <= limit) & ~seen)
        out[part] = np.sqrt(least.max(1))
    return out


def _reachability(x: np.ndarray, core: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order from the first point on, always to the least reachability, the first of equal ones, and that of each point.

    A visited point is compared with what is open within the radius of its part. A part's radius waits beside the points; when it
    is the least, nothing nearer is left out, and the part's visited points are compared with what is open within a wider one.
    """
    n = len(x)
    (lo, hi), part, left = _boxes(x, parts), np.empty(n, int), np.array([len(p) for p in parts])
    for m, p in enumerate(parts):
        part[p] = m
    radius = np.array([1.5 * np.median(core[p]) for p in parts])
    floor = max(float(np.ptp(x, axis=0).max()), 1e-12) * 1e-3
    reach, open_, order = np.full(n, np.inf), np.ones(n, bool), []
    visited: list[list[int]] = [[] for _ in parts]
    around: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[float, int]] = [(-1.0, 0)]

    def found(m: int) -> tuple[np.ndarray, np.ndarray]:
        near = np.flatnonzero((_gaps(lo, hi, m) <= radius[m]) & (left > 0))
        at = np.concatenate([parts[k] for k in near.tolist()]) if len(near) else np.zeros(0, int)
        at = at[open_[at]]
        return at, np.ascontiguousarray(x[at].T)

    def offer(rows: list[int], at: np.ndarray, axes: np.ndarray, within: float) -> None:
        d = np.sqrt(_squares(axes, x[rows]))
        new = np.where(d <= within, np.maximum(d, core[rows][:, None]), np.inf).min(0)
        k = np.flatnonzero((new < reach[at]) & open_[at])
        some, values = at[k], new[k]
        reach[some] = values
        for entry in zip(values.tolist(), some.tolist(), strict=True):
            heapq.heappush(heap, entry)

    while heap and len(order) < n:
        key, at = heapq.heappop(heap)
        if at < 0:
            m = -1 - at
            gaps = _gaps(lo, hi, m)[left > 0]
            radius[m] = max(1.5 * radius[m], float(gaps.min()), floor)
            around[m] = found(m)
            for first in range(0, len(around[m][0]), COLUMNS):
                offer(visited[m], around[m][0][first : first + COLUMNS], around[m][1][:, first : first + COLUMNS], radius[m])
            heapq.heappush(heap, (float(radius[m]), at))
            if not left[m]:
                del around[m]  # its points are all visited
            continue
        if not open_[at]:
            continue
        m = int(part[at])
        order.append(at)
        open_[at] = False
        left[m] -= 1
        if not visited[m]:
            heapq.heappush(heap, (float(radius[m]), -1 - m))
            around[m] = found(m)
        visited[m].append(at)
        if len(visited[m]) % 16 == 0:
            keep = open_[around[m][0]]
            around[m] = around[m][0][keep], np.ascontiguousarray(around[m][1][:, keep])
        if len(around[m][0]):
            offer([at], *around[m], radius[m])
        if not left[m]:
            del around[m]
    return np.array(order, int), reach


def optics(min_samples: int = 5, cut: float = 0.5) -> Callable[[np.ndarray], np.ndarray]:
    """Reachability order; a new domain begins where reachability rises above its ``cut`` quantile times two.

    Distances are taken within parts of the places and to those near them, so memory grows with the points and time little faster.
    """

    def run(x: np.ndarray) -> np.ndarray:
        n = len(x)
        core = _core_distances(x, min(min_samples, n) - 1, _leaves(x, LEAF))
        order, reach = _reachability(x, core, _leaves(x, 2 * LEAF))
        seen = reach[order]
        limit = 2 * np.quantile(seen[np.isfinite(seen)], cut) if np.isfinite(seen).any() else np.inf
        out = np.zeros(n, int)
        out[order] = np.cumsum(seen > limit)
        return out

    return run


def birch(k: int, threshold: float = 0.5) -> Callable[[np.ndarray], np.ndarray]:
    """One pass gathers points into summaries no wider than ``threshold``; Ward's tree joins the summaries."""

    def run(x: np.ndarray) -> np.ndarray:
        sums, counts, own = [], [], np.zeros(len(x), int)
        for i, p in enumerate(x):
            if sums:
                c = np.array(sums) / np.array(counts)[:, None]
                j = int(((c - p) ** 2).sum(1).argmin())
                if np.sqrt(((c[j] - p) ** 2).sum()) <= threshold:
                    sums[j], counts[j], own[i] = sums[j] + p, counts[j] + 1, j
                    continue
            own[i] = len(sums)
            sums.append(p.copy())
            counts.append(1)
        return ward(k)(np.array(sums) / np.array(counts)[:, None])[own]

    return run


def multiscale_consensus(v: DataFrame, edges: DataFrame, base_k: int, k: int = 3) -> DataFrame:
    """The expression embedding smoothed at k, 2k and 4k neighbours (``edges`` ranked by r), standardised, side by side; then
    k-means."""
    x = long(expression_embedding(v))
    p = edges.join(x.select(F.col("i").alias("j"), "gene", F.col("v").alias("vj")), "j")
    m = p.groupBy("i", "gene").agg(*[F.avg(F.when(F.col("r") <= base_k * s, F.col("vj"))).alias(f"s{s}") for s in (1, 2, 4)])
    each = m.select("i", F.explode(F.array(*[F.struct((F.col("gene") * 3 + n).alias("gene"), F.col(f"s{s}").alias("v")) for n, s in enumerate((1, 2, 4))])).alias("e"))
    return kmeans(saved(wide(standardized(each.select("i", "e.gene", "e.v"))), "multiscale"), k)


def boundary_aware(v: DataFrame, edges: DataFrame, k: int = 3, weight: float = 0.5) -> DataFrame:
    """Neighbour means weighted by distance and likeness, blended less where neighbours differ; domain and boundary score,
    which is the mean jump to the neighbours as a share of the largest."""
    x = long(expression_embedding(v))
    p = edges.select("i", "j", F.sqrt("d2").alias("d")).join(x, "i").join(x.select(F.col("i").alias("j"), "gene", F.col("v").alias("vj")), ["j", "gene"])
    e = p.groupBy("i", "j", "d").agg(F.sqrt(F.sum((F.col("v") - F.col("vj")) * (F.col("v") - F.col("vj")))).alias("e"))
    e = saved(e, "jumps")
    scales = e.agg(F.greatest(F.median("d"), F.lit(1e-12)).alias("sd"), F.greatest(F.median("e"), F.lit(1e-12)).alias("se"))
    w = e.crossJoin(F.broadcast(scales)).select("i", "j", F.exp(-F.col("d") / F.col("sd") - F.col("e") / F.col("se")).alias("w"))  # one row of scales
    mean = saved(e.groupBy("i").agg(F.avg("e").alias("jump")), "mean_jumps")
    score = mean.crossJoin(F.broadcast(mean.agg(F.greatest(F.max("jump"), F.lit(1e-12)).alias("most")))).select("i", (F.col("jump") / F.col("most")).alias("boundary"))
    near = w.join(x.select(F.col("i").alias("j"), "gene", F.col("v").alias("vj")), "j").groupBy("i", "gene").agg((F.sum(F.col("w") * F.col("vj")) / F.greatest(F.sum("w"), F.lit(1e-12))).alias("m"))
    blend = x.join(near, ["i", "gene"]).join(score, "i").withColumn("b", weight * (1 - F.col("boundary"))).select("i", "gene", ((1 - F.col("b")) * F.col("v") + F.col("b") * F.col("m")).alias("v"))
    return kmeans(saved(wide(standardized(blend)), "blend"), k).join(score, "i")


def potts_refined(emb: DataFrame, domains: DataFrame, edges: DataFrame, weight: float = 0.35, rounds: int = 6) -> DataFrame:
    """Labels of least squared distance from their centre, in units of the median over all labels, plus ``weight`` times the
    share of neighbours with another label; at most so many rounds, and none after one that changes nothing."""
    x = saved(long(emb), "potts_rows")
    lab = saved(domains.select("i", "domain"), "potts")
    kinds = F.broadcast(lab.select("domain").distinct())
    for _ in range(rounds):
        c = kinds.join(x.join(lab, "i").groupBy("domain", "gene").agg(F.avg("v").alias("c")), "domain")
        d = x.join(F.broadcast(c), "gene").groupBy("i", "domain").agg(F.sum((F.col("v") - F.col("c")) * (F.col("v") - F.col("c"))).alias("d"))
        d = saved(d, "potts_costs")
        scale = max(d.agg(F.median("d")).first()[0] or 0.0, 1e-12)
        n = edges.join(lab.select(F.col("i").alias("j"), "domain"), "j").groupBy("i", "domain").agg(F.count("*").alias("n"))
        n = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("i")))
        cost = d.join(n, ["i", "domain"], "left").select("i", "domain", (F.col("d") / scale + weight * (1 - F.coalesce("share", F.lit(0.0)))).alias("cost"))
        new = saved(cost.groupBy("i").agg(F.min(F.struct("cost", "domain")).alias("b")).select("i", F.col("b.domain").alias("domain")), "potts")
        same = new.join(lab.withColumnRenamed("domain", "was"), "i").filter("domain <> was").isEmpty()
        lab = new
        if same:
            break
    same = edges.join(lab, "i").join(lab.toDF("j", "dj"), "j").groupBy("i").agg(F.avg(F.when(F.col("domain") == F.col("dj"), 1.0).otherwise(0.0)).alias("coherence"))
    return lab.join(same, "i", "left")


def joint_embedding(v: DataFrame, edges: DataFrame, n_pcs: int = 8) -> DataFrame:
    """The expression embedding and its neighbours' mean, standardised, side by side."""
    x = long(expression_embedding(v, n_pcs))
    m = edges.join(x.select(F.col("i").alias("j"), "gene", F.col("v").alias("vj")), "j").groupBy("i", "gene").agg(F.avg("vj").alias("v"))
    both = x.select("i", (F.col("gene") * 2).alias("gene"), "v").unionByName(m.select("i", (F.col("gene") * 2 + 1).alias("gene"), "v"))
    return saved(wide(standardized(both)), "joint")


def uncertainty(emb: DataFrame, k: int = 3, runs: int = 7) -> DataFrame:
    """Vote share against the chosen domain over restarts; a run's labels are matched to the first run's by the least sum of
    squared distances between centres."""
    x = long(emb)
    centres = lambda lab: x.join(lab, "i").groupBy("domain", "gene").agg(F.avg("v").alias("c"))
    base = saved(kmeans(emb, k, 0), "base")
    held = saved(centres(base), "base_centres")
    votes = base
    for s in range(1, runs):
        other = saved(kmeans(emb, k, s), "run")
        apart = held.join(centres(other).toDF("o", "gene", "c2"), "gene").groupBy("domain", "o").agg(F.sum((F.col("c") - F.col("c2")) * (F.col("c") - F.col("c2"))).alias("d"))
        match = _assigned([(r["domain"], r["o"], -r["d"]) for r in apart.collect()], k)  # k by k distances
        m = F.create_map(*[F.lit(x) for pair in match.items() for x in pair])
        votes = votes.unionByName(other.select("i", m[F.col("domain")].alias("domain")))
    share = votes.groupBy("i", "domain").agg((F.count("*") / runs).alias("p"))
    return share.groupBy("i").agg(F.max_by("domain", F.struct("p", -F.col("domain"))).alias("domain"), (1 - F.max("p")).alias("uncertainty"))


def _assigned(counts: list[tuple[int, int, float]], k: int) -> dict[int, int]:
    """Best one-to-one match of two labelings by the sum of what pairs are worth, which may be negative (dynamic programming over subsets; k is small)."""
    n = np.zeros((k, k))
    for a, b, c in counts:
        n[b, a] = c
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for b in range(k):
        new: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (total, way) in best.items():
            for a in range(k):
                if not used >> a & 1 and new.get(used | 1 << a, (-math.inf, ()))[0] < total + n[b, a]:
                    new[used | 1 << a] = (total + n[b, a], (*way, a))
        best = new
    return dict(enumerate(best[(1 << k) - 1][1]))


def azimuthal_features(v: DataFrame, edges: DataFrame, points: DataFrame, lam: float = 0.8) -> DataFrame:
    """``i, vec``: own values, neighbours' mean and the size of their first angular moment, weighted by ``lam``."""
    z = saved(standardized(v), "z")
    at = points.select("i", "x", "y")
    e = edges.select("i", "j").join(at, "i").join(at.toDF("j", "xj", "yj"), "j")
    e = e.select("i", "j", F.atan2(F.col("yj") - F.col("y"), F.col("xj") - F.col("x")).alias("t"))
    p = e.join(z.select(F.col("i").alias("j"), "gene", F.col("v").alias("vj")), "j")
    m = p.groupBy("i", "gene").agg(F.avg("vj").alias("m"), (F.hypot(F.sum(F.col("vj") * F.cos("t")), F.sum(F.col("vj") * F.sin("t"))) / F.count("*")).alias("g"))
    zm = standardized(m.select("i", "gene", F.col("m").alias("v"))).withColumnRenamed("v", "m")
    zg = standardized(m.select("i", "gene", F.col("g").alias("v"))).withColumnRenamed("v", "g")
    a, b = (1 - lam) ** 0.5, (lam / 2) ** 0.5
    j = z.join(zm, ["i", "gene"]).join(zg, ["i", "gene"])
    return j.groupBy("i").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("gene", "v", "m", "g"))), lambda x: F.array(a * x["v"], b * x["m"], b * x["g"]))).alias("vec"))
