"""How many domains: seven estimators and their ensemble over one search.

All that has to be clustered - the points by expression, the points smoothed over their neighbours, and the uniform
reference sets of the gap statistic - is one table of sets, and all k of all sets are clustered by the same passes: first
centres are shared by all k (a set's first k of them), every pass then moves the centres of every k of every set. A task
adds up its points by cluster; sums are added by key, and only centres reach the driver: sets x sum of k x dimensions
numbers (``MOST_NUMBERS`` at most), whatever the points.

Draws (first centres, reference points) come from hashes of set-free keys, so they repeat whatever the partitions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import saved
from .graph import _block_count, _blocks

#: Passes that move the centres, as far as they move.
ROUNDS = 15
#: Reference sets of the gap statistic.
REFERENCES = 5
#: Points that every task holds for the silhouettes; where there are more, blocks of points meet, so many columns at once.
SILHOUETTE_POINTS = 4_000
#: Points whose sums of distances are one row.
SUMMED = 4_096
MOST_NUMBERS = 20_000_000
#: What members of the ensemble count; fixed values.
WEIGHTS = {"silhouette": 0.35, "bic_gmm": 1.6, "calinski_harabasz": 0.8, "davies_bouldin": 0.8, "spatial_silhouette": 1.8, "spatial_coherence": 2.0}
WITH_PLACES = ("silhouette", "bic_gmm", "calinski_harabasz", "spatial_silhouette", "spatial_coherence")
WITHOUT_PLACES = ("silhouette", "bic_gmm", "calinski_harabasz", "davies_bouldin")
EXPRESSION, SMOOTH = "expression", "smooth"


def uniform(*parts: Column | str) -> Column:
    """A draw in (0, 1) from the hash of its key."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _means(weight: float) -> Callable:
    """Of rows sorted by i, the mean of each i's vectors, blended into its own."""

    def blended(sums: np.ndarray, n: np.ndarray, of: np.ndarray, own: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        made = (1 - weight) * own + weight * (sums[of] / n[of, None])
        return pa.RecordBatch.from_pydict({"i": pa.array(ids[of], pa.int64()), "vec": pa.array(list(made), pa.list_(pa.float64()))})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # sum, count, own rows and id of the last i, which the next batch may go on with
        for b in batches:
            if not b.num_rows:
                continue
            i, x = b.column("i").to_numpy(), _matrix(b)
            mine = np.flatnonzero(i == b.column("j").to_numpy())
            starts = np.concatenate([[0], np.flatnonzero(i[1:] != i[:-1]) + 1])
            sums, n, ids = np.add.reduceat(x, starts, axis=0), np.diff([*starts, len(i)]).astype(float), i[starts]
            of, own = np.searchsorted(starts, mine, "right") - 1, x[mine]
            if held is not None and held[3] == ids[0]:
                sums[0] += held[0]
                n[0] += held[1]
                of, own = np.concatenate([np.zeros(len(held[2]), int), of]), np.concatenate([held[2], own])
            elif held is not None and len(held[2]):
                yield blended(held[0][None], np.array([held[1]]), np.zeros(len(held[2]), int), held[2], np.array([held[3]]))
            last = of == len(ids) - 1
            held = (sums[-1], n[-1], own[last], ids[-1])
            if not last.all():
                yield blended(sums, n, of[~last], own[~last], ids)
        if held is not None and len(held[2]):
            yield blended(held[0][None], np.array([held[1]]), np.zeros(len(held[2]), int), held[2], np.array([held[3]]))

    return run


def smoothed(vecs: DataFrame, edges: DataFrame, weight: float) -> DataFrame:
    """(1 - w) of each point's vector and w of the mean over itself and its neighbours; whole vectors are joined and added up
    where their point lies."""
    near = edges.select("i", "j").join(vecs.withColumnRenamed("i", "j"), "j").select("i", "j", "vec").unionByName(vecs.select("i", F.col("i").alias("j"), "vec"))
    return near.repartition("i").sortWithinPartitions("i", "j").mapInArrow(_means(weight), "i long, vec array<double>")


def _drawn(lo: np.ndarray, hi: np.ndarray, n: int) -> Callable:
    """``uniform(r, i, g)`` for each set r, point i and dimension g, between ``lo`` and ``hi``."""
    ends = [str(g).encode() for g in range(len(lo))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("i").to_pylist()
            for r in range(1, n + 1):
                heads = (f"{r}:{i}:".encode() for i in ids)
                found = b"".join([hashlib.md5(h + e, usedforsecurity=False).digest()[:4] for h in heads for e in ends])
                u = (np.frombuffer(found, ">u4").astype(float) + 0.5) / 4294967296.0
                vec = lo + (hi - lo) * u.reshape(len(ids), len(lo))
                yield pa.RecordBatch.from_arrays([pa.array([f"reference{r}"] * len(ids), pa.string()), b.column("i"), pa.array(list(vec), pa.list_(pa.float64()))], names=["set", "i", "vec"])

    return run


def references(vecs: DataFrame, n: int = REFERENCES) -> DataFrame:
    """(set, i, vec): ``n`` sets of as many points, uniform between the least and the greatest value of each dimension."""
    box = vecs.select(F.posexplode("vec").alias("g", "v")).groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("g").collect()  # one row for each dimension
    lo, hi = (np.array([r[c] for r in box], float) for c in ("lo", "hi"))
    return vecs.select(F.col("i").cast("long").alias("i")).mapInArrow(_drawn(lo, hi, n), "set string, i long, vec array<double>")


def _rows(b: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(set, places, matrix) of a batch's sets."""
    sets = np.array(b.column("set").to_pylist(), object)
    flat = _matrix(b)
    for s in sorted(set(sets)):
        at = np.flatnonzero(sets == s)
        yield s, at, flat[at]


def _apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres, as sums of squares: exact where they are equal."""
    return np.stack([((x - y) ** 2).sum(1) for y in c], 1)


#: Share of both squared lengths below which a squared distance that came from a product is summed up again.
CLOSE = 1e-5


def _products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``_apart`` by a product of matrices; what is small beside the lengths is summed up as there, so equal rows are 0 apart."""
    x2, c2 = (x * x).sum(1), (c * c).sum(1)
    d = np.concatenate([x, x2[:, None], np.ones((len(x), 1))], axis=1) @ np.concatenate([-2 * c, np.ones((len(c), 1)), c2[:, None]], axis=1).T
    some = np.flatnonzero(~(d.min(1) > CLOSE * (x2 + c2.max(initial=0))))
    r, q = np.nonzero(~(d[some] > CLOSE * (x2[some, None] + c2)))
    r = some[r]
    for lo in range(0, len(r), 65_536):
        r1, q1 = r[lo : lo + 65_536], q[lo : lo + 65_536]
        d[r1, q1] = ((x[r1] - c[q1]) ** 2).sum(1)
    return d


def _nearest(x: np.ndarray, centres: list[np.ndarray]) -> list[np.ndarray]:
    """Of each row the number of its nearest centre, for each table of centres. One product bounds all distances; rows of which
    two centres are as near as that can tell are measured one by one."""
    c = np.concatenate(centres)
    c2 = (c * c).sum(1)
    d = x @ (-2 * c.T) + c2
    slack = 1e-12 * ((x * x).sum(1) + c2.max())
    out, at = [], 0
    for one in centres:
        part = d[:, at : at + len(one)]
        lab = part.argmin(1)
        unsure = np.flatnonzero(~((part <= part.min(1)[:, None] + slack[:, None]).sum(1) == 1))
        if len(unsure):
            lab[unsure] = _apart(x[unsure], one).argmin(1)
        out.append(lab)
        at += len(one)
    return out


def _next_seed(seeds: dict[str, np.ndarray]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[float, int, list[float]]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            ids, race = b.column("i").to_numpy(), -np.log(b.column("u").to_numpy())
            for s, at, x in _rows(b):
                far = _products(x, seeds[s]).min(1) if s in seeds else np.ones(len(at))
                ok = far > 0
                if ok.any():
                    key = np.where(ok, race[at] / np.where(ok, far, 1), np.inf)
                    k = np.lexsort((ids[at], key))[0]
                    found = (float(key[k]), int(ids[at][k]), x[k].tolist())
                    best[s] = min(best.get(s, found), found)
        if best:
            yield pa.RecordBatch.from_pydict({"set": list(best), "key": [v[0] for v in best.values()], "i": pa.array([v[1] for v in best.values()], pa.int64()), "vec": pa.array([v[2] for v in best.values()], pa.list_(pa.float64()))})

    return run


def seeded(points: DataFrame, k: int) -> dict[str, np.ndarray]:
    """Of each set ``k`` first centres: each point's chance to be the next is its squared distance from those before, drawn as
    a race of exponential variables by hash; fewer where there are fewer different points."""
    seeds: dict[str, np.ndarray] = {}
    for c in range(k):
        rows = points.withColumn("u", uniform(F.lit("seed"), F.lit(c), F.col("i"))).select("set", "i", "vec", "u").mapInArrow(_next_seed(seeds), "set string, key double, i long, vec array<double>")
        found = rows.groupBy("set").agg(F.min_by("vec", F.struct("key", "i")).alias("vec")).collect()  # one row for each set
        for r in found:
            seeds[r["set"]] = np.vstack([seeds[r["set"]], r["vec"]]) if r["set"] in seeds else np.array([r["vec"]])
    return seeds


Centres = dict[tuple[str, int], np.ndarray]


def _partial(centres: Centres, means: Centres | None = None) -> Callable:
    """A task's sums by (set, k, cluster): points and values, and with ``means`` the squares and the distances from a cluster's
    mean. Points are added up by a product with a table of who belongs where."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            for s, _, x in _rows(b):
                ks = [k for t, k in centres if t == s]
                if not ks:
                    continue
                rows, values = np.arange(len(x)), np.column_stack([np.ones(len(x)), np.zeros(len(x)), x, *([] if means is None else [x * x])])
                for k, lab in zip(ks, _nearest(x, [centres[s, k] for k in ks]), strict=True):
                    if means is not None:
                        values[:, 1] = np.sqrt(((x - means[s, k][lab]) ** 2).sum(1))
                    belongs = np.zeros((len(x), len(centres[s, k])))
                    belongs[rows, lab] = 1
                    added = belongs.T @ values
                    for q in np.flatnonzero(added[:, 0]).tolist():
                        held[s, k, q] = held[s, k, q] + added[q] if (s, k, q) in held else added[q]
        if held:
            keys = list(held)
            yield pa.RecordBatch.from_pydict({"set": [x[0] for x in keys], "k": pa.array([x[1] for x in keys], pa.int32()), "c": pa.array([x[2] for x in keys], pa.int32()), "sums": pa.array([held[x].tolist() for x in keys], pa.list_(pa.float64()))})

    return run


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tasks' sums, sorted by key, added up."""
    key, total, made = None, None, []
    for b in batches:
        for *new, sums in zip(*(b.column(c).to_pylist() for c in ("set", "k", "c", "sums")), strict=True):
            if new == key:
                total = total + np.array(sums)
                continue
            if key is not None:
                made.append((*key, total))
            key, total = new, np.array(sums)
    if key is not None:
        made.append((*key, total))
        yield pa.RecordBatch.from_pydict({"set": [m[0] for m in made], "k": pa.array([m[1] for m in made], pa.int32()), "c": pa.array([m[2] for m in made], pa.int32()), "sums": pa.array([m[3].tolist() for m in made], pa.list_(pa.float64()))})


def _sums(points: DataFrame, centres: Centres, means: Centres | None = None) -> dict[tuple[str, int], dict[int, np.ndarray]]:
    schema = "set string, k int, c int, sums array<double>"
    rows = points.mapInArrow(_partial(centres, means), schema).repartition("set", "k", "c").sortWithinPartitions("set", "k", "c", "sums").mapInArrow(_added, schema)
    out: dict[tuple[str, int], dict[int, np.ndarray]] = {}
    for r in rows.collect():  # one row for each cluster
        out.setdefault((r["set"], r["k"]), {})[r["c"]] = np.array(r["sums"])
    return out


def clustered(points: DataFrame, ks: list[int], rounds: int = ROUNDS) -> Centres:
    """Centres of k-means for every set of ``points(set, i, vec)`` and every k, after ``rounds`` passes or when none moves."""
    seeds = seeded(points, max(ks))
    centres: Centres = {(s, k): c[:k] for s, c in seeds.items() for k in ks}
    if sum(c.size for c in centres.values()) > MOST_NUMBERS:
        raise ValueError(f"centres of all sets and k have more than {MOST_NUMBERS} numbers")
    moving = dict(centres)
    for _ in range(rounds):
        if not moving:
            break
        sums = _sums(points, moving)
        now = {}
        for key, old in moving.items():
            new = old.copy()
            for q, s in sums[key].items():
                new[q] = s[2 : 2 + old.shape[1]] / s[0]
            centres[key] = new
            if not np.array_equal(new, old):
                now[key] = new
        moving = now
    return centres


def _labels(centres: Centres, ks: list[int]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out = np.zeros((b.num_rows, len(ks)), np.int32)
            for s, at, x in _rows(b):
                for j, lab in enumerate(_nearest(x, [centres[s, k] for k in ks])):
                    out[at, j] = lab
            yield pa.RecordBatch.from_arrays([b.column("set"), b.column("i"), b.column("vec"), pa.array(out.tolist(), pa.list_(pa.int32()))], names=["set", "i", "vec", "labels"])

    return run


def labelled(points: DataFrame, centres: Centres, ks: list[int]) -> DataFrame:
    """(set, i, vec, labels): of every point its cluster for each k."""
    return points.mapInArrow(_labels(centres, ks), "set string, i long, vec array<double>, labels array<int>")


def _belongs(labels: np.ndarray, counts: list[np.ndarray]) -> np.ndarray:
    """Who belongs where: a column of ones and zeros for each cluster of each k."""
    return np.concatenate([np.eye(len(c))[labels[:, j]] for j, c in enumerate(counts)], axis=1)


def _widths(every: np.ndarray, own: np.ndarray, seen: np.ndarray | bool, counts: list[np.ndarray]) -> list[float]:
    """For each k the sum of the rows' silhouettes, from their sums of distances to each cluster; ``seen`` of them are in it."""
    ends, rows, out = np.cumsum([0, *[len(c) for c in counts]]), np.arange(len(every)), []
    for j, c in enumerate(counts):
        by = every[:, ends[j] : ends[j + 1]]
        size = np.tile(c.astype(float), (len(every), 1))
        size[rows, own[:, j]] -= seen
        mean = np.divide(by, size, out=np.full_like(by, np.inf), where=size > 0)
        a = mean[rows, own[:, j]]
        mean[rows, own[:, j]] = np.inf
        b = mean.min(1)
        top = np.maximum(a, b)
        ok = np.isfinite(top) & (top > 0)
        out.append(float(((b - a)[ok] / top[ok]).sum()))
    return out


def _silhouettes(x0: np.ndarray, i0: np.ndarray, l0: np.ndarray, counts: list[np.ndarray]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(l0.shape[1]), 0
        belongs = _belongs(l0, counts)
        for b in batches:
            if not b.num_rows:
                continue
            x, lab, ids = _matrix(b), _label_matrix(b), b.column("i").to_numpy()
            for lo in range(0, len(x), 256):
                part, own, me = x[lo : lo + 256], lab[lo : lo + 256], ids[lo : lo + 256]
                total += _widths(np.sqrt(_products(part, x0)) @ belongs, own, np.isin(me, i0), counts)
            n += len(x)
        yield pa.RecordBatch.from_pydict({"j": pa.array(range(len(total)), pa.int32()), "s": pa.array(total, pa.float64()), "n": pa.array([n] * len(total), pa.int64())})

    return run


def _label_matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("labels").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _block_sums(counts: list[np.ndarray]) -> Callable:
    """Of two blocks' points (of one, where ``p`` is ``q``) the sums of distances to the other block's clusters."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        p, q = (k.as_py() for k in key)
        held = []
        for at in dict.fromkeys((p, q)):
            t = group.filter(pa.compute.equal(group["b"], at)).sort_by("i").combine_chunks().to_batches(max_chunksize=None)
            held.append((at, _matrix(t[0]), _label_matrix(t[0])) if t else (at, None, None))
        made: list[tuple[int, int, int, bytes | None, bytes]] = []
        if all(x is not None for _, x, _ in held):
            (_, x, lx), (_, y, ly) = held[0], held[-1]
            bx, by = _belongs(lx, counts), _belongs(ly, counts)
            to_y, to_x = np.zeros((len(x), bx.shape[1])), np.zeros((len(y), bx.shape[1]))
            for lo in range(0, len(x), 256):
                for at in range(0, len(y), SILHOUETTE_POINTS):
                    d = np.sqrt(_products(x[lo : lo + 256], y[at : at + SILHOUETTE_POINTS]))
                    to_y[lo : lo + 256] += d @ by[at : at + SILHOUETTE_POINTS]
                    if p != q:
                        to_x[at : at + SILHOUETTE_POINTS] += d.T @ bx[lo : lo + 256]
            for (b, _, own), sums, other in zip(held, (to_y, to_x), (q, p), strict=False):
                for c, lo in enumerate(range(0, len(sums), SUMMED)):
                    made.append((b, c, other, own[lo : lo + SUMMED].astype(np.int32).tobytes() if p == q else None, sums[lo : lo + SUMMED].tobytes()))
        columns = list(zip(*made, strict=True)) or [()] * 5
        return pa.table([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["b", "part", "other", "own", "sums"])

    return run


def _part_widths(counts: list[np.ndarray]) -> Callable:
    """What the blocks add to the sums of a part of a block, added up, and its silhouettes."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("other")
        own = np.frombuffer(next(v for v in rows["own"].to_pylist() if v is not None), np.int32).reshape(-1, len(counts))
        every = np.zeros((len(own), sum(len(c) for c in counts)))
        for v in rows["sums"]:
            every += np.frombuffer(v.as_buffer(), float).reshape(every.shape)
        return pa.table({"j": pa.array(range(len(counts)), pa.int32()), "s": pa.array(_widths(every, own, True, counts), pa.float64()), "n": pa.array([len(own)] * len(counts), pa.int64())})

    return run


def silhouettes(points: DataFrame, ks: list[int]) -> dict[int, float]:
    """The mean silhouette for each k; -1 where there are fewer than two clusters, or as many as points.

    All distances count. Up to ``SILHOUETTE_POINTS`` points are held by every task. Where there are more, each two blocks meet
    once, and what leaves them are sums by cluster; a point is sent as often as there are blocks, 16 up to a million points.
    """
    rows = points.select("i", "vec", "labels")
    sizes = rows.select(F.posexplode("labels").alias("j", "c")).groupBy("j", "c").agg(F.count("*").alias("n")).collect()  # one row for each cluster
    counts = [np.zeros(k, int) for k in ks]
    for r in sizes:
        counts[r["j"]][r["c"]] = r["n"]
    n = int(counts[0].sum()) if ks else 0
    if not n:
        return {k: -1.0 for k in ks}
    if n <= SILHOUETTE_POINTS:
        held = rows.orderBy("i").toPandas()
        found = rows.mapInArrow(_silhouettes(np.array(held["vec"].tolist(), float), held["i"].to_numpy(), np.array(held["labels"].tolist(), int), counts), "j int, s double, n long")
    else:
        blocks = _block_count(n)
        meet = _blocks(rows, blocks).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        pairs = meet.select(F.least("b", "c").alias("p"), F.greatest("b", "c").alias("q"), "b", "i", "vec", "labels").repartition(blocks * (blocks + 1) // 2, "p", "q")
        sums = pairs.groupBy("p", "q").applyInArrow(_block_sums(counts), "b int, part int, other int, own binary, sums binary")
        found = sums.groupBy("b", "part").applyInArrow(_part_widths(counts), "j int, s double, n long")
    out = {ks[r["j"]]: r["s"] / r["n"] for r in found.groupBy("j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    return {k: -1.0 if (counts[j] > 0).sum() < 2 or (counts[j] > 0).sum() >= n else out[k] for j, k in enumerate(ks)}


def coherences(labels: DataFrame, edges: DataFrame, ks: list[int]) -> dict[int, float]:
    """For each k how much oftener neighbours share a cluster than chance has it."""
    a = labels.select("i", F.col("labels").alias("a"))
    same = edges.select("i", "j").join(a, "i").join(a.toDF("j", "b"), "j").select(F.posexplode(F.zip_with("a", "b", lambda x, y: (x == y).cast("double"))).alias("p", "same")).groupBy("p").agg(F.avg("same").alias("po")).collect()
    freq = labels.select(F.posexplode("labels").alias("p", "c")).groupBy("p", "c").agg(F.count("*").alias("n")).collect()
    out = {}
    for j, k in enumerate(ks):
        n = np.array([r["n"] for r in freq if r["p"] == j], float)
        pe = float(((n / n.sum()) ** 2).sum()) if len(n) else 1.0
        po = next((r["po"] for r in same if r["p"] == j), 0.0)
        out[k] = 0.0 if pe >= 1 - 1e-12 else (po - pe) / (1 - pe)
    return out


def _indices(clusters: dict[int, np.ndarray], k: int) -> dict[str, float]:
    """Dispersion, variance ratio, separation and information criterion from a clustering's sums."""
    s = np.array([clusters[q] for q in sorted(clusters)])
    d = (s.shape[1] - 2) // 2
    n, mean, square = s[:, 0], s[:, 2 : 2 + d] / s[:, :1], s[:, 2 + d :] / s[:, :1]
    var = np.maximum(square - mean**2, 0)
    within, total = float((var * n[:, None]).sum()), n.sum()
    centre = (mean * n[:, None]).sum(0) / total
    between = float((n[:, None] * (mean - centre) ** 2).sum())
    have = len(s)
    ch = -1.0 if have < 2 or have >= total else (1e6 if between > 0 else 0.0) if within <= 0 else between / (have - 1) / (within / (total - have))
    spread, db = s[:, 1] / n, 1e6
    if have > 1:
        gap = np.sqrt(((mean[:, None] - mean[None]) ** 2).sum(2))
        ratio = np.where(gap > 0, (spread[:, None] + spread[None]) / np.where(gap > 0, gap, 1), 1e6)
        np.fill_diagonal(ratio, 0)
        db = float(ratio.max(1).mean())
    bic = 1e6 + 1e3 * k
    if have == k and n.min() >= 2:
        v = var + 1e-6
        fit = n * (-0.5 * (d * math.log(2 * math.pi) + np.log(v).sum(1)) - 0.5 * (var / v).sum(1) + np.log(n / total))
        bic = -2 * float(fit.sum()) + (2 * k * d + k - 1) * math.log(total)
    return {"dispersion": within, "calinski_harabasz": ch, "davies_bouldin": -db, "bic_gmm": -bic}


def curves(vecs: DataFrame, edges: DataFrame | None, ks: list[int], weight: float = 0.75, refs: int = REFERENCES) -> tuple[dict[str, dict[int, float]], dict[int, float]]:
    """Of every estimator its score for each k, greater being better, and the gap statistic's errors.

    ``vecs(i, vec)`` is the embedding; ``edges(i, j)`` the neighbours, without which the spatial estimators are left out.
    """
    sets = vecs.select(F.lit(EXPRESSION).alias("set"), "i", "vec").unionByName(references(vecs, refs))
    if edges is not None:
        sets = sets.unionByName(smoothed(vecs, edges, weight).select(F.lit(SMOOTH).alias("set"), "i", "vec"))
    points = saved(sets, "k_sets")
    centres = clustered(points, ks)
    first = _sums(points, centres)
    means = {key: c.copy() for key, c in centres.items()}
    for key, found in first.items():
        for q, s in found.items():
            means[key][q] = s[2 : 2 + means[key].shape[1]] / s[0]
    sums = _sums(points, centres, means)
    found = {(s, k): _indices(sums[s, k], k) for s, k in sums}
    out = {e: {k: found[EXPRESSION, k][e] for k in ks} for e in ("calinski_harabasz", "davies_bouldin", "bic_gmm")}
    logs = {k: np.array([math.log(found[f"reference{r}", k]["dispersion"] + 1e-12) for r in range(1, refs + 1)]) for k in ks}
    out["gap"] = {k: float(logs[k].mean() - math.log(found[EXPRESSION, k]["dispersion"] + 1e-12)) for k in ks}
    errors = {k: float(logs[k].std(ddof=1)) * math.sqrt(1 + 1 / refs) if refs > 1 else 0.0 for k in ks}
    labels = saved(labelled(points.filter(~F.col("set").startswith("reference")), centres, ks), "k_labels")
    out["silhouette"] = silhouettes(labels.filter(F.col("set") == EXPRESSION), ks)
    if edges is not None:
        smooth = labels.filter(F.col("set") == SMOOTH)
        out["spatial_silhouette"], out["spatial_coherence"] = silhouettes(smooth, ks), coherences(smooth, edges, ks)
    return out, errors


def _best(curve: dict[int, float]) -> int:
    return min(curve, key=lambda k: (-round(curve[k], 9), k))


def by_gap(gap: dict[int, float], errors: dict[int, float]) -> int:
    """The least k that is no worse than the next but for its error; the greatest where there is none."""
    ks = sorted(gap)
    return next((k for k, after in zip(ks, ks[1:], strict=False) if round(gap[k] - gap[after] + errors[after], 9) >= 0), ks[-1])


def ensemble(found: dict[str, dict[int, float]]) -> tuple[int, dict[int, float]]:
    """The weighted mean of the members' curves, each between 0 and 1; of its three best k the spatially most coherent one."""
    members = [m for m in (WITH_PLACES if "spatial_coherence" in found else WITHOUT_PLACES) if m in found]
    total = dict.fromkeys(found[members[0]], 0.0)
    for m in members:
        lo, hi = min(found[m].values()), max(found[m].values())
        for k, v in found[m].items():
            total[k] += WEIGHTS[m] * (0.5 if hi - lo < 1e-12 else (v - lo) / (hi - lo)) / sum(WEIGHTS[x] for x in members)
    top = sorted(total, key=lambda k: (-round(total[k], 9), k))[:3]
    coherent = found.get("spatial_coherence")
    return (max(top, key=lambda k: (round(coherent[k], 9), -top.index(k))) if coherent else top[0]), total


def k_range(n: int, k_min: int = 2, k_max: int | None = None) -> list[int]:
    most = min(12, max(k_min + 1, math.isqrt(n))) if k_max is None else k_max
    return list(range(k_min, max(k_min, min(most, n - 1)) + 1))


def estimate_k(vecs: DataFrame, edges: DataFrame | None, k_min: int = 2, k_max: int | None = None, weight: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """``(estimator, k, score)`` and ``(estimator, k)``: all curves, and what each estimator and the ensemble choose."""
    n = vecs.count()
    if n < 4:
        raise ValueError("the number of domains needs at least 4 observations")
    ks = k_range(n, k_min, k_max)
    found, errors = curves(vecs, edges, ks, weight)
    chosen = {e: by_gap(c, errors) if e == "gap" else _best(c) for e, c in found.items()}
    chosen["ensemble"], found["ensemble"] = ensemble(found)
    spark = vecs.sparkSession
    return spark.createDataFrame([(e, k, float(v)) for e, c in found.items() for k, v in c.items()], "estimator string, k int, score double"), spark.createDataFrame(list(chosen.items()), "estimator string, k int")


def dual_track(vecs: DataFrame, edges: DataFrame | None, truth: DataFrame, estimator: str = "ensemble", **options: int) -> DataFrame:
    """``estimator, estimated_k, oracle_k, k_match``: what is estimated without the labels ``truth(i, label)``, beside their number."""
    chosen = estimate_k(vecs, edges, **options)[1].filter(F.col("estimator") == estimator)
    oracle = truth.agg(F.count_distinct("label").cast("int").alias("oracle_k"))
    return chosen.crossJoin(F.broadcast(oracle)).select("estimator", F.col("k").alias("estimated_k"), "oracle_k", (F.col("k") == F.col("oracle_k")).alias("k_match"))
