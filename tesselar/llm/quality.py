"""Quality by co-training of two views: what a text says, and what its page's metadata say.

Both views are logistic models over hashed features that tell the classes apart in a bounded sample of labelled rows. In
each round each view ranks all documents without a label, wherever they lie, and hands the rows it is surest of, a quota
for each class, to the other view to learn from. A handed label weighs as much as its calibrated probability is above the
class's share, so a view that knows little teaches little. In the end each view is calibrated on labelled rows that neither
has learned from, a third model combines the two, and all documents are scored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, for_python, fresh, stored

#: Bound of the fit: labelled rows that are brought to the driver as features.
LABELLED = 12_000
ROUNDS = 3
#: Rows that a view labels in a round, shared among the classes as the labels are.
QUOTA = 200
#: Hashed features of a view.
WIDTH = 1 << 18
#: Standard errors by which a feature must tell the classes apart in the labelled rows to take part: a text has many
#: features, so some differ by chance; metadata have few.
TELLING = (4.0, 1.5)
KEEP_FROM = 0.5
HELD_WORDS = 100_000
CONTENT, METADATA = 0, 1
_EDGES = re.compile(r"^\W+|\W+$")


def _slot(kind: str, value: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}\0{value}".encode()) % WIDTH


class _Slots(dict):
    """Word to the packed slots of its features: the word bare, its beginnings, and the signs it ends with."""

    def __missing__(self, word: str) -> bytes:
        low = word.lower()
        bare = _EDGES.sub("", low)
        slots = [_slot("word", bare), _slot("front4", bare[:4]), _slot("front5", bare[:5])]
        signs = low[len(low.rstrip("!?.,;:*#$%&|~_=+-/\\^")) :]
        if len(signs) > 1 or not bare:
            slots.append(_slot("signs", signs[:4]))
        if word[:1].isalpha() and word.isupper() and len(word) > 3:
            slots.append(_slot("shape", "upper"))
        out = struct.pack(f"{len(slots)}i", *slots)
        if len(word) <= 48:
            if len(self) >= HELD_WORDS:
                self.clear()
            self[word] = out
        return out


_slots = _Slots()


def _level(x: float, steps: int = 10) -> str:
    return str(int(min(max(x, 0.0), 1.0) * steps))


def content_features(text: str | None) -> np.ndarray:
    """Distinct slots of a whole text."""
    ws = (text or "").split()
    if not ws:
        return np.array([_slot("shape", "empty")], np.int32)
    packed = b"".join(map(_slots.__getitem__, ws))
    lines = text.split("\n")
    more = [
        _slot("length", str(int(np.log2(len(ws)) * 2))), _slot("variety", _level(len(set(ws)) / len(ws))), _slot("mean", str(len(text) // len(ws))),
        _slot("lines", _level(len(set(lines)) / len(lines))), _slot("bars", _level(text.count("|") / len(ws))), _slot("loud", _level(text.count("!") / len(ws))),
        _slot("echo", _level(sum(map(str.__eq__, ws, ws[1:])) / len(ws))),
    ]
    return np.unique(np.concatenate([np.frombuffer(packed, np.int32), np.array(more, np.int32)]))


def metadata_features(row: dict) -> np.ndarray:
    """Distinct slots of the metadata columns and of their pairs; numbers count by their magnitude at three levels, null as
    a value of its own."""
    out, coarse = [_slot("row", "any")], []
    for name, v in row.items():
        if isinstance(v, int | float) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
            size = float(np.log2(1 + abs(v)))
            out += [_slot(f"{name}{k}", f"{int(size * k)}{v < 0}") for k in (1, 3, 12)]
            coarse.append((name, str(int(size))))
        else:
            out.append(_slot(name, str(v)))
            coarse.append((name, str(v)))
    out += [_slot(f"{a[0]} {b[0]}", f"{a[1]} {b[1]}") for a, b in combinations(coarse, 2)]
    return np.unique(np.array(out, np.int32))


@dataclass
class Logistic:
    """Weights over the slots in ``used``, which are sorted, and an offset."""

    used: np.ndarray
    weights: np.ndarray
    offset: float

    def logit(self, rows: list[np.ndarray]) -> np.ndarray:
        """rows: places in ``used``."""
        if not rows:
            return np.zeros(0)
        # Summed up row by row, so that equal rows have equal sums wherever they stand.
        owner = np.repeat(np.arange(len(rows)), list(map(len, rows)))
        return self.offset + np.bincount(owner, self.weights[np.concatenate(rows)], len(rows))


def _kind(used: np.ndarray) -> type:
    """The numbers that places in ``used`` are kept as."""
    return np.uint16 if len(used) <= 1 << 16 else np.uint32


def placed(used: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The places in ``used`` of those slots that are there."""
    if not len(used):
        return np.zeros(0, _kind(used))
    at = np.minimum(np.searchsorted(used, slots), len(used) - 1)
    return at[used[at] == slots].astype(_kind(used))


def telling(rows: list[np.ndarray], y: np.ndarray, least: float) -> np.ndarray:
    """The slots that tell the classes apart by ``least`` standard errors, in order."""
    slots, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), list(map(len, rows)))
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    one, zero = np.bincount(slots, y[owner], WIDTH), np.bincount(slots, 1 - y[owner], WIDTH)
    p = (one + zero + 1) / (n1 + n0 + 2)
    apart = np.abs(one / n1 - zero / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    apart[one + zero < 3] = 0
    return np.flatnonzero(apart >= least)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(used: np.ndarray, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, steps: int = 150, ridge: float = 1e-3) -> Logistic:
    """A ridge logistic model over ``used`` from rows of places, classes weighted alike."""
    at, owner = np.concatenate([np.zeros(0, np.uint16), *rows]), np.repeat(np.arange(len(rows)), list(map(len, rows)))
    n1, n0 = max((weight * y).sum(), 1e-9), max((weight * (1 - y)).sum(), 1e-9)
    weight = weight * np.where(y > 0.5, 0.5 / n1, 0.5 / n0)
    w, squares = np.zeros(len(used) + 1), np.full(len(used) + 1, 1e-8)
    for _ in range(steps):
        z = w[-1] + np.bincount(owner, w[at], len(rows))
        error = weight * (_sigmoid(z) - y)
        grad = np.append(np.bincount(at, error[owner], len(used)) + ridge * w[:-1] / max(len(used), 1), error.sum())
        squares += grad**2
        w -= 0.5 * grad / np.sqrt(squares)
    return Logistic(used, w[:-1], float(w[-1]))


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and offset under which logits are probabilities (Platt's targets keep both finite)."""
    n1, n0 = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    middle, size = z.mean(), max(np.abs(z - z.mean()).max(initial=0), 1e-9)
    w = _newton(np.stack([(z - middle) / size, np.ones(len(z))], 1), goal)
    return float(w[0] / size), float(w[1] - w[0] / size * middle)


def _newton(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


@dataclass
class CoTrained:
    views: tuple[Logistic, Logistic]
    scales: tuple[tuple[float, float], tuple[float, float]]
    mix: np.ndarray
    #: Rounds done, and labels that each view has handed to the other.
    rounds: int = 0
    handed: tuple[int, int] = (0, 0)

    def score(self, content: list[np.ndarray], metadata: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of each view, and of both combined, that a document is good; rows are of places."""
        zs = [np.clip(a * m.logit(f) + b, -20, 20) for m, f, (a, b) in zip(self.views, (content, metadata), self.scales, strict=True)]
        return _sigmoid(zs[0]), _sigmoid(zs[1]), _sigmoid(self.mix[0] * zs[0] + self.mix[1] * zs[1] + self.mix[2])


@dataclass
class Handed:
    """A row that a view has labelled for the other one."""

    view: int
    label: float
    weight: float
    rows: tuple[np.ndarray, np.ndarray]  # places, by view


@dataclass
class Learner:
    """What the driver holds: labelled rows as places, and the rows handed over so far."""

    used: tuple[np.ndarray, np.ndarray]
    rows: tuple[list[np.ndarray], list[np.ndarray]]
    y: np.ndarray
    given: list[Handed] = field(default_factory=list)

    def __post_init__(self) -> None:
        """Every fifth labelled row is kept for calibration, unless that leaves a class out."""
        test = np.arange(len(self.y)) % 5 == 0
        if len(set(self.y[test])) < 2 or len(set(self.y[~test])) < 2:
            self.learn = self.test = np.arange(len(self.y))
        else:
            self.learn, self.test = np.flatnonzero(~test), np.flatnonzero(test)
        self.share = float(self.y[self.learn].mean())

    def fitted(self) -> CoTrained:
        views, zs, scales = [], [], []
        for v in (CONTENT, METADATA):
            got = [g for g in self.given if g.view != v]
            rows = [self.rows[v][i] for i in self.learn] + [g.rows[v] for g in got]
            y = np.concatenate([self.y[self.learn], [g.label for g in got]])
            views.append(fit(self.used[v], rows, y, np.concatenate([np.ones(len(self.learn)), [g.weight for g in got]])))
            z = views[v].logit([self.rows[v][i] for i in self.test])
            scales.append(calibrate(z, self.y[self.test]))
            zs.append(np.clip(scales[v][0] * z + scales[v][1], -20, 20))
        mix = _newton(np.stack([*zs, np.ones(len(self.test))], 1), self.y[self.test])
        return CoTrained(tuple(views), tuple(scales), mix)

    def weight(self, label: int, p: float) -> float:
        """Of a label whose class has probability p: how far it is above the class's share; none, if it is not."""
        share = self.share if label else 1 - self.share
        return max(0.0, (p - share) / max(1 - share, 1e-9))

    def quota(self, label: int, quota: int) -> int:
        good = max(1, min(quota - 1, round(quota * self.share)))
        return good if label else quota - good


_FEATURES = "y double, content binary, metadata binary"


def _featured(text: str, meta: list[str]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            metas = b.select(meta).to_pylist() if meta else [{}] * b.num_rows
            yield pa.RecordBatch.from_pydict({
                "y": b.column("__y").cast(pa.float64()), "content": pa.array([content_features(x).tobytes() for x in b.column(text).to_pylist()], pa.binary()),
                "metadata": pa.array([metadata_features(x).tobytes() for x in metas], pa.binary()),
            })

    return run


def _places(column: pa.Array, used: np.ndarray) -> list[np.ndarray]:
    return [np.frombuffer(x, _kind(used)) for x in column.to_pylist()]


def _reduced(text: str, meta: list[str], used: tuple[np.ndarray, np.ndarray]) -> Callable:
    """Every document as the places of its telling features."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            metas = b.select(meta).to_pylist() if meta else [{}] * b.num_rows
            content = [placed(used[CONTENT], content_features(x)).tobytes() for x in b.column(text).to_pylist()]
            metadata = [placed(used[METADATA], metadata_features(x)).tobytes() for x in metas]
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(content, pa.binary()), pa.array(metadata, pa.binary())], names=["doc_id", "content", "metadata"])
        _slots.clear()

    return run


def _surest(model: CoTrained, learner_share: float, taken: set[tuple[int, int]], quotas: tuple[int, int]) -> Callable:
    """Of a task's rows the surest of each view and class, as many as the quota; rows of equal features count once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], dict[int, tuple[float, bytes, bytes]]] = {(v, label): {} for v in (0, 1) for label in (0, 1)}
        for b in batches:
            content, metadata = b.column("content").to_pylist(), b.column("metadata").to_pylist()
            ps = model.score(*(_places(b.column(c), m.used) for c, m in zip(("content", "metadata"), model.views, strict=True)))
            for (v, label), held in best.items():
                p = ps[v] if label else 1 - ps[v]
                over = np.flatnonzero(p > (learner_share if label else 1 - learner_share))
                least = min((x[0] for x in held.values()), default=0.0) if len(held) >= quotas[label] else 0.0
                over = over[p[over] >= least]
                # Ties go by the features, so that the choice doesn't depend on how rows are dealt.
                added, last = 0, 0.0
                for i in over[np.argsort(-p[over], kind="stable")].tolist():
                    if added >= quotas[label] and p[i] < last:
                        break
                    key = xxhash.xxh3_64_intdigest(content[i] + b"|" + metadata[i]) - 2**63
                    if (v, key) not in taken and key not in held:
                        held[key] = (float(p[i]), content[i], metadata[i])
                        added, last = added + 1, p[i]
                if len(held) > quotas[label]:
                    top = sorted(held, key=lambda k: (-held[k][0], k))[: quotas[label]]  # noqa: B023
                    best[v, label] = {k: held[k] for k in top}
        rows = [(v, label, k, *x) for (v, label), held in best.items() for k, x in held.items()]
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("view", "label", "key", "p", "content", "metadata"), map(list, zip(*rows, strict=True)), strict=True)))

    return run


@dataclass
class Trained:
    """The model, and all documents as places (``doc_id, content, metadata``), from which they can be scored again."""

    model: CoTrained | None
    used: tuple[np.ndarray, np.ndarray] | None = None
    rows: DataFrame | None = None


def fit_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, quota: int = QUOTA, text_col: str = "text", id_col: str = "doc_id", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars")) -> Trained:
    """Co-train on the labelled documents and all others; without a good or a bad label there is no model.

    labels: ``doc_id, quality, toxic``; good is quality 1 and not toxic. Rows with a null are left out, an id that is
    labelled more than once counts by its worst label. ``labelled`` bounds the labelled rows that are fitted on; they are
    taken by the hash of their id, so they do not depend on the tables' order. Pseudo-labels come from all documents
    without a label, ``quota`` a view and round; documents of equal features count once.
    """
    spark = docs.sparkSession
    for_python(spark)
    meta = [c for c in meta_cols if c in docs.columns]
    spread = F.xxhash64("__id", F.lit("fit"))
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.min(((F.col("quality") > 0) & (F.col("toxic") == 0)).cast("double")).alias("__y"))
    some = F.broadcast(known.orderBy(spread, "__id").limit(labelled))  # a top-k: each task hands on at most as many
    rows = docs.select(F.col(id_col).alias("__id"), *[docs[c] for c in dict.fromkeys([text_col, *meta])])
    got = rows.join(some, "__id").mapInArrow(_featured(text_col, meta), _FEATURES).toArrow()
    y = got.column("y").to_numpy()
    if len(set(y)) < 2:
        return Trained(None)
    both = tuple([np.frombuffer(x, np.int32) for x in got.column(c).to_pylist()] for c in ("content", "metadata"))
    # In an order that does not depend on how the rows arrived.
    order = sorted(range(len(y)), key=lambda i: xxhash.xxh3_64_intdigest(both[0][i].tobytes() + both[1][i].tobytes() + y[i].tobytes()))
    y, both = y[order], tuple([x[i] for i in order] for x in both)
    used = tuple(telling(x, y, least) for x, least in zip(both, TELLING, strict=True))
    learner = Learner(used, tuple([placed(u, x) for x in v] for u, v in zip(used, both, strict=True)), y)
    del got, both

    reduced = rows.mapInArrow(_reduced(text_col, meta, used), T.StructType([T.StructField("doc_id", rows.schema["__id"].dataType), T.StructField("content", T.BinaryType()), T.StructField("metadata", T.BinaryType())]))
    pool = stored(reduced, "features")
    free = stored(pool.join(known.select(F.col("__id").alias("doc_id")), "doc_id", "left_anti").select("content", "metadata"), "unlabelled")
    quotas = learner.quota(0, quota), learner.quota(1, quota)
    handed, taken, done = [0, 0], set(), 0
    for _ in range(rounds):
        found = free.mapInArrow(_surest(learner.fitted(), learner.share, taken, quotas), "view long, label long, key long, p double, content binary, metadata binary")
        order_ = Window.partitionBy("view", "label").orderBy(F.desc("p"), "key")
        best = found.dropDuplicates(["view", "label", "key"]).withColumn("n", F.row_number().over(order_)).filter(F.col("n") <= F.when(F.col("label") == 1, quotas[1]).otherwise(quotas[0]))
        chosen = sorted(best.collect(), key=lambda r: (r.view, r.label, r.n))  # a quota at most of each view and class
        done += 1
        for r in chosen:
            learner.given.append(Handed(r.view, float(r.label), learner.weight(r.label, r.p), tuple([np.frombuffer(x, _kind(u)) for x, u in zip((r.content, r.metadata), used, strict=True)])))
            taken.add((r.view, r.key))
            handed[r.view] += 1
        if not chosen:
            break
    dropped(spark, free)
    model = learner.fitted()
    model.rounds, model.handed = done, tuple(handed)
    return Trained(model, used, pool)


def score_fitted(trained: Trained) -> DataFrame:
    """``doc_id, content, metadata, score, keep`` of every document that the model was fitted beside."""
    fields = "content double, metadata double, score double, keep boolean"
    sent = trained.rows.sparkSession.sparkContext.broadcast(trained.model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sent.value.score(*(_places(b.column(c), m.used) for c, m in zip(("content", "metadata"), sent.value.views, strict=True)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.float64()) for x in found), pa.array(found[2] >= KEEP_FROM)], names=["doc_id", "content", "metadata", "score", "keep"])

    kind = trained.rows.schema["doc_id"].dataType
    return trained.rows.mapInArrow(run, T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL(fields).fields]))


def score_quality(docs: DataFrame, trained: Trained, column: str = "quality_scores", keep_from: float = KEEP_FROM, text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars")) -> DataFrame:
    """``docs`` with a struct ``content, metadata, score, keep`` added (an equally named column is replaced).

    Null, empty and blank texts share one feature of their own. Without a model the scores are null and all are kept. Rows
    are scored one by one, whole texts; all other columns stay and never leave the JVM. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    if trained.model is None:
        none = F.lit(None).cast("double")
        return docs.withColumn(column, F.struct(*[none.alias(c) for c in ("content", "metadata", "score")], F.lit(True).alias("keep")))
    for_python(spark)
    meta = [c for c in meta_cols if c in docs.columns]
    sent = spark.sparkContext.broadcast((trained.model, trained.used))

    @F.arrow_udf("content double, metadata double, score double")
    def scores(text: pa.Array, *values: pa.Array) -> pa.Array:
        model, used = sent.value
        metas = [dict(zip(meta, row, strict=True)) for row in zip(*(v.to_pylist() for v in values), strict=True)] if meta else [{}] * len(text)
        found = model.score([placed(used[CONTENT], content_features(x)) for x in text.to_pylist()], [placed(used[METADATA], metadata_features(x)) for x in metas])
        _slots.clear()
        return pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in found], ["content", "metadata", "score"])

    held = fresh("__scores", docs)
    scored = docs.withColumn(held, scores(docs[text_col], *[docs[c] for c in meta]))
    one = F.struct(*[F.col(f"{held}.{c}").alias(c) for c in ("content", "metadata", "score")], (F.col(f"{held}.score") >= keep_from).alias("keep"))
    return scored.select(*[docs[c] for c in docs.columns if c != column], one.alias(column))


def forget(trained: Trained) -> None:
    """Drop the table of features once nothing reads it."""
    if trained.rows is not None:
        dropped(trained.rows.sparkSession, trained.rows)
