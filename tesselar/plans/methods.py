"""Methods as transforms of a sample's tables, found by category and name, with declared parameters.

A sample is a dict of DataFrames: ``expr(obs_id, gene_id, value)``, ``var(gene_id, feature_name, mito)``,
``v(i, gene, v)`` for dense values, ``points(i, x, y)``, ``markers(label, gene)``, ``batch(i, batch)`` and whatever methods
add: ``edges``, ``domains``, ``svg``, ... A method reads what it needs and gives new or replaced tables; tables it doesn't
give stay as they are, so nothing is changed in place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import domains, graph, integrate, labels, normalize, qc, svg

Sample = dict[str, DataFrame]
_TYPES = {"int": int, "float": float, "bool": bool, "str": str}


@dataclass(frozen=True)
class Param:
    name: str
    kind: str
    default: Any
    low: float | None = None
    high: float | None = None
    choices: tuple = ()

    def checked(self, value: Any) -> Any:
        """``value`` if the declaration allows it. A bool is no int; an int is a float."""
        if value is None and self.default is None:
            return None
        if self.kind == "float" and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if self.kind in _TYPES and (not isinstance(value, _TYPES[self.kind]) or (self.kind != "bool" and isinstance(value, bool))):
            raise TypeError(f"{self.name} must be {self.kind}, not {value!r}")
        if self.low is not None and value < self.low or self.high is not None and value > self.high:
            raise ValueError(f"{self.name} = {value!r} is out of its range")
        if self.choices and value not in self.choices:
            raise ValueError(f"{self.name} must be one of {self.choices}")
        return value


@dataclass(frozen=True)
class Deprecation:
    """Since when a version is out of use, what takes its place, and what becomes of its parameters.

    Renamed parameters are handed on under their new names; one that was removed is an error that says why, never dropped.
    """

    since: str
    replacement: tuple[str, str, str]
    renames: tuple[tuple[str, str], ...] = ()
    removed: tuple[str, ...] = ()
    notes: str = ""

    def __post_init__(self) -> None:
        old, new = [a for a, _ in self.renames], [b for _, b in self.renames]
        if not self.since:
            raise ValueError("a deprecation names the version since which it holds")
        if len(set(old)) < len(old) or len(set(new)) < len(new):
            raise ValueError("a parameter is renamed once, and to a name of its own")
        if both := set(old) & set(self.removed):
            raise ValueError(f"{sorted(both)} cannot be renamed and removed")

    def moved(self, params: dict[str, Any]) -> dict[str, Any]:
        if gone := sorted(set(params) & set(self.removed)):
            raise ValueError(f"{gone} were removed: {self.notes or 'no replacement'}")
        names = dict(self.renames)
        if twice := sorted(a for a, b in self.renames if a in params and b in params):
            raise ValueError(f"{twice} are given under both their old and their new name")
        return {names.get(k, k): v for k, v in params.items()}


@dataclass(frozen=True)
class Method:
    category: str
    name: str
    run: Callable[..., Sample]
    needs: tuple[str, ...] = ()
    params: tuple[Param, ...] = ()
    version: str = "1.0.0"
    deprecated: Deprecation | None = None
    summary: str = ""

    def bound(self, given: dict[str, Any]) -> dict[str, Any]:
        known = {p.name: p for p in self.params}
        if extra := set(given) - set(known):
            raise ValueError(f"{self.name} has no parameter {sorted(extra)}")
        return {n: p.checked(given.get(n, p.default)) for n, p in known.items()}


REGISTRY: dict[tuple[str, str, str], Method] = {}


def register(method: Method) -> Method:
    key = (method.category, method.name, method.version)
    if key in REGISTRY:
        raise ValueError(f"{key} is registered already")
    REGISTRY[key] = method
    return method


def version_key(version: str) -> tuple[int, ...]:
    return tuple(int(x) for x in re.findall(r"\d+", version))


def get_method(category: str, name: str, version: str | None = None) -> Method:
    """The version asked for, else the latest that is not deprecated."""
    found = [m for (c, n, v), m in REGISTRY.items() if (c, n) == (category, name) and (version is None or v == version)]
    found = [m for m in found if version or not m.deprecated] or found
    if not found:
        raise KeyError(f"no method {category}/{name}" + (f" {version}" if version else ""))
    return max(found, key=lambda m: version_key(m.version))


def list_methods(spark: SparkSession, category: str | None = None) -> DataFrame:
    """The catalogue: the latest version of each method."""
    rows = [(m.category, m.name, m.version, list(version_key(m.version)), m.deprecated is not None, ",".join(m.needs), ",".join(p.name for p in m.params)) for m in REGISTRY.values() if category in (None, m.category)]
    df = spark.createDataFrame(rows, "category string, name string, version string, key array<int>, deprecated boolean, needs string, params string")
    w = Window.partitionBy("category", "name").orderBy("deprecated", F.desc("key"))
    return df.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r", "key")


@dataclass
class Step:
    category: str
    method: str
    params: dict[str, Any] = field(default_factory=dict)
    version: str | None = None


def migrated(step: Step) -> tuple[Step, str]:
    """The step under the version that replaced its own, however often that was replaced, and what was changed."""
    said, seen = [], set()
    while True:
        m = get_method(step.category, step.method, step.version)
        if m.deprecated is None:
            return step, "; ".join(said)
        if (m.category, m.name, m.version) in seen:
            raise ValueError(f"{m.name} {m.version} is replaced by itself")
        seen.add((m.category, m.name, m.version))
        d = m.deprecated
        category, method, version = d.replacement
        said.append(f"{m.name} {m.version}, out of use since {d.since}, is {method} {version} now" + "".join(f", {a} is {b}" for a, b in d.renames if a in step.params))
        step = Step(category, method, d.moved(step.params), version)


def validate(steps: Iterable[Step], tables: set[str]) -> list[str]:
    """What is wrong with a plan, without running it: unknown methods, bad parameters, tables that nobody gives."""
    wrong, have = [], set(tables)
    for i, s in enumerate(steps):
        try:
            s, _ = migrated(s)
            m = get_method(s.category, s.method, s.version)
            m.bound(s.params)
        except (KeyError, TypeError, ValueError) as e:
            wrong.append(f"step {i}: {e}")
            continue
        if lacks := [t for t in m.needs if t not in have]:
            wrong.append(f"step {i}: {m.name} needs {', '.join(lacks)}")
        have |= GIVES.get(m.category, set())
    return wrong


#: Tables that the methods of a category add.
GIVES = {"neighborhood": {"edges"}, "domain_detection": {"domains"}, "annotation": {"annotation"}, "deconvolution": {"proportions"}, "spatially_variable_genes": {"svg"}, "qc": {"qc"}, "normalization": set(), "integration": set()}


def run_pipeline(sample: Sample, steps: list[Step]) -> tuple[Sample, list[dict]]:
    """The sample after all steps, and a record of each. Nothing is computed before a table is used."""
    if wrong := validate(steps, set(sample)):
        raise ValueError("; ".join(wrong))
    out, log = dict(sample), []
    for i, s in enumerate(steps):
        s, said = migrated(s)
        m = get_method(s.category, s.method, s.version)
        params = m.bound(s.params)
        new = m.run(out, **params)
        if not new:
            raise RuntimeError(f"{m.name} gave no table")
        out |= new
        log.append({"seq": i, "step": m.category, "method": m.name, "version": m.version, "params": params, "tables": sorted(new), "migrated": said})
    return out, log


#: Words of a question that call for a step, in the order of a plan (fixed values).
TEMPLATES = (
    (("quality", "qc", "filter"), Step("qc", "basic_qc")),
    (("normali", "log1p", "cp10k"), Step("normalization", "log1p_cp10k")),
    (("batch", "integrat", "harmoni"), Step("integration", "combat")),
    (("neighbo", "graph", "domain", "region", "variable", "spatial"), Step("neighborhood", "spatial_graph")),
    (("domain", "region", "cluster"), Step("domain_detection", "kmeans")),
    (("variable", "pattern", "svg"), Step("spatially_variable_genes", "morans_i")),
    (("annotat", "cell type", "marker"), Step("annotation", "marker_score")),
    (("proportion", "deconv", "mixture"), Step("deconvolution", "marker_deconv")),
)


def compile_question(question: str) -> list[Step]:
    """A plan from a question's words; a question that names no step is an error."""
    q = question.lower()
    steps = [Step(s.category, s.method, dict(s.params)) for words, s in TEMPLATES if any(w in q for w in words)]
    if not steps:
        raise ValueError("the question names no step that this library knows")
    return steps


_K = Param("k", "int", 6, 1, 200)
_DOMAINS = Param("n_domains", "int", 3, 1, 1000)


def _keep(x: Sample, **params: Any) -> Sample:
    kept = qc.basic_qc(x["expr"], x["var"], **params)
    return {"qc": kept, "expr": x["expr"].join(kept.select("obs_id"), "obs_id", "left_semi")}


def _n(x: Sample) -> DataFrame:
    return x["var"].agg(F.count("*"))


def _embedded(x: Sample) -> DataFrame:
    return domains.embedding(x["v"], x["edges"])


register(Method("qc", "basic_qc", _keep, ("expr", "var"), (Param("n_mads", "float", 5.0, 0), Param("min_counts", "float", 10.0, 0), Param("min_genes", "int", 3, 0), Param("max_mito_pct", "float", 40.0, 0, 100))))
register(Method("qc", "gene_complexity_qc", lambda x, min_genes: {"qc": qc.gene_complexity_qc(x["expr"], min_genes)}, ("expr",), (Param("min_genes", "int", 100, 0),)))
register(Method("qc", "library_size_qc", lambda x, min_counts: {"qc": qc.library_size_qc(x["expr"], min_counts)}, ("expr",), (Param("min_counts", "float", 500.0, 0),)))
register(Method("qc", "mitochondrial_qc", lambda x, max_fraction: {"qc": qc.mitochondrial_qc(x["expr"], x["var"], max_fraction)}, ("expr", "var"), (Param("max_fraction", "float", 0.2, 0, 1),)))
register(Method("qc", "adaptive_saturation_qc", lambda x, flag_fraction: {"qc": qc.adaptive_saturation_qc(x["expr"], _n(x), flag_fraction)}, ("expr", "var"), (Param("flag_fraction", "float", 0.05, 0, 1),)))
for _name, _f in {"spatial_entropy_qc": qc.spatial_entropy_qc, "neighbor_discordance_qc": qc.neighbor_discordance_qc}.items():
    register(Method("qc", _name, lambda x, flag_fraction, f=_f: {"qc": f(x["v"], x["edges"], flag_fraction)}, ("v", "edges"), (Param("flag_fraction", "float", 0.05, 0, 1),)))
for _name, _f, _p in (
    ("library_size_scale", normalize.library_size_scale, (Param("target_sum", "float", 1e4, 1e-12),)), ("log1p_cp10k", normalize.log1p_cp10k, (Param("target_sum", "float", 1e4, 1e-12),)), ("r_lognorm", normalize.log1p_cp10k, (Param("target_sum", "float", 1e4, 1e-12),)),
    ("sqrt_transform", normalize.sqrt_transform, ()), ("arcsinh_transform", normalize.arcsinh_transform, (Param("cofactor", "float", 5.0, 1e-12),)),
    ("tfidf_l2", normalize.tfidf_l2, ()), ("rank_stabilize", normalize.rank_stabilize, (Param("scale", "float", 1.0, 1e-12),)),
):
    register(Method("normalization", _name, lambda x, f=_f, **p: {"counts": x.get("counts", x["expr"]), "expr": f(x["expr"], **p)}, ("expr",), _p))
register(Method("normalization", "clr_per_cell", lambda x, pseudocount: {"expr": normalize.clr_per_cell(x["expr"], _n(x), pseudocount)}, ("expr", "var"), (Param("pseudocount", "float", 1.0, 1e-12),)))
register(Method("normalization", "robust_pearson_residual", lambda x, theta: {"expr": normalize.robust_pearson_residual(x["expr"], _n(x), theta)}, ("expr", "var"), (Param("theta", "float", 100.0, 1e-12),)))
register(Method("normalization", "spatial_median_normalize", lambda x: {"v": normalize.spatial_median_normalize(x["v"], x["edges"])}, ("v", "edges")))
register(Method("normalization", "graph_diffusion_normalize", lambda x, steps: {"v": normalize.graph_diffusion_normalize(x["v"], x["edges"], steps=steps)}, ("v", "edges"), (Param("steps", "int", 2, 1, 50),)))
register(Method("neighborhood", "spatial_graph", lambda x, k, mode, radius: {"edges": graph.knn(x["points"], k) if mode == "knn" else graph.radius_graph(x["points"], radius)}, ("points",), (Param("k", "int", 8, 1, 200), Param("mode", "str", "knn", choices=("knn", "radius")), Param("radius", "float", 15.0, 1e-12))))
register(Method("neighborhood", "mutual_knn_graph", lambda x, k: {"edges": graph.mutual(graph.knn(x["points"], k))}, ("points",), (_K,)))
register(Method("neighborhood", "adaptive_radius_graph", lambda x, k, radius_scale: {"edges": graph.adaptive_radius(x["points"], k, radius_scale)}, ("points",), (_K, Param("radius_scale", "float", 1.25, 1e-12))))
for _name, _f in {"kmeans": domains.kmeans, "minibatch_kmeans": domains.minibatch_kmeans, "bisecting_kmeans": domains.bisecting_kmeans, "gaussian_mixture": domains.gaussian_mixture}.items():
    register(Method("domain_detection", _name, lambda x, n_domains, f=_f: {"domains": f(_embedded(x), n_domains)}, ("v", "edges"), (_DOMAINS,)))
for _name, _k in {"agglomerative": domains.ward, "birch": domains.birch}.items():
    register(Method("domain_detection", _name, lambda x, n_domains, f=_k: {"domains": domains.per_sample(_embedded(x), f(n_domains))}, ("v", "edges"), (_DOMAINS,)))
register(Method("domain_detection", "mean_shift", lambda x: {"domains": domains.mean_shifted(_embedded(x))}, ("v", "edges")))
register(Method("domain_detection", "optics", lambda x, min_samples: {"domains": domains.per_sample(_embedded(x), domains.optics(min_samples))}, ("v", "edges"), (Param("min_samples", "int", 5, 1),)))
register(Method("domain_detection", "dbscan", lambda x, eps, min_samples: {"domains": domains.dbscan(x["points"], eps, min_samples)}, ("points",), (Param("eps", "float", 0.5, 1e-12), Param("min_samples", "int", 5, 1))))
register(Method("domain_detection", "spectral", lambda x, n_domains: {"domains": domains.spectral(x["edges"], n_domains)}, ("edges",), (_DOMAINS,)))
register(Method("domain_detection", "topology_regularized_domains", lambda x, n_domains: {"domains": domains.potts_refined(e := domains.expression_embedding(x["v"]), domains.kmeans(e, n_domains), x["edges"])}, ("v", "edges"), (_DOMAINS,)))
register(Method("domain_detection", "boundary_aware_domains", lambda x, n_domains: {"domains": domains.boundary_aware(x["v"], x["edges"], n_domains)}, ("v", "edges"), (_DOMAINS,)))
for _name, _f in {"gearys_c": svg.gearys_c, "spatial_variance_ratio": svg.variance_ratio, "boundary_svg": svg.boundary, "hotspot_svg": svg.hotspot}.items():
    register(Method("spatially_variable_genes", _name, lambda x, f=_f: {"svg": f(x["v"], x["edges"])}, ("v", "edges")))
register(Method("spatially_variable_genes", "morans_i", lambda x, k: {"svg": svg.morans_i(x["v"], x["edges"], k)}, ("v", "edges"), (_K,)))
register(Method("spatially_variable_genes", "anisotropy_svg", lambda x: {"svg": svg.anisotropy(x["v"], x["edges"], x["points"])}, ("v", "edges", "points")))
register(Method("annotation", "marker_score", lambda x: {"annotation": labels.annotate(labels.marker_scores(x["v"], x["markers"]))}, ("v", "markers")))
register(Method("annotation", "neighbor_marker_annotate", lambda x, neighbor_weight: {"annotation": labels.annotate(labels.smoothed_scores(labels.marker_scores(x["v"], x["markers"]), x["edges"], neighbor_weight))}, ("v", "markers", "edges"), (Param("neighbor_weight", "float", 0.35, 0, 1),)))
register(Method("deconvolution", "marker_deconv", lambda x: {"proportions": labels.proportions(labels.marker_scores(x["v"], x["markers"]))}, ("v", "markers")))
register(Method("deconvolution", "spatial_simplex_deconv", lambda x, strength, n_iter: {"proportions": labels.simplex_deconv(labels.marker_evidence(x["v"], x["markers"]), x["edges"], strength, n_iter)}, ("v", "markers", "edges"), (Param("strength", "float", 0.5, 0), Param("n_iter", "int", 100, 1))))
for _name, _f in {"combat": integrate.combat, "combat_ranks": integrate.combat_ranks, "median_shift_integrate": integrate.centre_batches}.items():
    register(Method("integration", _name, lambda x, f=_f: {"v": f(x["v"], x["batch"])}, ("v", "batch")))
register(Method("integration", "quantile_integrate", lambda x, k, spatial_blend: {"v": integrate.quantile_align(x["v"], x["batch"], x["points"], k, spatial_blend)}, ("v", "batch", "points"), (_K, Param("spatial_blend", "float", 0.2, 0, 1))))
_COMPONENTS = Param("n_components", "int", 8, 1)
register(Method("integration", "anchor_residual_integrate", lambda x, spatial_weight, n_components: {"v": integrate.anchor_residuals(x["v"], x["batch"], x["points"], domains.pca(x["v"], n_components), spatial_weight)}, ("v", "batch", "points"), (Param("spatial_weight", "float", 1.0, 0), _COMPONENTS)))
register(Method("neighborhood", "expression_spatial_graph", lambda x, k, spatial_weight, n_components: {"edges": graph.fused_graph(x["points"], domains.pca(x["v"], n_components), k, spatial_weight)}, ("v", "points"), (_K, Param("spatial_weight", "float", 0.5, 0, 1), _COMPONENTS)))
register(Method("domain_detection", "uncertainty_domains", lambda x, n_domains: {"domains": domains.uncertainty(domains.joint_embedding(x["v"], x["edges"]), n_domains)}, ("v", "edges"), (_DOMAINS,)))
register(Method("domain_detection", "multiscale_consensus_domains", lambda x, n_domains, base_k: {"domains": domains.multiscale_consensus(x["v"], graph.knn(x["points"], 4 * base_k), base_k, n_domains)}, ("v", "points"), (_DOMAINS, Param("base_k", "int", 4, 1))))
register(Method("spatially_variable_genes", "multiscale_svg", lambda x, k, n_scales: {"svg": svg.multiscale(x["v"], graph.knn(x["points"], k * n_scales), k, n_scales)}, ("v", "points"), (_K, Param("n_scales", "int", 3, 1))))
register(Method("spatially_variable_genes", "bootstrap_robust_svg", lambda x, k: {"svg": svg.bootstrap_robust(x["v"], lambda p: graph.knn(p, k), x["points"])}, ("v", "points"), (_K,)))
