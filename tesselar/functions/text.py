"""Rules on names: tasks, platforms, policies, keys that may not leave a laboratory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tasks, and other names of them (fixed values); names that are not listed pass as they are.
TASKS = ("spatial_domain", "spatial_protein_domain", "spatial_chromatin_domain", "cell_type", "svg", "deconvolution", "virtual_st")
DOMAIN_TASKS = ("spatial_domain", "spatial_protein_domain", "spatial_chromatin_domain")
TASK_ALIASES = {
    "domain_detection": "spatial_domain", "domain": "spatial_domain", "protein_domain": "spatial_protein_domain", "chromatin_domain": "spatial_chromatin_domain",
    "virtual_stain": "virtual_st", "he2st": "virtual_st", "h&e2st": "virtual_st",
}
#: Names of platforms without case, hyphens and underscores (fixed values); others pass as they are.
PLATFORMS = {
    "visium": "visium", "10xvisium": "visium", "visiumhd": "visium_hd", "xenium": "xenium", "10xxenium": "xenium", "merfish": "merfish", "vizgen": "merfish", "merscope": "merscope", "cosmx": "cosmx",
    "slideseqv2": "slideseq", "slideseq": "slideseq", "stereoseq": "stereoseq", "he": "histology", "hne": "histology", "histology": "histology", "codex": "codex", "mibi": "mibi", "imc": "imc",
    "cutntag": "chromatin", "scatac": "chromatin", "spatialatac": "chromatin",
}
#: Parts of keys that stand for data of single observations (fixed values).
PRIVATE = ("counts", "coords", "coordinate", "spatial", "expression", "matrix", "adata", "obsm", "layers", "barcode", "cell_id", "spot_id", "raw_x")
#: Longest list of numbers that a shared record may hold (fixed value).
LONGEST_NUMBERS = 8
#: K policies that do not know the true number of domains, and those that do (fixed values).
HONEST_K, ORACLE_K = ("estimate", "estimated", "non_oracle"), ("oracle", "dual", "fixed_oracle")
#: A JSON string, and with a colon behind it a key; a list of numbers once strings are emptied.
_STRING = r'"(?:[^"\\]|\\.)*"'
_NUMBER = r"(?:-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|NaN|-?Infinity)"


def _looked_up(name: Column, known: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(table[name], F.when(name != "", name))


def normalized_task(task: Column) -> Column:
    """The task's own name; what is empty becomes null."""
    return _looked_up(F.lower(F.trim(task)), TASK_ALIASES)


def platform(name: Column) -> Column:
    return _looked_up(F.translate(F.lower(F.trim(name)), "-_", ""), PLATFORMS)


def is_domain_task(task: Column) -> Column:
    return F.coalesce(normalized_task(task).isin(*DOMAIN_TASKS), F.lit(False))


def task_relation(query: Column, reference: Column) -> Column:
    """``same``, ``same_family`` (two kinds of domains, whose evidence is never mixed) or ``incompatible``."""
    q, r = normalized_task(query), normalized_task(reference)
    return F.when(q == r, "same").when(is_domain_task(query) & is_domain_task(reference), "same_family").otherwise("incompatible")


def method_of(name: Column) -> Column:
    """What stands before the policy in ``method@policy``."""
    return F.substring_index(name, "@", 1)


def policy_of(name: Column) -> Column:
    """All that stands behind the first ``@``."""
    return F.when(F.instr(name, "@") > 0, F.substr(name, F.instr(name, "@") + 1))


def private_keys(json: Column) -> Column:
    """The keys of a JSON record, at any depth, that stand for data of single observations; they may not be shared.

    Strings are read as wholes, so what looks like a key inside one is none. Of a key with dots the last part counts.
    """
    keys = F.transform(F.filter(F.regexp_extract_all(json, F.lit(_STRING + r"\s*:?"), F.lit(0)), lambda x: x.endswith(":")), lambda x: F.regexp_extract(x, r'^"(.*)"\s*:$', 1))
    return F.filter(keys, lambda k: F.regexp_replace(F.element_at(F.split(F.lower(k), r"\."), -1), r"\[.*$", "").rlike("|".join(PRIVATE)))


def long_numbers(json: Column) -> Column:
    """Whether a JSON record holds a list of more than ``LONGEST_NUMBERS`` numbers, at any depth."""
    return F.regexp_replace(json, _STRING, '""').rlike(rf"\[\s*{_NUMBER}(?:\s*,\s*{_NUMBER}){{{LONGEST_NUMBERS},}}\s*\]")


def shareable(json: Column) -> Column:
    return (F.size(private_keys(json)) == 0) & ~long_numbers(json)


def sanitized(key: Column) -> Column:
    return F.regexp_replace(key, "[^A-Za-z0-9_.-]", "_")
