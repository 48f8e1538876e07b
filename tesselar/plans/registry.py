"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import queries_effects, queries_evaluate, queries_evidence, queries_information, queries_k, queries_landscape, queries_matrix, queries_models, queries_recommend, queries_regions, queries_relational, queries_selection, queries_store, queries_studies, queries_twin, queries_whole

_PARTS = (queries_matrix, queries_evidence, queries_models, queries_studies, queries_twin, queries_whole, queries_recommend, queries_regions, queries_relational, queries_selection, queries_k, queries_information, queries_landscape, queries_evaluate, queries_regions, queries_store, queries_twin, queries_effects)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
