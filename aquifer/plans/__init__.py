"""Registered queries: each maps (spark, sf_dir) -> DataFrame and has a DuckDB oracle when exact SQL exists."""

from aquifer.plans.registry import ORACLE, QUERIES, query  # noqa: F401
from aquifer.plans import q_cluster, q_derive, q_evaluate, q_ingest, q_models, q_network, q_prepare, q_profile, q_spatial  # noqa: F401,E402
