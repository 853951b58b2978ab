"""aquifer: monitoring-network analytics as plain Spark DataFrame functions.

Sub-packages
------------
sources    table loaders, fixture views over the driver tables, stage/sink I/O
functions  column-expression helpers (null-safe numerics, cosine, slug, ...)
operators  DataFrame -> DataFrame operators grouped by analysis stage
plans      registered queries (`queries()`) and their DuckDB oracles
streaming  (intentionally empty: the analysis has no streaming operators)
"""

from aquifer.session import get_spark, checkpoint_dir  # noqa: F401
