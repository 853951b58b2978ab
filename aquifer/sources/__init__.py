"""Sources and sinks: driver tables, fixture views, CSV ingest, stage tables, registries."""

from aquifer.sources.tables import read_table  # noqa: F401
