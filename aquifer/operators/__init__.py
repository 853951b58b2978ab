"""DataFrame -> DataFrame operators grouped by stage of the analysis."""
