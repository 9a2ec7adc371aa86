"""DataFrame operators: validation, ranking, assembly, statistics, quality, drift."""
