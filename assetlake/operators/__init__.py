"""DataFrame operators: intake, tasks, pixels, gates, ranking, packing, statistics."""
