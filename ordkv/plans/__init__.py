"""Driver-side planning: the catalog of runs and the compaction policy."""
