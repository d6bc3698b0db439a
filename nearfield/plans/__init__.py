"""Plan-level helpers: scratch tables, partition counts, size-checked broadcasts."""
