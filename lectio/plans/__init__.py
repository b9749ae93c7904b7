"""Query registry, table loading and lineage helpers."""
