"""End-to-end pipelines and the registry of checkable queries."""
