"""Entity x period report panels on Spark: ingest, quality, analytics, grounding."""
