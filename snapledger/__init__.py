"""Snapshot catalogues and deduplication as Spark jobs."""
