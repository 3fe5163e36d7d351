"""Tidemark: activity analytics over append-only agent logs, as Spark jobs."""
