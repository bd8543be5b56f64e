"""Spatial analytics for imagery catalogues, and corpus preparation, as Spark jobs."""
