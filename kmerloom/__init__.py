"""Positions of contiguous and gapped k-mers of text collections, as Spark jobs."""
