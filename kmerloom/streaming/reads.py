"""Locating reads as they arrive: a stream of queries joined to the tables of a built index."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.index import GappedIndex


def locate(stream: DataFrame, built: GappedIndex) -> DataFrame:
    """stream (query_id, query) as query_id, window, name, text_id, pos, in append mode.

    Rows are decoded per read without state; positions that several windows of a read share are not
    merged, which a stream could only do with state.
    """
    return built.hits(stream)
