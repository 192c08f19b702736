"""Counts over a stream of molecules: the sums of the batch operators merge, so they run as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from molgrid.operators.aggregate import cell_centroids, count_matrix


def stream_counts(pts: DataFrame, name: str, checkpoint: str, centroids: bool = False) -> StreamingQuery:
    """A running count matrix (or running centroids) of a streaming frame, as the in-memory table `name`."""
    out = cell_centroids(pts) if centroids else count_matrix(pts)
    return out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
