"""Linking records as they arrive: each micro-batch is normalised and matched against the stored reference list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.normalize import normalize
from ..operators.simjoin import retrieve
from ..operators.views import Retriever


def link_stream(records: DataFrame, reference: DataFrame, r: Retriever, sink, checkpoint: str) -> StreamingQuery:
    """Starts the query.  records: a stream of raw records; reference: normalised S1 records; sink(pairs, batch id) stores the pairs of a batch.

    A batch is replayed under the same id after a failure, so a sink that overwrites by id has each pair once.  Weights are taken over the reference and the batch.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(retrieve(reference, normalize(batch), r), number)

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
