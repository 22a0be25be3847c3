"""Structured Streaming adapter for twin searches.

The profile analytics are batch operators; the only streaming shape is a
stream of search requests (reference, max_age, selected_leagues,
strict_position, top_n) answered against a profile table.  Each
micro-batch is answered by the batch ``twins`` operator (a bounded
request batch takes the broadcast path) and appended to a sink table, so
the stream inherits the checkpointed, exactly-once ``foreachBatch``
semantics of Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from peerlens.dims import Dimensions
from peerlens.operators.twins import MAX_BROADCAST_QUERIES, twins
from peerlens.schemas import ProfileSpec


def answer_requests(requests: DataFrame, profile: DataFrame, dims: Dimensions,
                    spec: ProfileSpec, sink_path: str, checkpoint_path: str,
                    max_requests_per_batch: int = MAX_BROADCAST_QUERIES,
                    trigger_available_now: bool = True) -> StreamingQuery:
    """Start a streaming query that appends the twins of every request.

    ``requests`` is a streaming DataFrame (e.g. ``readStream.parquet``) with
    a ``reference`` column; ``sink_path`` receives Parquet rows of the
    ``twins`` output plus ``batch_id``.  Both paths belong in the shared
    storage named by ``spark.checkpoint.dir`` on a cluster."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        n = batch.limit(max_requests_per_batch + 1).count()
        if n == 0:
            return
        out = twins(profile, dims, spec, batch, strict_position=None,
                    few_queries=n <= max_requests_per_batch)
        # a folder per batch: a batch that is run again replaces its rows
        out.write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")

    writer = (requests.writeStream.foreachBatch(handle)
              .option("checkpointLocation", checkpoint_path))
    if trigger_available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
