"""Search of a stream of queries: each micro-batch is a query batch over the static table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def search_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a stateless search: ``search`` is applied to each micro-batch of the streaming ``queries``, its result given to ``sink`` with the batch's
    number, by which a sink can be made idempotent when a batch is retried."""
    return queries.writeStream.foreachBatch(lambda batch, n: sink(search(batch), n)).option("checkpointLocation", checkpoint).start()
