"""Event fan-out and delivery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quaystone.operators.notify import payload, replications, webhooks


def notifications(events: DataFrame, targets: DataFrame) -> DataFrame:
    """A stream of events joined to its webhook targets (static), with the body to send."""
    body = payload(F.col("kind"), events["bucket"], F.col("key"), F.col("size"), F.col("etag"), F.col("time"))
    return webhooks(events, targets).withColumn("payload", body)


def replicate(events: DataFrame, rules: DataFrame) -> DataFrame:
    return replications(events, rules)


def deliver(rows: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, attempts: int = 3) -> StreamingQuery:
    """Hands each micro-batch to ``send``; a batch that fails is tried again, then fails the query.

    Batches carry their id, so a sink that remembers ids delivers once.
    """

    def with_retries(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(attempts):
            try:
                return send(batch, batch_id)
            except Exception:
                if attempt + 1 == attempts:
                    raise
        return None

    return rows.writeStream.foreachBatch(with_retries).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refreshed(rows: DataFrame, load_static: Callable[[], DataFrame], join: Callable[[DataFrame, DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Joins each micro-batch to configuration that is loaded anew for it, so changes take effect without a restart."""
    return deliver(rows, lambda batch, i: write(join(batch, load_static()), i), checkpoint, attempts=1)
