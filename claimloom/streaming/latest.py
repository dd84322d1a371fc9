"""Claims as a stream: deduplicated, the latest value per key, and counts per time window."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.views import chosen


def deduplicated(stream: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """Each key once; state is kept for as long as rows may be late."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, ts: str, keys: Sequence[str], size: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Rows per key and window, final once the watermark passes the window."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(window, *keys).agg(F.count("*").alias("n"))


def latest_per_key(stream: DataFrame, keys: Sequence[str], order: str, path: str, checkpoint: str) -> Callable[[], StreamingQuery]:
    """Keep the latest row of each key in a folder; returns a start function that gives the running query.

    Each micro-batch is reduced to its own latest rows and written under its number, so a
    batch that is replayed after a failure replaces itself.  Read the result with :func:`current`.
    """

    def write(batch: DataFrame, number: int) -> None:
        chosen(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    def start() -> StreamingQuery:
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    return start


def current(spark, path: str, keys: Sequence[str], order: str, schema) -> DataFrame:
    """The latest rows over all batches written so far."""
    rows = spark.read.schema(schema).parquet(f"{path}/batch=*")
    return chosen(rows, keys, order)
