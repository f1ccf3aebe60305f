"""Model outputs as a stream: validity rates by window, and resumable scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievelight.functions.structured import parse_outputs


def received_by_window(rows: DataFrame, window: str = "1 day", late: str = "45 days", time: str = "received_at") -> DataFrame:
    """Rows of each window and source, of a stream or a table: ``window_start, source, records``.

    Rows that are later than the watermark are dropped by the stream, rows without a time always.
    """
    timed = rows.where(F.col(time).isNotNull()).withColumn("event_time", F.col(time).cast("timestamp"))
    marked = timed.withWatermark("event_time", late) if rows.isStreaming else timed
    counts = marked.groupBy(F.window("event_time", window).alias("w"), "source").agg(F.count("*").alias("records"))
    return counts.select(F.col("w.start").alias("window_start"), "source", "records")


def first_deliveries(rows: DataFrame, keys: list[str], time: str = "received_at", late: str = "45 days") -> DataFrame:
    """The stream without second deliveries of the same keys within the watermark."""
    timed = rows.withColumn("event_time", F.col(time).cast("timestamp")).withWatermark("event_time", late)
    return timed.dropDuplicatesWithinWatermark(keys).drop("event_time")


def score_stream(requests: DataFrame, score: Callable[[DataFrame], DataFrame], labels: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Scores all requests there are, parses the outputs and appends them to ``path``; a second run goes on.

    ``score`` adds ``raw_output``. A batch that is repeated after a failure replaces its own folder, so no row is
    written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        parse_outputs(score(batch), "raw_output", labels).select("*", "parsed.*").drop("parsed").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
