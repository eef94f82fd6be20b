"""Streams beyond the reference: late pages in micro-batches, expiry as watermark, windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as C
from ..operators import history, page_log


def fresh_pages(stream: DataFrame, ttl: str = "168 hours") -> DataFrame:
    """The first fetch of each URL within the time to live; state older than the watermark is dropped."""
    keyed = stream.withColumn("url", C.normalize_url("url")).where("url is not null")
    return keyed.withWatermark("fetched_at", ttl).dropDuplicatesWithinWatermark(["url"])


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, buckets: int = page_log.BUCKETS) -> StreamingQuery:
    """Feeds the page cache's log: a micro-batch costs its own rows in the buckets they touch. A repeated batch adds nothing."""

    def merge(batch: DataFrame, epoch: int) -> None:
        page_log.upsert(path, history.cache_entries(batch), buckets, source=checkpoint, epoch=epoch)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event type and tumbling window; works on streams and tables alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users: events closer than the gap belong together."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def hits_with_pages(hits: DataFrame, pages: DataFrame, wait: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Each hit (url, hit_at) of a stream with the pages (page_url, fetched_at) fetched within the wait; a hit without any
    comes alone once the watermarks of both sides have passed its wait. State is kept as long as a match can come."""
    left, right = hits.withWatermark("hit_at", late), pages.withWatermark("fetched_at", late)
    soon = (F.col("fetched_at") >= F.col("hit_at")) & (F.col("fetched_at") <= F.col("hit_at") + F.expr(f"interval {wait}"))
    return left.join(right, (F.col("url") == F.col("page_url")) & soon, "leftOuter")
