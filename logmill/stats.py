"""Telemetry of the store and its chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.functions.entries import int_div
from logmill.schema import raw_bytes, text_bytes
from logmill.store import CHUNK_ROWS, LogStore


def savings_pct(stored: Column, raw: Column) -> Column:
    """Percent of bytes saved; null where there is nothing to compare with."""
    return (F.lit(1.0) - stored / F.nullif(raw.cast("double"), F.lit(0.0))) * 100.0


def chunk_stats(entries: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Per chunk of ids: rows, time bounds and raw bytes."""
    return entries.groupBy(int_div(F.col("id") - 1, rows).alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("min_ts"), F.max("ts_ns").alias("max_ts"), F.sum(raw_bytes()).alias("raw_bytes")
    )


def file_stats(store: LogStore) -> DataFrame:
    """Per stored file: rows, time bounds, raw and stored bytes, and the percent saved."""
    got = store.read().select("*", "_metadata.file_path", "_metadata.file_size").groupBy("file_path", "file_size").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("min_ts"), F.max("ts_ns").alias("max_ts"), F.sum(raw_bytes()).alias("raw_bytes")
    )
    return got.withColumn("saved_pct", savings_pct(F.col("file_size"), F.col("raw_bytes")))


class RunningStats:
    """The telemetry of a store, kept between calls: only files that weren't there before are read.

    Holds a few numbers for each file of the store.
    """

    def __init__(self, store: LogStore):
        self.store, self._known = store, {}

    def update(self) -> None:
        sizes = self.store.listing()
        self._known = {p: v for p, v in self._known.items() if p in sizes}
        if new := [p for p in sizes if p not in self._known]:
            df = self.store.spark.read.option("basePath", self.store.path).parquet(*new)
            second = int_div(F.col("ts_ns"), 1_000_000_000)
            per_second = df.select("*", F.col("_metadata.file_path").alias("path")).groupBy("path", second.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(raw_bytes()).alias("raw"))
            rows = per_second.groupBy("path").agg(F.sum("n").alias("n"), F.sum("raw").alias("raw"), F.max("s").alias("s"), F.max_by("n", "s").alias("at_s"))
            by_name = {p.rsplit("/", 1)[1]: p for p in new}
            for r in rows.toLocalIterator():
                p = by_name[r["path"].rsplit("/", 1)[1]]
                self._known[p] = (r["n"], r["s"], r["at_s"], (1.0 - sizes[p] / r["raw"]) * 100.0 if r["raw"] else None)

    def summary(self, subscribers: int = 0, queued: int = 0) -> dict:
        """The telemetry record; velocity is that of the last second of event time."""
        self.update()
        files = list(self._known.values())
        last = max((s for _, s, _, _ in files if s is not None), default=None)
        saved = [p for *_, p in files if p is not None]
        return {
            "total_ingested": sum(f[0] for f in files), "ingest_velocity_ops": sum(f[2] for f in files if f[1] == last and last is not None), "active_chunks": 1, "sealed_chunks": len(files),
            "compression_ratio_pct": sum(saved) / len(saved) if saved else None, "ring_buffer_queued": queued, "subscribers_count": subscribers,
        }


def mean_savings(per_file: DataFrame) -> DataFrame:
    """The unweighted mean over files, null without any."""
    return per_file.agg(F.avg("saved_pct").alias("compression_ratio_pct"))


def total_bytes(entries: DataFrame) -> DataFrame:
    return entries.agg(F.coalesce(F.sum(text_bytes()), F.lit(0)).alias("total_bytes"))


def velocity(entries: DataFrame) -> DataFrame:
    """Entries of each second of event time: second (since the epoch) and n."""
    return entries.groupBy(int_div(F.col("ts_ns"), 1_000_000_000).alias("second")).agg(F.count(F.lit(1)).alias("n"))


def stats_summary(entries: DataFrame, rows: int = CHUNK_ROWS, queued: int = 0, subscribers: int = 0, saved_pct: float | None = None) -> DataFrame:
    """The one-row telemetry record. Chunks beyond full ones are the active one; velocity is that of the last second."""
    second = int_div(F.col("ts_ns"), 1_000_000_000)
    per_second = entries.groupBy(second.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return per_second.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_ingested"),
        F.coalesce(F.max_by("n", "s"), F.lit(0)).cast("bigint").alias("ingest_velocity_ops"),
        F.lit(1).cast("bigint").alias("active_chunks"),
        F.coalesce(int_div(F.sum("n"), rows), F.lit(0)).cast("bigint").alias("sealed_chunks"),
        F.lit(saved_pct).cast("double").alias("compression_ratio_pct"),
        F.lit(queued).cast("bigint").alias("ring_buffer_queued"),
        F.lit(subscribers).cast("bigint").alias("subscribers_count"),
    )
