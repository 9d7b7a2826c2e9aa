"""Continuous ingest: a stream of raw lines, frames or entries into the store, by the same plans as in batch.

Durability is the stream's checkpoint and the store's commits: a batch that was cut short is written again as a whole.
Event times aren't checked here; late and out-of-order entries are stored like any others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from logmill.functions.entries import int_div
from logmill.functions.syslog import parse_syslog
from logmill.schema import FIELDS
from logmill.sources.lines import decode_lines, text_entries
from logmill.store import Ids, LogStore, numbered, prepare

#: Bits of an id that number the rows of a batch and partition; the batch comes above.
ROW_BITS = 40


def watch(spark: SparkSession, path: str, most_files: int | None = None) -> DataFrame:
    """Lines of text files dropped into a folder, as a stream: value. most_files bounds what a trigger takes."""
    reader = spark.readStream.format("text")
    return (reader.option("maxFilesPerTrigger", most_files) if most_files else reader).load(path)


def watch_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a TCP connection; for trials, since a socket can't be read again."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def entries_of(lines: DataFrame, kind: str, now_ns: int, service: str = "default", sender: str = "", compat: str = "strict") -> DataFrame:
    """Lines (value) as entries, streaming or not. kind: ndjson (strict decoder), json (fast decoder), text or syslog."""
    if kind in ("ndjson", "json"):
        return decode_lines(lines.select("value"), "value", "strict" if kind == "ndjson" else "fast", now_ns)
    if kind == "text":
        return text_entries(lines.select("value").filter("trim(value) <> ''"), now_ns, service)
    if kind == "syslog":
        raw = F.regexp_replace("value", r"(?<![\r\n])[\r\n]++$", "")
        return parse_syslog(lines.select(raw.alias("raw"), F.lit(sender).alias("sender")), now_ns, compat)
    raise ValueError(kind)


def batch_ids(entries: DataFrame, batch: int) -> DataFrame:
    """Ids that grow with the batch, and within it in the order of the source; unique, not dense."""
    return entries.withColumn("id", F.monotonically_increasing_id() + F.lit((batch + 1) << ROW_BITS))


class Begun:
    """Notes beside a stream's checkpoint of the batches it began to store, with their ids: first and number."""

    KEEP = 100

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.spark, self.folder = spark, checkpoint.rstrip("/") + "_batches"

    def _at(self, name: object):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def ids(self, number: int) -> tuple[int, int] | None:
        p, fs = self._at(f"{number}_*")
        found = fs.globStatus(p)
        return tuple(map(int, found[0].getPath().getName().split("_")[1:])) if found else None

    def note(self, number: int, first: int, n: int) -> None:
        p, fs = self._at(f"{number}_{first}_{n}")
        fs.create(p, True).close()
        old, _ = self._at(f"{number - self.KEEP}_*")
        for s in fs.globStatus(old) or []:
            fs.delete(s.getPath(), False)


def ingest(entries: DataFrame, store: LogStore, checkpoint: str, now_ns: Callable[[], int], trigger: dict | None = None, also: Callable[[DataFrame, int], None] | None = None, ids: Ids | None = None) -> StreamingQuery:
    """Start writing a stream of entries to the store; also gets each batch as it is stored, with ids.

    Ids are those of the process, if given, or carry the batch's number. They are noted before a batch is stored. Only a
    batch that was begun before, which a failure makes run again, is looked for in the store, by its ids, and not stored twice.
    """
    begun = Begun(store.spark, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        rows = prepare(batch, now_ns()).persist()
        try:
            before = begun.ids(number)
            if ids is None:
                first, n = (number + 1) << ROW_BITS, 1 << ROW_BITS
                df = batch_ids(rows, number)
            else:
                df, first, n = numbered(rows, (lambda _: before[0]) if before else ids.take)
            df = df.select(*FIELDS)
            if before is None:
                begun.note(number, first, n)
            stored = before and store.files() and store.read().filter(F.col("id").between(first, first + n - 1)).limit(1).count()
            if not stored and n:
                store.append(df)
            if also:
                also(df, number)
        finally:
            rows.unpersist()

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def drain(query: StreamingQuery) -> None:
    """Read-your-writes: wait until everything that has arrived is stored."""
    query.processAllAvailable()


def close(query: StreamingQuery) -> None:
    drain(query)
    query.stop()


def velocity_stream(entries: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """Entries of each second of event time as a stream: window start and n. Seconds older than the watermark are closed."""
    ts = F.timestamp_micros(int_div(F.col("ts_ns"), 1000))
    return entries.withColumn("ts", ts).withWatermark("ts", watermark).groupBy(F.window("ts", "1 second")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("second"), "n")
