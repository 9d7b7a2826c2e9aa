"""The stored log table: Parquet by event date, sorted by time within files, Zstandard-compressed.

Appends are the hot set, many small files; compact() rewrites a date's files into few large ones. A reader sees both as
one table. Hot labels can have columns of their own, whose equality filters reach the scan.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.functions.entries import int_div
from logmill.operators.prefix import carry_in
from logmill.schema import canonical
from logmill.sources.lines import default_ts

#: Rows of a file, as of a sealed chunk.
CHUNK_ROWS = 50_000


def assign_ids(entries: DataFrame, offset: int = 0) -> DataFrame:
    """Ids above offset that grow in the order of the source; unique and monotone, not dense. No shuffle."""
    return entries.withColumn("id", F.monotonically_increasing_id() + F.lit(offset + 1))


def dense_ids(entries: DataFrame, order: str, offset: int = 0, width: int = 1 << 16) -> DataFrame:
    """Ids offset+1, offset+2, ... in the order of a bigint column, ties by all other columns' hash.

    Blocks of `width` values of the order are numbered apart; only their sizes meet. Nulls come first.
    """
    from pyspark.sql import Window

    plain = [c for c, t in entries.dtypes if not t.startswith("map") and c != "id"]
    rows = entries.withColumn("_b", F.coalesce(int_div(F.col(order), width), F.lit(-(2**62))))
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("n"))
    before = carry_in(sizes, [], "_b", "n", "sum")
    place = F.row_number().over(Window.partitionBy("_b").orderBy(F.col(order), F.xxhash64(*plain)))
    return rows.join(before, "_b", "left").withColumn("id", place + F.coalesce("carry", F.lit(0)) + F.lit(offset)).drop("_b", "carry")


class Ids:
    """Ids in order of arrival for everything that one process takes in: the time in ms, and 22 bits to count on."""

    def __init__(self, now_ns: Callable[[], int]):
        self.now_ns, self._next, self._lock = now_ns, 0, threading.Lock()

    def take(self, n: int) -> int:
        """The first of n ids in a row."""
        with self._lock:
            first = max(self._next, self.now_ns() // 1_000_000 << 22)
            self._next = first + n
        return first


def numbered(entries: DataFrame, take: Callable[[int], int]) -> tuple[DataFrame, int, int]:
    """Entries with ids in a row, in the order of the source, the first of which `take` gives for their number; that id and
    number. The driver gets a count for each partition. entries is computed twice: persist it."""
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["count"] for r in entries.groupBy(part.alias("p")).count().collect()}
    offsets, n = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(n)
        n += sizes.get(p, 0)
    first = take(n)
    before = F.element_at(F.array(*[F.lit(o).cast("bigint") for o in offsets]), part + 1) if offsets else F.lit(0)
    return entries.withColumn("id", place + before + F.lit(first).cast("bigint")), first, n


def prepare(entries: DataFrame, now_ns: int) -> DataFrame:
    """Entries as they are ingested: a time of 0 is now."""
    return entries.withColumn("ts_ns", default_ts(F.col("ts_ns"), now_ns))


class LogStore:
    """A folder of log entries, shared by all executors."""

    def __init__(self, spark: SparkSession, path: str, promoted: Sequence[str] = ()):
        self.spark, self.path, self.promoted = spark, path.rstrip("/"), tuple(p.lower() for p in promoted)

    def _columns(self, entries: DataFrame) -> DataFrame:
        df = canonical(entries)
        # Selects on the service read its column, and tags only where a label goes by that name too.
        df = df.withColumn("service_label", F.coalesce(F.exists(F.map_keys("labels"), lambda k: F.lower(k) == "service"), F.lit(False)))
        for name in self.promoted:
            value = F.filter(F.map_entries("labels"), lambda e: F.lower(e["key"]) == name)  # noqa: B023
            df = df.withColumn(f"lbl_{name}", F.lower(F.try_element_at(value, F.lit(1))["value"]))
        return df

    def append(self, entries: DataFrame) -> None:
        """Add entries to the hot set. One commit: readers see all of them or none."""
        self._write(self._columns(entries), "append")

    def _write(self, df: DataFrame, mode: str) -> None:
        blooms = {f"parquet.bloom.filter.enabled#lbl_{n}": "true" for n in self.promoted}
        df.sortWithinPartitions("date", "ts_ns").write.mode(mode).partitionBy("date").options(
            compression="zstd", maxRecordsPerFile=CHUNK_ROWS, **{"parquet.bloom.filter.enabled#service_lc": "true"}, **blooms
        ).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def compact(self, date: str, rows_per_file: int = 5_000_000) -> int:
        """Rewrite one date's files into files of about rows_per_file rows, ordered by time. Returns the number of files.

        The new files are written beside the table first, then take the date's place in one overwrite of that partition.
        """
        part = self.read().filter(F.col("date") == F.lit(date).cast("date"))
        files = max(1, -(-part.count() // rows_per_file))
        aside = f"{self.path}_compact_{uuid.uuid4().hex}"
        part.repartitionByRange(files, "ts_ns").sortWithinPartitions("ts_ns").write.option("compression", "zstd").parquet(aside)
        try:
            self.spark.read.parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("date").parquet(self.path)
        finally:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(aside)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return files

    def stored_bytes(self) -> int:
        """Bytes of the table's files."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()

    def files(self) -> int:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/date=*/*.parquet")
        found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(folder)
        return 0 if found is None else len(found)

    def last_id(self) -> int:
        return self.read().agg(F.max("id")).first()[0] or 0

    def listing(self) -> dict[str, int]:
        """Path and size of each file."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/date=*/*.parquet")
        found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(folder)
        return {s.getPath().toString(): s.getLen() for s in found or []}


def union_hot_cold(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Compacted and fresh entries as one table, without looking for duplicates."""
    return cold.unionByName(hot)
