"""Incremental merge of late events: per arrival batch, partial aggregates are appended to a table and read combined.

The table is keyed by arrival batch, and a batch that runs again overwrites its own part. The clock lives in the table
too, as the highest event time up to each batch, so that a restart goes on where it was; and so do the ids that were
taken in, as a record delivered again in a later batch counts once. compact() merges the parts of earlier batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmill.functions.entries import HOUR_NS, valid_ts
from logmill.operators.late import CUTOFF_NS, combine, fates, partials

SCHEMAS = {
    "partials": "period bigint, batch bigint, n_on_time bigint, n_corrects bigint, n_dropped bigint, first_ts bigint, last_ts bigint",
    "refused": "id bigint, ts_ns bigint, period bigint",
    "ids": "id bigint",
}
#: Clocks kept: of the batch before one that may run again, and a few more.
KEEP_CLOCKS = 10


class PeriodTable:
    """Period aggregates in a folder that all executors share. Batches come one at a time, with growing numbers."""

    def __init__(self, spark: SparkSession, path: str, period_ns: int = HOUR_NS, cutoff_ns: int = CUTOFF_NS):
        self.spark, self.path, self.period_ns, self.cutoff_ns = spark, path.rstrip("/"), period_ns, cutoff_ns

    def _folder(self, *names: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str, key: str) -> list[int]:
        """Numbers of the complete parts of a kind."""
        p, fs = self._folder(kind, f"{key}=*", "_SUCCESS")
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in fs.globStatus(p) or [])

    def _drop(self, kind: str, key: str, number: int) -> None:
        p, fs = self._folder(kind, f"{key}={number}")
        fs.delete(p, True)

    def _read(self, kind: str, before: int | None = None) -> DataFrame:
        """A kind's rows of all batches, or of those before one: the merged part, and what came after it."""
        merged = self._numbers(f"{kind}_merged", "upto")[-1:]
        some = [n for n in self._numbers(kind, "arrived") if n > (merged[0] if merged else -1) and (before is None or n < before)]
        paths = [f"{self.path}/{kind}_merged/upto={n}" for n in merged] + [f"{self.path}/{kind}/arrived={n}" for n in some]
        return self.spark.read.schema(SCHEMAS[kind]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[kind])

    def clock(self, before: int) -> int | None:
        """The highest event time of all batches before this one."""
        last = [n for n in self._numbers("clocks", "arrived") if n < before][-1:]
        return self.spark.read.schema("clock bigint").parquet(f"{self.path}/clocks/arrived={last[0]}").first()[0] if last else None

    def merge(self, batch: DataFrame, number: int) -> DataFrame:
        """Take in one batch of entries (for foreachBatch). Returns its refused entries: id, ts_ns, period.

        A record whose id an earlier batch had is passed over. Only stored ids within the batch's range are read.
        """
        write = lambda df, kind: df.write.mode("overwrite").parquet(f"{self.path}/{kind}/arrived={number}")
        rows = batch.filter(valid_ts(F.col("ts_ns")) & F.col("id").isNotNull()).select("id", "ts_ns").persist()
        try:
            span = rows.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("ts_ns").alias("top")).first()
            clock = self.clock(number)
            known = self._read("ids", number).filter(F.col("id").between(span["low"], span["high"])) if span["low"] is not None else self._read("ids", number).limit(0)
            new = rows.join(known, "id", "left_anti")
            judged = fates(new, self.period_ns, self.cutoff_ns, clock0=clock).withColumn("batch", F.lit(number).cast("bigint"))
            write(partials(judged), "partials")
            write(judged.filter("fate = 'dropped'").select("id", "ts_ns", "period"), "refused")
            write(new.select("id").distinct().sort("id"), "ids")
        finally:
            rows.unpersist()
        tops = [t for t in (clock, span["top"]) if t is not None]
        write(self.spark.createDataFrame([(max(tops, default=None),)], "clock bigint"), "clocks")
        for n in self._numbers("clocks", "arrived")[:-KEEP_CLOCKS]:
            self._drop("clocks", "arrived", n)
        return self.spark.read.schema(SCHEMAS["refused"]).parquet(f"{self.path}/refused/arrived={number}")

    def compact(self, before: int) -> None:
        """Merge the parts of all batches before this one, which must not run again. A reader sees the old parts or the merged."""
        for kind in SCHEMAS:
            some = [n for n in self._numbers(kind, "arrived") if n < before]
            if not some:
                continue
            df = self._read(kind, before)
            if kind == "partials":
                df = combine(df).drop("n").withColumn("batch", F.lit(some[-1]).cast("bigint")).select("period", "batch", "n_on_time", "n_corrects", "n_dropped", "first_ts", "last_ts").coalesce(1)
            elif kind == "ids":
                df = df.sort("id")
            old = self._numbers(f"{kind}_merged", "upto")
            df.write.mode("overwrite").parquet(f"{self.path}/{kind}_merged/upto={some[-1]}")
            for n in some:
                self._drop(kind, "arrived", n)
            for n in old:
                self._drop(f"{kind}_merged", "upto", n)

    def read(self) -> DataFrame:
        """The corrected aggregates of each period."""
        return combine(self._read("partials"))

    def refused(self) -> DataFrame:
        return self._read("refused")
