"""Per-period aggregates by event time that late records correct until a cut-off.

1. `arrivals` are mergeable partial aggregates per period and arrival batch, stored once. They hold no order within a batch.
2. `clocks` merges them in order of arrival: the clock, the highest event time that arrived, before and after each batch.
3. `fates` tells for each entry how it stood against the clock. Before and after a batch decide most periods of it as a
   whole: those still open after it, and those closed before it, which take nothing more. Only in between, the entries'
   own order within the batch is looked at.
4. `partials` counts by fate, per period and arrival batch, and `combine` merges these on read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmill.functions.entries import HOUR_NS, int_div, valid_ts
from logmill.operators.prefix import carry_in
from logmill.session import materialize

#: Ids of one arrival batch; a batch is sorted by one task.
BATCH = 1 << 16
CUTOFF_NS = 6 * HOUR_NS


def _period(t: Column, period_ns: int) -> Column:
    return int_div(t, period_ns) * F.lit(period_ns)


def _placed(logs: DataFrame, batch: int) -> DataFrame:
    return logs.filter(valid_ts(F.col("ts_ns")) & F.col("id").isNotNull()).select(F.col("id").alias("i"), F.col("ts_ns").alias("t"), int_div(F.col("id"), batch).alias("b"))


def arrivals(logs: DataFrame, period_ns: int = HOUR_NS, batch: int = BATCH) -> DataFrame:
    """Partial aggregates (period, batch, first_ts, last_ts) of entries with a valid ts_ns and an id."""
    rows = _placed(logs, batch)
    return rows.groupBy(_period(F.col("t"), period_ns).alias("period"), F.col("b").alias("batch")).agg(F.min("t").alias("first_ts"), F.max("t").alias("last_ts"))


def clocks(parts: DataFrame, clock0: int | None = None) -> DataFrame:
    """Per batch of arrivals(): clock_before (null if nothing came before) and clock_after. clock0 is an earlier table's clock."""
    tops = parts.groupBy("batch").agg(F.max("last_ts").alias("top"))
    before = F.col("carry") if clock0 is None else F.greatest(F.col("carry"), F.lit(clock0).cast("bigint"))
    joined = tops.join(carry_in(tops, [], "batch", "top", "max"), "batch")
    return joined.select("batch", before.alias("clock_before"), F.greatest(before, F.col("top")).alias("clock_after"))


def fates(logs: DataFrame, period_ns: int = HOUR_NS, cutoff_ns: int = CUTOFF_NS, batch: int = BATCH, clock0: int | None = None) -> DataFrame:
    """One row per entry with a valid ts_ns: id, ts_ns, period (its start), batch and fate.

    fate is on_time if the clock hasn't reached the period's end, corrects if it has, dropped if moreover the entry is
    more than cutoff_ns behind the clock. clock0 is the clock of everything that arrived before this table, if any.
    Rows with a null id have no place in the order and are left out. Replayed rows count once; equal times are no
    matter; an empty table gives no rows; further columns are not read.
    """
    known = clocks(materialize(arrivals(logs, period_ns, batch)), clock0)
    order = Window.partitionBy("b").orderBy("i")
    seen = _placed(logs, batch).join(known.withColumnRenamed("batch", "b"), "b").select(
        "i", "t", "b", "clock_before", "clock_after", F.lag("i").over(order).alias("p"), F.max("t").over(order.rangeBetween(Window.unboundedPreceding, -1)).alias("near")
    ).filter(F.col("p").isNull() | (F.col("p") != F.col("i")))
    out = seen.select(F.col("i").alias("id"), F.col("t").alias("ts_ns"), _period(F.col("t"), period_ns).alias("period"), F.col("b").alias("batch"), "clock_before", "clock_after", "near")
    end, behind = F.col("period") + F.lit(period_ns), lambda clock: clock - F.col("ts_ns") > F.lit(cutoff_ns)
    clock = F.greatest(F.col("clock_before"), F.col("near"))
    late = clock >= end
    fate = (
        F.when(F.col("clock_after") < end, "on_time")  # open after the batch
        .when((F.col("clock_before") >= end) & behind(F.col("clock_before")), "dropped")  # closed before it
        .when((F.col("clock_before") >= end) & ~behind(F.col("clock_after")), "corrects")
        .when(late & behind(clock), "dropped").when(late, "corrects").otherwise("on_time")
    )
    return out.withColumn("fate", fate).drop("clock_before", "clock_after", "near")


def partials(judged: DataFrame) -> DataFrame:
    """Mergeable aggregates (period, batch, n_on_time, n_corrects, n_dropped, first_ts, last_ts) of fates()."""
    kept = F.when(F.col("fate") != "dropped", F.col("ts_ns"))
    return judged.groupBy("period", "batch").agg(
        *[F.count_if(F.col("fate") == f).alias(f"n_{f}") for f in ("on_time", "corrects", "dropped")], F.min(kept).alias("first_ts"), F.max(kept).alias("last_ts")
    )


def combine(parts: DataFrame) -> DataFrame:
    """Per period: what was known on time, what late entries added, the corrected count and what was refused."""
    return parts.groupBy("period").agg(
        *[F.sum(f"n_{f}").alias(f"n_{f}") for f in ("on_time", "corrects", "dropped")], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    ).withColumn("n", F.col("n_on_time") + F.col("n_corrects"))


def hourly(logs: DataFrame) -> DataFrame:
    """Counts per hour by stored partial aggregates, merged on read."""
    return combine(materialize(partials(fates(logs))))


def late_cases(logs: DataFrame) -> DataFrame:
    """The late entries (id, fate), fate dropped or corrects, by hours and a cut-off of six hours."""
    return fates(logs).filter("fate <> 'on_time'").select("id", "fate")
