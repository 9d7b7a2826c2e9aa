"""Stretches of one log statement repeated in a row, each collapsed into one event with count and duration.

Only boundary rows are kept: those whose statement differs from their predecessor's, or that come too long after it. The
next boundary's position gives a stretch's count, the time before it the stretch's end.

A service's stream is cut into blocks of time, so that a service with a third of all rows is many tasks. Stretches that
touch the edge of a block are matched over blocks in a second step, which reads two rows a block at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmill.functions.entries import HOUR_NS, int_div, service_key, valid_ts

#: Rows that a block of the busiest service should hold about, at most.
BLOCK_ROWS = 500_000
#: Stands for a filled-in value; every digit of the message has become part of one.
VALUE = "0"

# Each alternative begins at the start of a word and never gives back, so that long words take linear time.
_CHARS = r"[\p{L}\p{N}_.:\-]"
_VALUES = "|".join(
    (
        r'"[^"]*"', r"(?<![\p{L}\p{N}])'[^']*'", r"`[^`]*`",  # quoted text
        r"(?<![\p{L}\p{N}+.\-])[\p{L}\p{N}+.\-]++://[^\s,;)\]]*+", r"(?<![\p{L}\p{N}_.+\-])[\p{L}\p{N}_.+\-]++@[\p{L}\p{N}_.\-]++",  # addresses
        r"(?<![^\s=(\[,:])(?:[.~]{1,2}|[A-Za-z]:)?[/\\][^\s,;)\]]*",  # paths
        rf"(?<![\p{{L}}_.:\-])[\p{{L}}_.:\-]*+\p{{N}}{_CHARS}*+",  # numbers, and words with a digit
        rf"(?<!{_CHARS}){_CHARS}*?(?<![\p{{L}}\p{{N}}])[0-9a-f]{{8,}}+(?![\p{{L}}\p{{N}}]){_CHARS}*+",  # hexadecimal ids without a digit
    )
)
_JSON_STRING = r'"(?:[^"\\]|\\.)*+"\s*'
_JSON_NAME = r'\s*"((?:[^"\\]|\\.)*+)"\s*:\s*'


def statement(message: Column) -> Column:
    """The statement behind a message: lower case, values masked, blanks joined, marks at the end taken off.

    JSON messages keep their names; their strings are values like any quoted text. Null stays null; a message of marks alone
    gives ''.
    """
    low = F.lower(message)
    named = F.regexp_replace(F.regexp_replace(low, _JSON_NAME, " $1: "), _JSON_STRING, VALUE)
    masked = F.regexp_replace(F.when(low.startswith("{"), named).otherwise(low), _VALUES, VALUE)
    return F.regexp_replace(F.regexp_replace(masked, r"[\s\p{Z}\p{C}]+", " "), r"^ |(?<![\p{P}\p{S}\p{Z}])[\p{P}\p{S}\p{Z}]++$", "")


def block_width(rows: DataFrame, service: str, ts: str, most: int = BLOCK_ROWS) -> int:
    """Width in ns of the blocks of time in which the busiest service has about `most` rows in its busiest hour at most.

    One number from one pass over two columns; it changes how the work is cut, not the result.
    """
    busiest = rows.groupBy(service, int_div(F.col(ts), HOUR_NS).alias("h")).count().agg(F.max("count")).first()[0] or 1
    per_hour = max(1, -(-busiest // most))
    return max(1, HOUR_NS // per_hour) if per_hour > 1 else HOUR_NS * max(1, min(24, most // busiest))


def collapse_runs(logs: DataFrame, least: int = 3, gap_ns: int = 300_000_000_000, width_ns: int | None = None, same: Callable[[Column], Column] = statement) -> DataFrame:
    """Maximal stretches of at least `least` consecutive entries of one statement: service, first_id, n_entries, duration_ns.

    Messages for which `same` gives the same are of one statement. Entries of one service key are ordered by ts_ns, then id; neighbours in a stretch are at most gap_ns apart. Entries
    without a valid ts_ns, a service or a non-empty message take no part, neither do they interrupt. Replayed rows count
    once. Rows with a null id take part and come first among equal times. Messages of any length are read whole. An empty
    table gives no rows; further columns are not read.
    """
    rows = logs.filter(valid_ts(F.col("ts_ns")) & F.col("service").isNotNull() & (F.col("message") != "")).select(
        F.col("id").alias("i"), F.col("ts_ns").alias("t"), service_key(F.col("service")).alias("s"), F.xxhash64(same(F.col("message"))).alias("m")
    )
    if width_ns is None:
        slim = logs.filter(valid_ts(F.col("ts_ns")) & F.col("service").isNotNull()).select(service_key(F.col("service")).alias("s"), F.col("ts_ns").alias("t"))
        width_ns = block_width(slim, "s", "t")
    rows = rows.withColumn("b", int_div(F.col("t"), width_ns))
    w = Window.partitionBy("s", "b").orderBy("t", "i")
    # Copies of a record have its time and id, so they lie side by side.
    once = rows.withColumn("same", (F.lag("t").over(w) == F.col("t")) & F.lag("i").over(w).eqNullSafe(F.col("i")) & F.lag("m").over(w).eqNullSafe(F.col("m"))).filter("not coalesce(same, false)")
    seen = once.select("*", F.lag("m").over(w).alias("pm"), F.lag("t").over(w).alias("pt"), F.row_number().over(w).alias("pos"),
                       F.count(F.lit(1)).over(Window.partitionBy("s", "b")).alias("size"), F.max("t").over(Window.partitionBy("s", "b")).alias("top"))
    starts = seen.filter((F.col("pos") == 1) | (F.col("pm") != F.col("m")) | (F.col("t") - F.col("pt") > F.lit(gap_ns)))
    runs = starts.select(
        "s", "b", "m", "i", "t", (F.col("pos") == 1).alias("first"), F.lead("pos").over(w).isNull().alias("last"),
        (F.coalesce(F.lead("pos").over(w), F.col("size") + 1) - F.col("pos")).alias("n"), F.coalesce(F.lead("pt").over(w), F.col("top")).alias("e"),
    )
    # Stretches inside a block are whole. Those at its edges form one order per service.
    edge = F.col("first") | F.col("last")
    kept = runs.filter(edge | (F.col("n") >= least)).withColumn("g", F.when(edge, F.lit(None).cast("bigint")).otherwise(F.col("b")))
    v = Window.partitionBy("s", "g").orderBy("t", "i")
    goes_on = F.col("g").isNull() & (F.lag("m").over(v) == F.col("m")) & (F.lag("b").over(v) != F.col("b")) & (F.col("t") - F.lag("e").over(v) <= F.lit(gap_ns))
    joined = kept.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("k", F.sum("new").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    whole = joined.groupBy("s", "g", "k").agg(F.sum("n").alias("n"), F.min("t").alias("t"), F.max("e").alias("e"), F.min_by("i", "t").alias("i"))
    return whole.filter(F.col("n") >= least).select(F.col("s").alias("service"), F.col("i").alias("first_id"), F.col("n").alias("n_entries"), (F.col("e") - F.col("t")).alias("duration_ns"))
