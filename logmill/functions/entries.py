"""Column expressions for the Entry table that many operators share.

Every function takes and returns Columns, so they fuse into one code-generated stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Valid event times, ns since the epoch: 2020-01-01 (inclusive) to 2040-01-01 (exclusive), UTC.
TS_FIRST = 1_577_836_800_000_000_000
TS_END = 2_208_988_800_000_000_000
HOUR_NS = 3_600_000_000_000
DAY_NS = 24 * HOUR_NS


def valid_ts(ts: Column) -> Column:
    """True where ts_ns lies in the accepted range; null ts_ns gives null, which a filter drops."""
    return (ts >= F.lit(TS_FIRST)) & (ts < F.lit(TS_END))


def utc_day_number(ts: Column) -> Column:
    """UTC day of ts_ns, in days since the epoch."""
    return int_div(ts, DAY_NS).cast("int")


def day_name(day: Column) -> Column:
    """A day since the epoch as yyyy-MM-dd."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM-dd")


def int_div(a: Column, b: int) -> Column:
    """Integer division that never passes through double."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def service_key(service: Column) -> Column:
    """lower(trim(service)); null stays null and is no key."""
    return F.lower(F.trim(service))


def label_terms(labels: Column) -> Column:
    """lower(key)=lower(value) of each pair whose value isn't null; repeated terms stay. Null labels give an empty array."""
    pairs = F.filter(F.map_entries(labels), lambda e: e["value"].isNotNull())
    terms = F.transform(pairs, lambda e: F.concat(F.lower(e["key"]), F.lit("="), F.lower(e["value"])))
    return F.coalesce(terms, F.array().cast("array<string>"))


def count_once(df: DataFrame) -> DataFrame:
    """Drop records delivered twice, which are alike in every column.

    The caller projects the id and the few columns it needs first, so that only those are shuffled.
    Rows with a null id are told apart by their other columns.
    """
    return df.distinct()
