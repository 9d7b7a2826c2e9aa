"""The canonical log table.

ts_ns is the time of record, since Spark's timestamps end at microseconds; ts and date are derived from it. tags holds
lower(key)=lower(value) for the service and each label, and is what label selectors look up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logmill.functions.entries import int_div
from logmill.functions.levels import level_name

#: What decoders give and operators need at least.
ENTRY = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("ts_ns", T.LongType()), T.StructField("level", T.ByteType()), T.StructField("service", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("labels", T.MapType(T.StringType(), T.StringType())), T.StructField("data", T.StringType()),
])
FIELDS = [f.name for f in ENTRY.fields]


def tags(service: Column, labels: Column) -> Column:
    """All tags of an entry. A label named service shares its tags with the service column."""
    own = F.array(F.concat(F.lit("service="), F.lower(F.coalesce(service, F.lit("")))))
    pairs = F.transform(F.map_entries(labels), lambda e: F.concat(F.lower(e["key"]), F.lit("="), F.lower(F.coalesce(e["value"], F.lit("")))))
    return F.concat(own, F.coalesce(pairs, F.array().cast("array<string>")))


def canonical(entries: DataFrame) -> DataFrame:
    """Entries with the derived columns: ts, date, level_name, service_lc and tags."""
    us = int_div(F.col("ts_ns"), 1000)
    return entries.select(*FIELDS).withColumns({
        "ts": F.timestamp_micros(us), "date": F.to_date(F.timestamp_micros(us)), "level_name": level_name(F.col("level")),
        "service_lc": F.lower("service"), "tags": tags(F.col("service"), F.col("labels")),
    })


def raw_bytes() -> Column:
    """Bytes an entry is charged with: service, message and data, and 24 for the rest."""
    return text_bytes() + F.lit(24)


def text_bytes() -> Column:
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
    return size("service") + size("message") + size("data")
