"""Search plans over the log table: filter, hit count, histogram and row list, all declared as DataFrames."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.functions.entries import int_div
from logmill.plans.request import LogQuery
from logmill.schema import tags

SEVERITIES = ("debug", "info", "warn", "error", "fatal")
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _date(ns: int) -> str:
    days = min(max(ns // 86_400_000_000_000, -700_000), 2_900_000)
    return (_EPOCH + timedelta(days=days)).date().isoformat()


def build_filter(q: LogQuery, columns: list[str], promoted: tuple[str, ...] = ()) -> Column:
    """The condition of a normalised request: time range (both ends count), level, labels and text, all of them.

    If the table has a date column its bounds are added, since partitions can't be pruned by ts_ns. A selector on a label in
    `promoted` reads its own column lbl_<name>, which is pushed down to the scan; others look into tags. One on the service
    has its column read first, where the table tells which entries have a label of that name besides. The text is matched in
    any case, with no wildcards.
    """
    out = F.col("ts_ns").between(F.lit(q.start_ns), F.lit(q.end_ns))
    if "date" in columns:
        out &= F.col("date").between(F.lit(_date(q.start_ns)).cast("date"), F.lit(_date(q.end_ns)).cast("date"))
    if q.level:
        out &= F.col("level") == F.lit(q.level).cast("tinyint")
    for key, value in sorted(q.labels.items()):
        k, v = key.lower(), value.lower()
        if k == "service" and "service_label" in columns:
            out &= (F.col("service_lc") == F.lit(v)) | F.col("service_label")
        if k in promoted and f"lbl_{k}" in columns:
            out &= F.col(f"lbl_{k}") == F.lit(v)
        elif "tags" in columns:
            out &= F.array_contains("tags", f"{k}={v}")
        else:
            out &= F.array_contains(tags(F.col("service"), F.col("labels")), f"{k}={v}")
    if q.search:
        out &= F.contains(F.lower("message"), F.lower(F.lit(q.search)))
    return out


def matches(logs: DataFrame, q: LogQuery, promoted: tuple[str, ...] = ()) -> DataFrame:
    return logs.filter(build_filter(q, logs.columns, promoted))


def total_hits(logs: DataFrame, q: LogQuery) -> DataFrame:
    """One row: the number of matches, before any limit."""
    return matches(logs, q).agg(F.count(F.lit(1)).alias("total_hits"))


def _counted(logs: DataFrame, q: LogQuery) -> DataFrame:
    """Counts by bucket number, with every match in one; what lies beyond the last bucket keeps its own number."""
    n = int_div(F.col("ts_ns") - F.lit(q.start_ns), q.width_ns)
    if q.compat == "corrected":
        n = F.least(n, F.lit(q.buckets - 1))
    by = [F.count_if(F.col("level") == k + 1).alias(name) for k, name in enumerate(SEVERITIES)]
    return matches(logs, q).groupBy(n.alias("bucket")).agg(F.count(F.lit(1)).alias("total"), *by)


def histogram(logs: DataFrame, q: LogQuery) -> DataFrame:
    """Counts over time by severity, for every bucket of the window, also empty ones.

    Levels outside 1..5 count in total only. Matches beyond the last bucket, such as one exactly at the end, are in no
    bucket (in corrected mode they are in the last one).
    """
    spine = logs.sparkSession.range(0, q.buckets, 1, 1).withColumnRenamed("id", "bucket")
    counts = _counted(logs, q).filter(F.col("bucket").between(0, q.buckets - 1))
    # One row a bucket at most, and there are 300 buckets at most.
    joined = spine.join(F.broadcast(counts), "bucket", "left").fillna(0)
    return joined.select((F.col("bucket") * F.lit(q.width_ns) + F.lit(q.start_ns)).alias("timestamp"), "total", *SEVERITIES)


def projected(found: DataFrame, compat: str = "strict") -> DataFrame:
    """The columns of result rows: strictly without labels and with an id of 0."""
    if compat == "corrected":
        return found.select("id", "ts_ns", "level", "service", "message", "labels", "data")
    return found.select(F.lit(0).cast("bigint").alias("id"), "ts_ns", "level", "service", "message", "data")


def entries(logs: DataFrame, q: LogQuery) -> DataFrame:
    """The rows of a result, newest first: of the first `limit` matches in order of arrival (corrected: of the newest).

    Equal times are ordered by id. Strictly, rows come without labels and with an id of 0; corrected mode keeps both.
    """
    found = matches(logs, q)
    if q.compat == "corrected":
        return found.orderBy(F.desc("ts_ns"), F.asc("id")).limit(q.limit).transform(projected, q.compat)
    first = found.select("id", "ts_ns", "level", "service", "message", "data").orderBy("id").limit(q.limit)
    return first.orderBy(F.desc("ts_ns"), F.asc("id")).transform(projected)


@dataclass
class LogResult:
    entries: DataFrame
    histogram: DataFrame
    total_hits: int
    duration_ms: float

    def to_json(self) -> str:
        """The response body; no entries at all are null."""
        from logmill.functions.levels import NAMES

        rows = []
        for r in self.entries.collect():  # at most 10,000
            row = {"id": r["id"], "timestamp": r["ts_ns"], "level": NAMES[r["level"]] if r["level"] in range(6) else NAMES[0], "service": r["service"] or "", "message": r["message"] or ""}
            if "labels" in r and r["labels"]:
                row["labels"] = r["labels"]
            if r["data"]:
                row["data"] = _json_or_text(r["data"])
            rows.append(row)
        bars = [r.asDict() for r in self.histogram.orderBy("timestamp").collect()]  # at most 300
        return json.dumps({"entries": rows or None, "histogram": bars, "total_hits": self.total_hits, "duration_ms": self.duration_ms}, ensure_ascii=False)


def _json_or_text(data: str):
    try:
        return json.loads(data)
    except ValueError:
        return data


def run(logs: DataFrame, q: LogQuery, now_ns: int) -> LogResult:
    """Run a request. The hit count comes with the histogram, from one scan; the rows are another plan."""
    began = time.perf_counter()
    q = q.normalise(now_ns)
    spark = logs.sparkSession
    counts = _counted(logs, q).collect()  # at most one row a bucket, and those beyond the last
    by_bucket = {r["bucket"]: r for r in counts if 0 <= r["bucket"] < q.buckets}
    bars = [
        (q.start_ns + b * q.width_ns, *((by_bucket[b]["total"], *(by_bucket[b][s] for s in SEVERITIES)) if b in by_bucket else (0,) * 6)) for b in range(q.buckets)
    ]
    schema = "timestamp bigint, total bigint, " + ", ".join(f"{s} bigint" for s in SEVERITIES)
    return LogResult(entries(logs, q), spark.createDataFrame(bars, schema), sum(r["total"] for r in counts), (time.perf_counter() - began) * 1000)
