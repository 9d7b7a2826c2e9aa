"""Search requests: defaults, clamps and the decoding of HTTP bodies and parameters."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.functions.levels import UNKNOWN, parse_level, parse_level_name

DAY_NS = 86_400_000_000_000
MINUTE_NS = 60_000_000_000
DEFAULT_LIMIT, MOST_LIMIT = 100, 10_000
DEFAULT_BUCKETS, MOST_BUCKETS = 30, 300
CLI_LIMIT = 50
#: Most bytes read of a request body; what goes beyond is cut off.
QUERY_BODY_BYTES = 1 << 20
#: Parameters that aren't label selectors.
PARAMETERS = frozenset({"search", "limit", "level", "start", "end"})


@dataclass(frozen=True)
class LogQuery:
    """One search. Times are ns since the epoch, level is a code where 0 means any."""

    start_ns: int = 0
    end_ns: int = 0
    level: int = UNKNOWN
    labels: Mapping[str, str] = field(default_factory=dict)
    search: str = ""
    limit: int = 0
    buckets: int = 0
    #: strict keeps every quirk of the engine this one is compatible with; corrected does what its users expect.
    compat: str = "strict"

    def normalise(self, now_ns: int) -> LogQuery:
        """With defaults filled in: an end of 0 is now, a start of 0 is a day before the end.

        A limit outside 1..10000 becomes 100. Bucket counts below 1 become 30, above 300 become 300.
        """
        end = self.end_ns or now_ns
        return replace(
            self,
            end_ns=end,
            start_ns=self.start_ns or end - DAY_NS,
            limit=self.limit if 0 < self.limit <= MOST_LIMIT else DEFAULT_LIMIT,
            buckets=DEFAULT_BUCKETS if self.buckets <= 0 else min(self.buckets, MOST_BUCKETS),
        )

    @property
    def width_ns(self) -> int:
        """Width of a histogram bucket; a window of no or negative length counts as a minute."""
        span = self.end_ns - self.start_ns
        return max(1, (span if span > 0 else MINUTE_NS) // self.buckets)


def normalised(requests: DataFrame) -> DataFrame:
    """LogQuery.normalise for a table of requests (request_id, asked_ns, start_time, end_time, level, limit_n, histogram_buckets)."""
    given = lambda c: F.nullif(F.col(c), F.lit(0).cast("bigint"))
    end = F.coalesce(given("end_time"), F.col("asked_ns"))
    n, b = F.coalesce("limit_n", F.lit(0)), F.coalesce("histogram_buckets", F.lit(0))
    return requests.select(
        "request_id", F.coalesce(given("start_time"), end - F.lit(DAY_NS)).alias("start_ns"), end.alias("end_ns"),
        F.when(F.coalesce("level", F.lit("")) == "", UNKNOWN).otherwise(parse_level(F.col("level"))).cast("bigint").alias("level"),
        F.when((n > 0) & (n <= MOST_LIMIT), n).otherwise(DEFAULT_LIMIT).cast("bigint").alias("row_limit"),
        F.when(b <= 0, DEFAULT_BUCKETS).otherwise(F.least(b, F.lit(MOST_BUCKETS))).cast("bigint").alias("buckets"),
    )


def _fitting(body: Any) -> dict[str, Any] | None:
    """The fields of a decoded body, None if any has a wrong type. Names match in any case; unknown ones are ignored."""
    if not isinstance(body, dict):
        return None
    kinds = {"start_time": int, "end_time": int, "level": str, "labels": dict, "search": str, "limit": int, "histogram_buckets": int}
    out: dict[str, Any] = {}
    for k, v in body.items():
        name = k.lower()
        if name not in kinds or v is None:
            continue
        if not isinstance(v, kinds[name]) or isinstance(v, bool):
            return None
        if name == "labels" and not all(isinstance(x, str) for x in v.values() if x is not None):
            return None
        out[name] = {a: b or "" for a, b in v.items()} if name == "labels" else v
    return out


def _whole(text: str | None) -> int | None:
    try:
        return int(text) if text and text.strip() == text and "_" not in text else None
    except ValueError:
        return None


def from_http(body: bytes | str | None = None, params: Mapping[str, str | list[str]] | None = None) -> LogQuery:
    """The request that a POST body and URL parameters make up; parameters win.

    A body that doesn't decode is ignored as a whole. Every parameter but search, limit, level, start and end is a label
    selector by its first value, histogram_buckets too, which only a body can set.
    """
    q = LogQuery(limit=DEFAULT_LIMIT)
    if body:
        raw = body.encode() if isinstance(body, str) else body
        try:
            got = _fitting(json.loads(raw[:QUERY_BODY_BYTES]))
        except ValueError:
            got = None
        if got is not None:
            limit = got.get("limit", 0)
            q = LogQuery(
                start_ns=got.get("start_time", 0), end_ns=got.get("end_time", 0), level=parse_level_name(got["level"]) if got.get("level") else UNKNOWN,
                labels=got.get("labels", {}), search=got.get("search", ""), limit=limit if limit > 0 else DEFAULT_LIMIT, buckets=got.get("histogram_buckets", 0),
            )
    labels = dict(q.labels)
    for name, value in (params or {}).items():
        v = value if isinstance(value, str) else (value[0] if value else "")
        if name not in PARAMETERS:
            labels[name] = v
        elif name == "search" and v:
            q = replace(q, search=v)
        elif name == "level" and v:
            q = replace(q, level=parse_level_name(v))
        elif (n := _whole(v)) is not None:
            if name == "limit" and n > 0:
                q = replace(q, limit=n)
            elif name == "start":
                q = replace(q, start_ns=n)
            elif name == "end":
                q = replace(q, end_ns=n)
    return replace(q, labels=labels)
