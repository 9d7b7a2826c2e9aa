"""Queries of the log store: every operator on the events table as log entries, with the SQL that checks it."""

from __future__ import annotations

from dataclasses import replace
from hashlib import sha1
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.functions.entries import HOUR_NS, int_div
from logmill.functions.levels import level_from_json, level_name, parse_level
from logmill.functions.syslog import parse_syslog, priority, severity_level, tokens
from logmill.plans import query as plan
from logmill.plans.request import DAY_NS, LogQuery, normalised
from logmill.queries.tables import table
from logmill.schema import canonical, raw_bytes
from logmill.session import checkpoint_dir
from logmill.sources.adapters import documents_as_entries, events_as_entries, events_as_frames
from logmill.sources.lines import decode_lines, default_ts, text_entries
from logmill.stats import chunk_stats, file_stats, stats_summary, total_bytes, velocity
from logmill.store import LogStore, dense_ids
from logmill.streaming.ingest import entries_of, ingest, watch

#: 2024-01-31T00:00:00Z stands for now.
NOW = 1_706_659_200_000_000_000
START, END = 1_704_412_800_000_000_000, 1_705_017_600_000_000_000  # a week of January
SPAN = END - START
CHUNK = 1000
Q = LogQuery(start_ns=START, end_ns=END, limit=100, buckets=30).normalise(NOW)
#: The whole table, for all that isn't about the time range.
FIRST = 1_704_067_200_000_000_000
ALL = {"start_ns": FIRST, "end_ns": NOW}


def _events(s, d) -> DataFrame:
    return events_as_entries(table(s, d, "events"))


def _logs(s, d) -> DataFrame:
    return canonical(_events(s, d))


def _rows(df: DataFrame) -> DataFrame:
    return df.select("id", "ts_ns", "level", "service", "message")


def _filter(**changes):
    q = replace(Q, **changes).normalise(NOW)
    return lambda s, d: _rows(plan.matches(_logs(s, d), q))


def _histogram(**changes):
    q = replace(Q, **changes).normalise(NOW)
    return lambda s, d: plan.histogram(_logs(s, d), q)


def _syslog(kind: str):
    def run(s, d):
        got = parse_syslog(events_as_frames(table(s, d, "events", True), kind), NOW)
        label = lambda k: F.element_at("labels", F.lit(k)).alias(k)
        return got.select("id", "ts_ns", "level", "service", "message", label("host"), label("facility"), label("sender"))

    return run


def _pri(s, d):
    f = events_as_frames(table(s, d, "events"), "plain")
    rest, pri, _ = priority(F.col("raw"))
    return f.select("id", pri.alias("pri"), F.shiftright(pri, 3).alias("facility"), pri.bitwiseAND(F.lit(7).cast("bigint")).alias("severity"), rest.alias("rest"))


def _severities(s, d):
    f = events_as_frames(table(s, d, "events"), "plain")
    _, pri, _ = priority(F.col("raw"))
    return f.groupBy(pri.bitwiseAND(F.lit(7).cast("bigint")).alias("severity"), severity_level(pri).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def _tokens(s, d):
    t = tokens(F.col("message"))
    return _events(s, d).select("id", F.size(t).cast("bigint").alias("n"), F.array_join(t, "|").alias("joined"))


def _ndjson(s, d):
    e = events_as_entries(table(s, d, "events", True))
    line = F.to_json(F.struct(F.col("ts_ns").alias("timestamp"), level_name(F.col("level")).alias("level"), "service", "message", "labels"))
    bad = F.when(F.col("id") % 10 == 0, F.lit("{broken")).otherwise(line)
    got = decode_lines(e.select("id", bad.alias("value")), now_ns=NOW)
    return got.select("id", "ts_ns", "level", "service", "message", F.element_at("labels", "env").alias("env"))


def _text_lines(s, d):
    got = text_entries(_events(s, d).select("id", F.col("message").alias("value")), NOW)
    return got.select("id", "ts_ns", "level", "service", "message")


def _json_levels(s, d):
    """The level of each search request as JSON text: every third as it is, every third quoted, others as numbers or null."""
    r = table(s, d, "searches").select("request_id", "level", "limit_n").distinct()
    k = F.pmod("request_id", F.lit(4))
    text = F.when(k == 0, F.concat(F.lit('"'), F.col("level"), F.lit('"'))).when(k == 1, F.col("limit_n").cast("string")).when(k == 2, "null")
    return r.select("request_id", level_from_json(text).cast("bigint").alias("code"))


def _requests(s, d):
    """The search requests with their defaults filled in, each once."""
    return normalised(table(s, d, "searches").select("request_id", "asked_ns", "start_time", "end_time", "level", "search", "limit_n", "histogram_buckets").distinct())


def _folder(s, d, *names: str) -> str:
    """A folder of this session's own for what a query writes, beside its checkpoints."""
    return "/".join((checkpoint_dir(s), "logmill-queries", s.sparkContext.applicationId, sha1(d.encode()).hexdigest()[:12], *names))


_BUILT: dict[str, LogStore] = {}


def _store(s, d) -> LogStore:
    """The events in a store, once a session: the first two weeks compacted, two days of these as one commit more, the rest as it was appended."""
    path = _folder(s, d, "store")
    if path not in _BUILT:
        store, events = LogStore(s, path, ("env", "user")), _events(s, d)
        late = F.col("id") % 7 == 3
        sealed = F.col("ts_ns") < F.lit(END)
        store.append(events.filter(sealed & ~late))
        for day in store.read().select("date").distinct().sort("date").limit(3).collect():
            store.compact(str(day["date"]))
        store.append(events.filter(sealed & late))
        store.append(events.filter(~sealed))
        _BUILT[path] = store
    return _BUILT[path]


def _stored(**changes):
    q = replace(Q, **changes).normalise(NOW)
    return lambda s, d: _rows(plan.matches(_store(s, d).read(), q, _store(s, d).promoted))


def _streamed(s, d):
    """NDJSON files taken in by a stream, as the store has them."""
    name = uuid4().hex
    lines, store = _folder(s, d, name, "lines"), LogStore(s, _folder(s, d, name, "store"))
    fields = F.struct(F.col("ts_ns").alias("timestamp"), level_name(F.col("level")).alias("level"), "service", "message", "labels")
    events_as_entries(table(s, d, "events", True)).select(F.to_json(fields)).write.text(lines)
    query = ingest(entries_of(watch(s, lines), "ndjson", 0), store, _folder(s, d, name, "checkpoint"), lambda: NOW, {"availableNow": True})
    query.awaitTermination()
    return store.read().select("ts_ns", "level", "service", "message", F.element_at("labels", "env").alias("env"))


def _node_stats(s, d):
    """Per node: samples, what was ingested over all restarts of its counter, and the busiest sample."""
    from pyspark.sql import Window

    r = table(s, d, "engine_stats").select("sample_id", "node", "sampled_at", "total_ingested", "ingest_velocity_ops").distinct().filter("total_ingested is not null and sampled_at is not null")
    w = Window.partitionBy("node").orderBy("sampled_at", "sample_id")
    before = F.lag("total_ingested").over(w)
    grown = F.when(before.isNull() | (F.col("total_ingested") < before), F.col("total_ingested")).otherwise(F.col("total_ingested") - before)
    return r.withColumn("grown", grown).groupBy("node").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("grown").alias("ingested"), F.max("ingest_velocity_ops").alias("top_velocity"))


def _cli_line(s, d):
    from logmill.cli import line

    return _logs(s, d).select("id", line(F.col("ts"), F.col("level_name"), F.col("service"), F.col("message")).alias("line"))


QUERIES = {
    "filter_time_range": lambda s, d: _rows(_events(s, d).filter(plan.build_filter(Q, ["ts_ns"]))),
    "filter_time_range_pruned": _stored(),
    "filter_default_window": lambda s, d: _rows(plan.matches(_logs(s, d), LogQuery().normalise(NOW - DAY_NS))),
    "filter_level": _filter(level=4, **ALL),
    "filter_service_ci": _filter(labels={"Service": "SVC-3"}, **ALL),
    "filter_label": _filter(labels={"ENV": "staging"}, **ALL),
    "filter_substring_ci": _filter(search="ERROR {", **ALL),
    "filter_compound": _filter(level=4, labels={"env": "PROD", "service": "svc-2"}, search="user 1", **ALL),
    "filter_text_documents": lambda s, d: canonical(documents_as_entries(table(s, d, "documents"))).filter(F.contains(F.lower("message"), F.lower(F.lit("\u00dcBER")))).select("id", "service"),
    "project_entry": lambda s, d: plan.projected(_logs(s, d)),
    "project_data_json": lambda s, d: _logs(s, d).select("id", "data", F.get_json_object("data", "$.k").cast("bigint").alias("k")),
    "agg_total_hits": lambda s, d: plan.total_hits(_logs(s, d), replace(Q, level=2, **ALL)),
    "agg_histogram_total": lambda s, d: plan.histogram(_logs(s, d), replace(Q, **ALL)).select("timestamp", "total"),
    "agg_histogram_by_level": _histogram(**ALL),
    "agg_histogram_zero_fill": _histogram(labels={"user": "17"}, buckets=120, **ALL),
    "agg_histogram_edge": _histogram(end_ns=START + 7 * HOUR_NS, buckets=11),
    "agg_histogram_zero_span": _histogram(start_ns=START, end_ns=START),
    "agg_inverted_range": _histogram(start_ns=END, end_ns=START),
    "agg_histogram_bucket_clamp": _histogram(buckets=301, **ALL),
    "agg_chunk_stats": lambda s, d: chunk_stats(_events(s, d), CHUNK),
    "agg_raw_bytes": lambda s, d: _events(s, d).agg(F.sum(raw_bytes()).alias("raw_bytes")),
    "agg_total_bytes": lambda s, d: total_bytes(_events(s, d)),
    "agg_velocity_per_second": lambda s, d: velocity(_events(s, d)),
    "stats_summary": lambda s, d: stats_summary(_events(s, d), CHUNK).drop("compression_ratio_pct"),
    "stats_by_node": _node_stats,
    "limit_ingest_order": lambda s, d: plan.matches(_logs(s, d), replace(Q, level=5)).orderBy("id").limit(25).select("id", "ts_ns"),
    "limit_normalised": lambda s, d: plan.entries(_logs(s, d), replace(Q, limit=10_001).normalise(NOW)).select("ts_ns", "message"),
    "sort_ts_desc": lambda s, d: plan.entries(_logs(s, d), replace(Q, limit=50, search="purchase")).select("ts_ns", "service"),
    "requests_normalised": _requests,
    "scan_union_hot_cold": lambda s, d: _store(s, d).read().groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ts")),
    "scan_text_lines": _text_lines,
    "scan_ndjson_roundtrip": _ndjson,
    "ingest_assign_id": lambda s, d: dense_ids(_events(s, d).drop("id"), "ts_ns", width=HOUR_NS).select("id", "ts_ns", "message"),
    "scalar_parse_level": lambda s, d: table(s, d, "searches").select("request_id", "level").distinct().select("request_id", parse_level(F.col("level")).cast("bigint").alias("code")),
    "scalar_level_name": lambda s, d: table(s, d, "logs").select("id", "level").distinct().groupBy(level_name(F.col("level")).alias("name")).agg(F.count(F.lit(1)).alias("n")),
    "scalar_level_from_json": _json_levels,
    "scalar_lower_match": lambda s, d: table(s, d, "documents").select("doc_id", F.contains(F.lower("title"), F.lower(F.lit("UND"))).alias("hit"), F.lower("applicant").alias("applicant_lc")),
    "scalar_default_ts": lambda s, d: table(s, d, "logs").select("id", "ts_ns").distinct().select("id", default_ts(F.col("ts_ns"), NOW).alias("ts_ns")),
    "syslog_pri_decode": _pri,
    "syslog_severity_map": _severities,
    "syslog_tokenise": _tokens,
    "syslog_parse_plain": _syslog("plain"),
    "syslog_parse_rfc3164": _syslog("rfc3164"),
    "syslog_parse_rfc3339": _syslog("rfc3339"),
    "syslog_parse_short": _syslog("short"),
    "syslog_parse_fallback": _syslog("version"),
    "store_label": _stored(labels={"ENV": "Staging", "user": "17"}, **ALL),
    "store_service": _stored(labels={"service": "SVC-3"}, **ALL),
    "store_compound": _stored(level=4, labels={"env": "PROD", "service": "svc-2"}, search="user 1"),
    "store_histogram": lambda s, d: plan.histogram(_store(s, d).read(), replace(Q, **ALL)),
    "store_total": lambda s, d: file_stats(_store(s, d)).agg(F.sum("n").alias("n"), F.min("min_ts").alias("first_ts"), F.max("max_ts").alias("last_ts"), F.sum("raw_bytes").alias("raw_bytes")),
    "stream_ingest": _streamed,
    "format_cli_line": _cli_line,
    "ext_topk_newest": lambda s, d: plan.entries(_logs(s, d), replace(Q, limit=40, compat="corrected")).select("id", "ts_ns", "service"),
    "ext_label_or": lambda s, d: _logs(s, d).filter(F.arrays_overlap("tags", F.array(F.lit("user=17"), F.lit("user=18")))).select("id", "service"),
    "ext_label_not": lambda s, d: _logs(s, d).filter(~F.array_contains("tags", "env=prod")).select("id"),
    "ext_label_numeric": lambda s, d: _logs(s, d).filter(F.element_at("labels", "user").try_cast("double") > 50).select("id"),
    "ext_regex": lambda s, d: _logs(s, d).filter(F.col("message").rlike(r"user \d+5 (click|view) ")).select("id", "message"),
    "ext_count_by_service": lambda s, d: _logs(s, d).groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") >= 4).alias("n_error")),
}

_E = """
WITH e AS (SELECT event_id + 1 AS id, epoch_us(ts) * 1000 AS ts_ns,
  CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 4 WHEN 'purchase' THEN 5 ELSE 0 END AS TINYINT) AS level,
  'svc-' || (user_id % 8) AS service, 'user ' || user_id || ' ' || event_type || ' ' || props AS message,
  CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'Staging' END AS env, user_id, event_id, event_type, props AS data, ts FROM events)
"""
_ALL = {"start": FIRST, "end": NOW}
_IN = f"ts_ns BETWEEN {START} AND {END}"


def _select(where: str, columns: str = "id, ts_ns, level, service, message", tail: str = "") -> str:
    return f"{_E} SELECT {columns} FROM e WHERE {where} {tail}"


def _hist(where: str = "true", start: int = START, end: int = END, buckets: int = 30, only_total: bool = False) -> str:
    width = max(1, (end - start if end > start else 60_000_000_000) // buckets)
    levels = "" if only_total else "".join(f", CAST(coalesce(sum(CASE WHEN level = {k} THEN 1 ELSE 0 END), 0) AS BIGINT) AS {n}" for k, n in enumerate(plan.SEVERITIES, 1))
    return f"""{_E}, h AS (SELECT *, (ts_ns - {start}) // {width} AS b FROM e WHERE ts_ns BETWEEN {start} AND {end} AND {where})
SELECT {start} + range * {width} AS timestamp, count(h.id) AS total{levels} FROM range({buckets}) LEFT JOIN h ON h.b = range GROUP BY range"""


def _frames(ts: str, service: str, message: str, host: str, level_from: str = "event_id % 8") -> str:
    return f"""{_E} SELECT id, CAST({ts} AS BIGINT) AS ts_ns, CAST(CASE WHEN {level_from} <= 3 THEN 4 WHEN {level_from} = 4 THEN 3 WHEN {level_from} = 7 THEN 1 ELSE 2 END AS TINYINT) AS level,
 {service} AS service, {message} AS message, {host} AS host, CAST(user_id % 24 AS VARCHAR) AS facility, '10.0.0.' || (user_id % 9) AS sender FROM e"""


_HOST = "'host-' || (user_id % 5)"
_APP = "'app' || (user_id % 7) || '[' || user_id || ']'"
_LEVEL_OF = """CASE WHEN {0} IN ('DEBUG', 'DBG', 'TRACE') THEN 1 WHEN {0} IN ('INFO', 'INF', 'NOTICE') THEN 2 WHEN {0} IN ('WARN', 'WARNING') THEN 3
 WHEN {0} IN ('ERROR', 'ERR') THEN 4 WHEN {0} IN ('FATAL', 'CRITICAL', 'EMERGENCY', 'PANIC') THEN 5 ELSE 2 END""".format
_WORD = "upper(regexp_replace(level, '^\\s+|\\s+$', '', 'g'))"
_NAME = "CASE level WHEN 1 THEN 'DEBUG' WHEN 2 THEN 'INFO' WHEN 3 THEN 'WARN' WHEN 4 THEN 'ERROR' WHEN 5 THEN 'FATAL' ELSE 'UNKNOWN' END"

SQL = {
    "filter_time_range": _select(_IN),
    "filter_time_range_pruned": _select(_IN),
    "filter_default_window": _select(f"ts_ns BETWEEN {NOW - 2 * DAY_NS} AND {NOW - DAY_NS}"),
    "filter_level": _select("level = 4"),
    "filter_service_ci": _select("lower(service) = 'svc-3'"),
    "filter_label": _select("lower(env) = 'staging'"),
    "filter_substring_ci": _select("contains(lower(message), 'error {')"),
    "filter_compound": _select("level = 4 AND env = 'prod' AND service = 'svc-2' AND contains(lower(message), 'user 1')"),
    "filter_text_documents": "SELECT doc_id AS id, source AS service FROM documents WHERE contains(lower(text), 'über')",
    "project_entry": _select("true", "CAST(0 AS BIGINT) AS id, ts_ns, level, service, message, data"),
    "project_data_json": f"{_E} SELECT id, data, CAST(json_extract_string(data, '$.k') AS BIGINT) AS k FROM e",
    "agg_total_hits": _select("level = 2", "count(*) AS total_hits"),
    "agg_histogram_total": _hist(**_ALL, only_total=True),
    "agg_histogram_by_level": _hist(**_ALL),
    "agg_histogram_zero_fill": _hist("user_id = 17", **_ALL, buckets=120),
    "agg_histogram_edge": _hist(end=START + 7 * HOUR_NS, buckets=11),
    "agg_histogram_zero_span": _hist(end=START),
    "agg_inverted_range": _hist(start=END, end=START),
    "agg_histogram_bucket_clamp": _hist(**_ALL, buckets=300),
    "agg_chunk_stats": f"{_E} SELECT (id - 1) // {CHUNK} AS chunk, count(*) AS n, min(ts_ns) AS min_ts, max(ts_ns) AS max_ts, CAST(sum(strlen(service) + strlen(message) + strlen(data) + 24) AS BIGINT) AS raw_bytes FROM e GROUP BY 1",
    "agg_raw_bytes": _select("true", "CAST(sum(strlen(service) + strlen(message) + strlen(data) + 24) AS BIGINT) AS raw_bytes"),
    "agg_total_bytes": _select("true", "CAST(sum(strlen(service) + strlen(message) + strlen(data)) AS BIGINT) AS total_bytes"),
    "agg_velocity_per_second": f"{_E} SELECT ts_ns // 1000000000 AS second, count(*) AS n FROM e GROUP BY 1",
    "stats_summary": f"""{_E}, s AS (SELECT ts_ns // 1000000000 AS s, count(*) AS n FROM e GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total_ingested, arg_max(n, s) AS ingest_velocity_ops, CAST(1 AS BIGINT) AS active_chunks, CAST(sum(n) // {CHUNK} AS BIGINT) AS sealed_chunks,
 CAST(0 AS BIGINT) AS ring_buffer_queued, CAST(0 AS BIGINT) AS subscribers_count FROM s""",
    "stats_by_node": """WITH r AS (SELECT DISTINCT sample_id, node, sampled_at, total_ingested, ingest_velocity_ops FROM engine_stats WHERE total_ingested IS NOT NULL AND sampled_at IS NOT NULL),
 g AS (SELECT *, lag(total_ingested) OVER (PARTITION BY node ORDER BY sampled_at, sample_id) AS p FROM r)
SELECT node, count(*) AS n_samples, CAST(sum(CASE WHEN p IS NULL OR total_ingested < p THEN total_ingested ELSE total_ingested - p END) AS BIGINT) AS ingested, max(ingest_velocity_ops) AS top_velocity FROM g GROUP BY 1""",
    "limit_ingest_order": _select(f"{_IN} AND level = 5", "id, ts_ns", "ORDER BY id LIMIT 25"),
    "limit_normalised": _select(_IN, "ts_ns, message", "ORDER BY id LIMIT 100"),
    "sort_ts_desc": _select(f"{_IN} AND contains(lower(message), 'purchase')", "ts_ns, service", "ORDER BY id LIMIT 50"),
    "requests_normalised": f"""WITH r AS (SELECT DISTINCT request_id, asked_ns, nullif(start_time, 0) AS s, coalesce(nullif(end_time, 0), asked_ns) AS t, level, search, coalesce(limit_n, 0) AS n, coalesce(histogram_buckets, 0) AS b FROM searches)
SELECT request_id, coalesce(s, t - {DAY_NS}) AS start_ns, t AS end_ns, CAST(CASE WHEN coalesce(level, '') = '' THEN 0 ELSE {_LEVEL_OF(_WORD)} END AS BIGINT) AS level,
 CAST(CASE WHEN n > 0 AND n <= 10000 THEN n ELSE 100 END AS BIGINT) AS row_limit, CAST(CASE WHEN b <= 0 THEN 30 ELSE least(b, 300) END AS BIGINT) AS buckets FROM r""",
    "scan_union_hot_cold": f"{_E} SELECT service, count(*) AS n, min(ts_ns) AS first_ts FROM e GROUP BY 1",
    "scan_text_lines": _select("true", f"id, CAST({NOW} AS BIGINT) AS ts_ns, CAST(2 AS TINYINT) AS level, 'default' AS service, message"),
    "scan_ndjson_roundtrip": _select("id % 10 <> 0", "id, ts_ns, level, service, message, env"),
    "ingest_assign_id": f"{_E} SELECT row_number() OVER (ORDER BY ts_ns) AS id, ts_ns, message FROM e",
    "scalar_parse_level": f"SELECT DISTINCT request_id, CAST({_LEVEL_OF(_WORD)} AS BIGINT) AS code FROM (SELECT DISTINCT request_id, level FROM searches)",
    "scalar_level_name": f"SELECT {_NAME} AS name, count(*) AS n FROM (SELECT DISTINCT id, level FROM logs) GROUP BY 1",
    "scalar_level_from_json": f"""SELECT request_id, CAST(CASE request_id % 4 WHEN 0 THEN CASE WHEN level IS NULL THEN 0 ELSE {_LEVEL_OF(_WORD)} END
 WHEN 1 THEN CASE WHEN limit_n IS NULL THEN 0 WHEN limit_n BETWEEN 0 AND 255 THEN limit_n ELSE 2 END WHEN 2 THEN 2 ELSE 0 END AS BIGINT) AS code
FROM (SELECT DISTINCT request_id, level, limit_n FROM searches)""",
    "scalar_lower_match": "SELECT doc_id, contains(lower(title), 'und') AS hit, lower(applicant) AS applicant_lc FROM documents",
    "scalar_default_ts": f"SELECT id, CASE WHEN coalesce(ts_ns, 0) = 0 THEN {NOW} ELSE ts_ns END AS ts_ns FROM (SELECT DISTINCT id, ts_ns FROM logs)",
    "syslog_pri_decode": f"{_E} SELECT id, user_id % 24 * 8 + event_id % 8 AS pri, user_id % 24 AS facility, event_id % 8 AS severity, 'just  some   words by ' || user_id AS rest FROM e",
    "syslog_severity_map": f"{_E} SELECT event_id % 8 AS severity, CAST(CASE WHEN event_id % 8 <= 3 THEN 4 WHEN event_id % 8 = 4 THEN 3 WHEN event_id % 8 = 7 THEN 1 ELSE 2 END AS TINYINT) AS level, count(*) AS n FROM e GROUP BY 1, 2",
    "syslog_tokenise": f"{_E} SELECT id, CAST(2 + 1 + 2 AS BIGINT) AS n, replace(message, ' ', '|') AS joined FROM e",
    "syslog_parse_plain": _frames(str(NOW), "'system'", "'just  some   words by ' || user_id", "CAST(NULL AS VARCHAR)"),
    "syslog_parse_rfc3164": _frames("ts_ns // 1000000000 * 1000000000", _APP, "'user ' || user_id || ' did ' || event_type", _HOST),
    "syslog_parse_rfc3339": _frames("ts_ns", _APP, "'user ' || user_id || ' did ' || event_type", _HOST),
    "syslog_parse_short": _frames("ts_ns // 1000000000 * 1000000000", "'system'", "event_type || ' ' || user_id", "CAST(NULL AS VARCHAR)"),
    "syslog_parse_fallback": _frames(
        str(NOW), "'system'", f"'1 ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z ' || {_HOST} || ' ' || {_APP} || ' user ' || user_id || ' did ' || event_type", "CAST(NULL AS VARCHAR)"
    ),
    "store_label": _select("env = 'Staging' AND user_id = 17"),
    "store_service": _select("service = 'svc-3'"),
    "store_compound": _select(f"{_IN} AND level = 4 AND env = 'prod' AND service = 'svc-2' AND contains(lower(message), 'user 1')"),
    "store_histogram": _hist(**_ALL),
    "store_total": _select("true", "CAST(count(*) AS BIGINT) AS n, min(ts_ns) AS first_ts, max(ts_ns) AS last_ts, CAST(sum(strlen(service) + strlen(message) + strlen(data) + 24) AS BIGINT) AS raw_bytes"),
    "stream_ingest": _select("true", "ts_ns, level, service, message, env"),
    "format_cli_line": f"{_E} SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' [' || rpad({_NAME}, 5, ' ') || '] ' || rpad(service, 16, ' ') || ' ' || message AS line FROM e",
    "ext_topk_newest": _select(_IN, "id, ts_ns, service", "ORDER BY ts_ns DESC, id LIMIT 40"),
    "ext_label_or": _select("user_id IN (17, 18)", "id, service"),
    "ext_label_not": _select("lower(env) <> 'prod'", "id"),
    "ext_label_numeric": _select("user_id > 50", "id"),
    "ext_regex": _select("regexp_matches(message, 'user \\d+5 (click|view) ')", "id, message"),
    "ext_count_by_service": f"{_E} SELECT service, count(*) AS n, count(*) FILTER (level >= 4) AS n_error FROM e GROUP BY 1",
}
