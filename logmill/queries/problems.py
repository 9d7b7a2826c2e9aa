"""Queries of the core problems: skewed keys (p1), raw lines (p2) and late events (p6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logmill.operators.late import hourly, late_cases
from logmill.operators.logparse import entries_of_lines, parse_lines
from logmill.operators.skew import daily_keys, heavy_daily_keys
from logmill.queries.tables import table


def _hourly(spark, d):
    return hourly(table(spark, d, "logs")).select(F.col("period").alias("hour_ns"), "n_on_time", "n_corrects", "n_dropped", "n")


def _layouts(spark, d):
    """How many lines were headers, and of which level; a line that no header rule fits is one unparsed span."""
    lines = parse_lines(table(spark, d, "raw_entries", True)).select("id", "head", "level", "unparsed").distinct()
    return lines.groupBy("head", "level").agg(F.count(F.lit(1)).alias("n_lines"), F.count("unparsed").alias("n_unparsed"))


QUERIES = {
    "p1_found": lambda s, d: heavy_daily_keys(table(s, d, "logs", True)),
    "p1_daily_keys": lambda s, d: daily_keys(table(s, d, "logs", True)).select("day", "field", "term", "n", "n_error", "day_n"),
    "p2_found": lambda s, d: entries_of_lines(table(s, d, "raw_entries", True)),
    "p2_line_kinds": _layouts,
    "p6_found": lambda s, d: late_cases(table(s, d, "logs")),
    "p6_hourly": _hourly,
}

_VALID = "ts_ns IS NOT NULL AND ts_ns >= 1577836800000000000 AND ts_ns < 2208988800000000000"
_DAY_KEYS = f"""
WITH once AS (SELECT DISTINCT id, ts_ns, level, lower(trim(service)) AS s, labels FROM logs WHERE {_VALID}),
 e AS (SELECT id, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d') AS day, coalesce(level >= 4, false) AS err, s, labels FROM once),
 l AS (SELECT DISTINCT id, day, err, lower(k) || '=' || lower(labels[k]) AS term
       FROM (SELECT id, day, err, labels, unnest(map_keys(labels)) AS k FROM e) WHERE labels[k] IS NOT NULL),
 keys AS (SELECT day, 'service' AS field, s AS term, count(*) AS n, CAST(sum(CAST(err AS INT)) AS BIGINT) AS n_error FROM e WHERE s IS NOT NULL GROUP BY 1, 2, 3
          UNION ALL SELECT day, 'label', term, count(*), CAST(sum(CAST(err AS INT)) AS BIGINT) FROM l GROUP BY 1, 2, 3),
 days AS (SELECT day, count(*) AS day_n FROM e GROUP BY 1)
"""
_CLOCK = f"""
WITH once AS (SELECT DISTINCT id, ts_ns FROM logs WHERE {_VALID} AND id IS NOT NULL),
 c AS (SELECT id, ts_ns, ts_ns // 3600000000000 * 3600000000000 AS hour_ns, max(ts_ns) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock FROM once),
 f AS (SELECT *, CASE WHEN clock IS NULL OR clock < hour_ns + 3600000000000 THEN 'on_time' WHEN clock - ts_ns > 21600000000000 THEN 'dropped' ELSE 'corrects' END AS fate FROM c)
"""

SQL = {
    "p1_found": _DAY_KEYS + "SELECT day, field, term FROM keys JOIN days USING (day) WHERE n >= 0.05 * day_n",
    "p1_daily_keys": _DAY_KEYS + "SELECT day, field, term, n, n_error, day_n FROM keys JOIN days USING (day)",
    "p6_found": _CLOCK + "SELECT id, fate FROM f WHERE fate <> 'on_time'",
    "p6_hourly": _CLOCK + """
SELECT hour_ns, count(*) FILTER (fate = 'on_time') AS n_on_time, count(*) FILTER (fate = 'corrects') AS n_corrects,
 count(*) FILTER (fate = 'dropped') AS n_dropped, count(*) FILTER (fate <> 'dropped') AS n FROM f GROUP BY 1""",
}
