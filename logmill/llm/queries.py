"""Queries of the problems on values and texts: p3, p4, p5, p7, p8, p9."""

from __future__ import annotations

from pyspark.sql import functions as F

from logmill.llm.leakage import leak_report, leaked_items
from logmill.llm.lossy import EPSILON, frequent_values
from logmill.llm.mixing import Mix
from logmill.llm.repetition import repetition
from logmill.llm.runs import collapse_runs
from logmill.llm.termcounts import entry_term_counts
from logmill.queries.tables import table

QUERIES = {
    "p3_found": lambda s, d: collapse_runs(table(s, d, "logs", True)),
    "p3_same_text": lambda s, d: collapse_runs(table(s, d, "logs", True), same=lambda message: message),
    "p4_found": lambda s, d: frequent_values(table(s, d, "logs"), "message", 0.002).select(F.col("value").alias("message")),
    "p4_counts": lambda s, d: frequent_values(table(s, d, "logs"), "message", 0.002).select(F.col("value").alias("message"), "n", "low", "high"),
    "p4_intervals": lambda s, d: frequent_values(table(s, d, "logs"), "message", 0.002).select(F.col("value").alias("message"), "n", F.col("n").between(F.col("low"), F.col("high")).alias("holds"), (F.col("high") - F.col("low") <= EPSILON * F.col("total")).alias("narrow")),
    "p5_found": lambda s, d: entry_term_counts(table(s, d, "logs", True)).filter("mark is not null").select("field", "term", "mark"),
    "p5_terms": lambda s, d: entry_term_counts(table(s, d, "logs", True)),
    "p7_found": lambda s, d: leaked_items(table(s, d, "documents", True), table(s, d, "eval_items")),
    "p7_items": lambda s, d: leak_report(table(s, d, "documents", True), table(s, d, "eval_items")),
    "p8_found": lambda s, d: Mix(table(s, d, "documents", True), table(s, d, "mix_targets")).report().filter("short").select("source"),
    "p8_report": lambda s, d: Mix(table(s, d, "documents", True), table(s, d, "mix_targets")).report(),
    "p8_copies": lambda s, d: Mix(table(s, d, "documents", True), table(s, d, "mix_targets")).copies(),
    "p9_found": lambda s, d: repetition(table(s, d, "documents", True)).filter("repetitive").select("doc_id"),
    "p9_repeated": lambda s, d: repetition(table(s, d, "documents", True)).select("doc_id", "n_words", "repeated", "said_before", "top_sentence"),
    "p9_shares": lambda s, d: repetition(table(s, d, "documents", True)).select("doc_id", "n_words", "repeated", "said_before", "top_sentence", "n_failed", "host_failure", "host_repetitive", "needed", "repetitive"),
}

_TERMS = """
WITH once AS (SELECT DISTINCT id, level, lower(trim(service)) AS s, labels FROM logs),
 k AS (SELECT id, labels, unnest(map_keys(labels)) AS k FROM once),
 t AS (SELECT id, 'service' AS field, s AS term FROM once WHERE s IS NOT NULL
       UNION ALL SELECT id, 'level', CASE level WHEN 1 THEN 'DEBUG' WHEN 2 THEN 'INFO' WHEN 3 THEN 'WARN' WHEN 4 THEN 'ERROR' WHEN 5 THEN 'FATAL' ELSE 'UNKNOWN' END FROM once WHERE level IS NOT NULL
       UNION ALL SELECT id, 'label', lower(k) || '=' || lower(labels[k]) FROM k WHERE labels[k] IS NOT NULL),
 c AS (SELECT field, term, count(*) AS n, count(DISTINCT id) AS n_entries FROM t GROUP BY 1, 2),
 m AS (SELECT *, CASE WHEN n_entries <= 2 THEN 'rare' WHEN n_entries >= 0.5 * (SELECT count(*) FROM once) THEN 'common' END AS mark FROM c)
"""

_CJK = "\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{ac00}-\\x{d7af}\\x{f900}-\\x{faff}"
_REPEATED = f"""
WITH d AS (SELECT doc_id, lower(trim(applicant)) AS host, regexp_split_to_array(lower(text), '[.!?;。！？；]+\\s*|\\n+') AS parts FROM documents),
 p AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM d),
 s AS (SELECT doc_id, k, regexp_extract_all(regexp_replace(part, '([{_CJK}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+') AS w FROM p),
 o AS (SELECT doc_id, k, w, array_to_string(w, '') AS whole, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY k) - len(w) AS before FROM s WHERE len(w) > 0),
 n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, whole ORDER BY k) AS nth, count(*) OVER (PARTITION BY doc_id, whole) AS times FROM o),
 t AS (SELECT doc_id, flatten(list(w ORDER BY k)) AS w FROM o GROUP BY 1),
 g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, hash(list_slice(w, i, i + 9)) ORDER BY i) AS nth FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM t)),
 m AS (SELECT doc_id, count(DISTINCT i) AS again FROM (SELECT doc_id, unnest(range(i, i + 10)) AS i FROM g WHERE nth > 1
       UNION ALL SELECT doc_id, unnest(range(CAST(before AS BIGINT) + 1, CAST(before AS BIGINT) + len(w) + 1)) FROM n WHERE nth > 1) GROUP BY 1),
 q AS (SELECT doc_id, sum(len(w)) AS n_words, sum(CASE WHEN nth > 1 THEN length(whole) ELSE 0 END) / sum(length(whole)) AS said, max(CASE WHEN times >= 3 THEN times * length(whole) ELSE 0 END) / sum(length(whole)) AS top FROM n GROUP BY 1),
 v AS (SELECT doc_id, host, coalesce(n_words, 0) AS n_words, coalesce(again, 0) / greatest(1, coalesce(n_words, 0)) AS repeated, coalesce(said, 0) AS said, coalesce(top, 0) AS top
       FROM d LEFT JOIN q USING (doc_id) LEFT JOIN m USING (doc_id)),
 f AS (SELECT *, repeated >= 0.45 OR said >= 0.40 OR top >= 0.25 AS failed FROM v),
 h AS (SELECT host, count(*) AS n, count(*) FILTER (failed) AS bad FROM f WHERE host IS NOT NULL GROUP BY 1),
 mean AS (SELECT sum(bad) / sum(n) AS mu, sum(n * (bad / n) * (bad / n)) / sum(n) AS square, count(*) / sum(n) AS part FROM h WHERE n >= 2),
 prior AS (SELECT mu, CASE WHEN square - mu * mu - mu * (1 - mu) * part > 1e-9 THEN least(1000, greatest(1, mu * (1 - mu) / (square - mu * mu - mu * (1 - mu) * part) - 1)) ELSE 1000 END AS size FROM mean),
 shrunk AS (SELECT host, (bad + mu * size) / (n + size) AS rate, mu FROM h, prior),
 judged AS (SELECT f.*, 0.45 - CASE WHEN rate IS NULL THEN 0 ELSE greatest(-0.03, least(0.03, 0.01 * (ln(rate / (1 - rate)) - ln(mu / (1 - mu))))) END AS needed FROM f LEFT JOIN shrunk USING (host))
"""
_SIZES = """
WITH s AS (SELECT source, sum(length(text)) AS size FROM documents WHERE source IN (SELECT source FROM mix_targets) GROUP BY 1)
"""

SQL = {
    # The order, gaps and counts of runs; the masks of values have no like in SQL and are tested on their own.
    "p3_same_text": """
WITH once AS (SELECT DISTINCT id, ts_ns, lower(trim(service)) AS s, message FROM logs WHERE ts_ns >= 1577836800000000000 AND ts_ns < 2208988800000000000 AND service IS NOT NULL AND message <> ''),
 b AS (SELECT *, CASE WHEN lag(message) OVER w = message AND ts_ns - lag(ts_ns) OVER w <= 300000000000 THEN 0 ELSE 1 END AS new FROM once WINDOW w AS (PARTITION BY s ORDER BY ts_ns, id)),
 k AS (SELECT *, sum(new) OVER (PARTITION BY s ORDER BY ts_ns, id ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT s AS service, arg_min(id, (ts_ns, id)) AS first_id, count(*) AS n_entries, max(ts_ns) - min(ts_ns) AS duration_ns FROM k GROUP BY s, run HAVING count(*) >= 3""",
    "p4_intervals": """WITH once AS (SELECT DISTINCT id, message FROM logs)
SELECT message, count(*) AS n, true AS holds, true AS narrow FROM once WHERE message <> '' GROUP BY 1 HAVING count(*) >= 0.002 * (SELECT count(*) FROM once)""",
    "p4_found": "WITH once AS (SELECT DISTINCT id, message FROM logs) SELECT message FROM once WHERE message <> '' GROUP BY 1 HAVING count(*) >= 0.002 * (SELECT count(*) FROM once)",
    "p5_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p5_terms": _TERMS + "SELECT field, term, n, n_entries, mark FROM m",
    # Characters stand for tokens: the cases don't depend on the tokenizer.
    "p8_found": _SIZES + "SELECT source FROM mix_targets LEFT JOIN s USING (source) WHERE coalesce(size, 0) * max_repeats < target_share * (SELECT sum(size) FROM s)",
    "p9_found": _REPEATED + "SELECT doc_id FROM judged WHERE repeated >= needed",
    "p9_repeated": _REPEATED + "SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, repeated, said AS said_before, top AS top_sentence FROM judged",
}
