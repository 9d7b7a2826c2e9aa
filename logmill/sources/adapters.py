"""The test tables as log entries, by rules that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def events_as_entries(events: DataFrame) -> DataFrame:
    """id, ts_ns, level, service, message, labels, data of the events table; event types stand for levels."""
    user, kind = F.col("user_id"), F.col("event_type")
    level = F.when(kind == "view", 1).when(kind == "click", 2).when(kind == "signup", 3).when(kind == "error", 4).when(kind == "purchase", 5).otherwise(0)
    return events.select(
        (F.col("event_id") + 1).alias("id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        level.cast("tinyint").alias("level"),
        F.concat(F.lit("svc-"), user % 8).alias("service"),
        F.concat_ws(" ", F.lit("user"), user.cast("string"), kind, F.col("props")).alias("message"),
        F.create_map(F.lit("env"), F.when(user % 2 == 0, "prod").otherwise("Staging"), F.lit("user"), user.cast("string")).alias("labels"),
        F.col("props").alias("data"),
    )


def documents_as_entries(documents: DataFrame) -> DataFrame:
    """Texts as messages, for text search: the source is the service."""
    level = (F.coalesce("n_chars", F.lit(0)) % 5 + 1).cast("tinyint")
    return documents.select(
        F.col("doc_id").alias("id"), F.lit(1_704_067_200_000_000_000).alias("ts_ns"), level.alias("level"), F.col("source").alias("service"),
        F.col("text").alias("message"), F.create_map(F.lit("lang"), F.coalesce("lang", F.lit(""))).alias("labels"), F.lit(None).cast("string").alias("data"),
    )


def _header(kind: str, ts: Column, user: Column) -> Column:
    host = F.concat(F.lit("host-"), user % 5)
    app = F.concat(F.lit("app"), user % 7, F.lit("["), user, F.lit("]"))
    if kind == "rfc3164":
        day = F.lpad(F.dayofmonth(ts).cast("string"), 2, " ")
        return F.concat(F.date_format(ts, "MMM"), F.lit(" "), day, F.lit(" "), F.date_format(ts, "HH:mm:ss"), F.lit(" "), host, F.lit(" "), app, F.lit(": "))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z "), host, F.lit(" "), app, F.lit(" "))


def events_as_frames(events: DataFrame, kind: str) -> DataFrame:
    """id, raw, sender: a syslog frame made from each event. kind: rfc3164, rfc3339, short (a time and two words) or plain (no time)."""
    user, ts = F.col("user_id"), F.col("ts").cast("timestamp")
    pri = F.concat(F.lit("<"), user % 24 * 8 + F.col("event_id") % 8, F.lit(">"))
    text = F.concat(F.lit("user "), user, F.lit(" did "), F.col("event_type"))
    if kind == "short":
        body = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "), F.col("event_type"), F.lit(" "), user)
    elif kind == "plain":
        body = F.concat(F.lit("just  some   words by "), user)
    elif kind == "version":
        body = F.concat(F.lit("1 "), _header("rfc3339", ts, user), text)
    else:
        body = F.concat(_header(kind, ts, user), text)
    return events.select((F.col("event_id") + 1).alias("id"), F.concat(pri, body).alias("raw"), F.concat(F.lit("10.0.0."), user % 9).alias("sender"))
