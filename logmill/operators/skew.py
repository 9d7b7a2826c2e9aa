"""Per-key results when a handful of keys holds most rows: two-stage salted aggregation.

Stage 0 finds the heavy keys with a mergeable frequent-items sketch. Heavy is a key that may hold more than a fraction of a
task's fair share of the rows, so the more tasks the finer the sketch, and what it misses is too light to hold one up. Stage 1 aggregates by
key and salt, where a heavy key has many salts and every other key one. Stage 2 merges the partial results
by key. The salt is derived from a row's own columns, so that a task that runs again gives the same rows.

Results don't depend on which keys stage 0 calls heavy; only the balance does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.functions.entries import count_once, day_name, label_terms, service_key, utc_day_number, valid_ts
from logmill.session import materialize

#: How each partial result merges.
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


#: A key with this part of a task's fair share of rows is salted. Spark's sketch can name so many keys, with so many counters.
FAIR_PART, MOST_KEYS, MOST_TRACKED = 4, 100_000, 1_000_000


def heavy_keys(df: DataFrame, key: Column, tasks: int | None = None) -> list:
    """The keys that may hold more than 1 / (FAIR_PART tasks) of all rows; at most FAIR_PART tasks keys do.

    Tasks are the session's shuffle partitions unless told otherwise. The driver gets at most FAIR_PART tasks values,
    whatever the size of df; give it hashes. Null keys are passed over; an empty df gives none.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = min(MOST_KEYS, max(1000, FAIR_PART * tasks))
    top = df.select(key.alias("k")).filter("k is not null").select(
        F.expr(f"transform(approx_top_k(k, {k}, {min(MOST_TRACKED, 16 * k)}), x -> x.item)").alias("top")
    )
    row = top.first()
    return list(row["top"] or []) if row else []


def salted_aggregate(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, tuple[str, Column]], salt_by: Column, heavy: Column, salts: int = 64) -> DataFrame:
    """Aggregate df by keys in two stages.

    aggs maps an output name to (kind, column), kind one of count, sum, min, max. heavy is true for rows of heavy
    keys; these spread over `salts` partial groups by the hash of salt_by, the others form one partial group each.

    Null keys form groups as in groupBy. Empty input gives no rows. A count of a null column counts only non-null
    values, as in SQL. Columns of df other than keys and those the aggregates name are not read.
    """
    named = [df[k].alias(f"k{i}") for i, k in enumerate(keys)]
    values = [c.alias(f"v{i}") for i, (_, c) in enumerate(aggs.values())]
    salt = F.when(F.coalesce(heavy, F.lit(False)), F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    rows = df.select(*named, *values, salt.alias("salt"))
    ks = [f"k{i}" for i in range(len(keys))]
    first = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    partial = rows.groupBy(*ks, "salt").agg(*[first[kind](f"v{i}").alias(f"v{i}") for i, (kind, _) in enumerate(aggs.values())])
    merged = partial.groupBy(*ks).agg(*[MERGE[kind](f"v{i}").alias(f"v{i}") for i, (kind, _) in enumerate(aggs.values())])
    return merged.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *[F.col(f"v{i}").alias(name) for i, name in enumerate(aggs)])


def salted_join(rows: DataFrame, few: DataFrame, key: str, row_id: str, salts: int = 16) -> DataFrame:
    """Left join of rows with few, one row per key, where a few keys hold most of rows.

    Each row of few is repeated per salt, so a hot key's rows spread over `salts` tasks. Null keys match nothing. Columns of
    few must not clash with those of rows, but for the key.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def _terms_of(service: Column, terms: Column) -> Column:
    """The keys one entry counts for, with a letter for their field: the day itself, its service key, each label term once."""
    own = F.array(F.lit("d"), F.concat(F.lit("s"), service))
    return F.concat(F.filter(own, lambda t: t.isNotNull()), F.transform(F.array_distinct(terms), lambda t: F.concat(F.lit("l"), t)))


def daily_keys(logs: DataFrame, salts: int = 64) -> DataFrame:
    """Entries and errors of each UTC day (day, field, term, n, n_error, day_n) for every service key and label term.

    Entries count once by id, and only with a valid ts_ns. A label term counts once per entry. Null services, null or
    empty labels and null values add no key, but the entry still counts in day_n. Ties and repeated rows change nothing;
    an empty table gives no rows; further columns of logs are not read.
    """
    rows = logs.filter(valid_ts(F.col("ts_ns"))).select(
        F.col("id").alias("i"), utc_day_number(F.col("ts_ns")).alias("d"), (F.col("level") >= 4).alias("e"), service_key(F.col("service")).alias("s"), label_terms(F.col("labels")).alias("l")
    )
    exploded = lambda df: df.select("i", "d", "e", F.explode(_terms_of(F.col("s"), F.col("l"))).alias("k"))
    key = F.xxhash64("d", "k")
    hot = heavy_keys(exploded(rows), key)
    counts = materialize(salted_aggregate(
        exploded(count_once(rows)), ["d", "k"],
        {"n": ("count", F.lit(1)), "n_error": ("sum", F.coalesce(F.col("e"), F.lit(False)).cast("bigint"))},
        salt_by=F.col("i"), heavy=key.isin(hot) if hot else F.lit(False), salts=salts,
    ))
    # A row per valid day: at most the 7,305 days of 2020 to 2039.
    days = counts.filter("k = 'd'").select("d", F.col("n").alias("day_n"))
    keys = counts.filter("k <> 'd'").join(F.broadcast(days), "d")
    field = F.when(F.col("k").startswith("s"), "service").otherwise("label")
    return keys.select(day_name(F.col("d")).alias("day"), field.alias("field"), F.expr("substring(k, 2)").alias("term"), "n", "n_error", "day_n")


def heavy_daily_keys(logs: DataFrame, share: float = 0.05) -> DataFrame:
    """The keys (day, field, term) that at least `share` of a day's entries hold. Rules as for daily_keys."""
    keys = daily_keys(logs)
    return keys.filter(F.col("n") >= F.col("day_n") * F.lit(share)).select("day", "field", "term")
