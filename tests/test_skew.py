import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from logmill.operators.skew import daily_keys, heavy_daily_keys, heavy_keys, salted_aggregate, salted_join
from tests.conftest import T0

DAY = 86_400_000_000_000


def test_daily_keys_match_brute_force(logs):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        labels = {k: rng.choice(["A", "a", "", None]) for k in rng.sample(["Env", "env", "zone"], rng.randint(0, 3))}
        rows.append({"id": i, "ts_ns": rng.choice([None, 0, T0 + rng.randrange(2 * DAY)]), "level": rng.choice([None, 0, 2, 4, 9]), "service": rng.choice([None, " Hot", "hot", "hot ", "cold", ""]), "labels": rng.choice([None, labels])})
    want, errors, days = Counter(), Counter(), Counter()
    for r in rows:
        if not r["ts_ns"]:
            continue
        day = "2024-01-01" if r["ts_ns"] < T0 + DAY else "2024-01-02"
        days[day] += 1
        keys = {("label", f"{k.lower()}={v.lower()}") for k, v in (r["labels"] or {}).items() if v is not None}
        if r["service"] is not None:
            keys.add(("service", r["service"].strip(" ").lower()))
        for k in keys:
            want[day, *k] += 1
            errors[day, *k] += (r["level"] or 0) >= 4
    got = {(r.day, r.field, r.term): (r.n, r.n_error, r.day_n) for r in daily_keys(logs(rows + rows[:50], "i d e s l n salt k0 term field day")).collect()}
    assert got == {k: (n, errors[k], days[k[0]]) for k, n in want.items()}
    heavy = {tuple(r) for r in heavy_daily_keys(logs(rows)).collect()}
    assert heavy == {k for k, n in want.items() if n >= 0.05 * days[k[0]]}


def test_empty_and_all_invalid(logs):
    assert daily_keys(logs([])).collect() == []
    assert heavy_daily_keys(logs([{"id": 1, "ts_ns": None}, {"id": 2, "ts_ns": 5}])).collect() == []


def test_salts_change_nothing(spark):
    df = spark.range(5000).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), "id", F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    aggs = {"n": ("count", F.col("v")), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}
    plain = df.groupBy("k").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    hot = heavy_keys(df, F.col("k").cast("string"))
    assert "0" in hot
    for heavy in (F.lit(False), F.lit(True), F.col("k").cast("string").isin(hot)):
        got = salted_aggregate(df, ["k"], aggs, F.col("id"), heavy, 8)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_every_key_that_could_hold_up_a_task_is_heavy(spark):
    """Three hot keys on each of 600 days, and a tail: all of them are found, as 1,000 places wouldn't do."""
    df = spark.range(600_000).select(F.when(F.col("id") % 4 > 0, F.concat_ws("-", F.col("id") % 3, F.floor(F.col("id") / 1000))).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("k"))
    share = df.groupBy("k").count().filter(f"count > {600_000 / 4 / 600}").collect()
    hot = set(heavy_keys(df, F.col("k"), tasks=600))
    assert len(share) == 0 or {r.k for r in share} <= hot
    hot = set(heavy_keys(df, F.col("k"), tasks=1000))
    want = {r.k for r in df.groupBy("k").count().filter("count > 200").collect()}
    assert len(want) == 1800 and want <= hot and len(hot) <= 4000
    assert heavy_keys(df.limit(0), F.col("k")) == [] and heavy_keys(spark.range(3).select(F.lit(None).cast("string").alias("k")), F.col("k")) == []


def test_heavy_group_is_spread(spark):
    df = spark.range(10_000).select(F.lit("hot").alias("k"), "id")
    rows = df.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16))).groupBy("k", "salt").count().collect()
    assert len(rows) == 16 and max(r["count"] for r in rows) < 2 * 10_000 / 16


def test_salted_join(spark):
    big = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(100)], "id bigint, k string")
    few = spark.createDataFrame([("a", 5)], "k string, v int")
    got = defaultdict(int)
    for r in salted_join(big, few, "k", "id", 4).collect():
        got[r.k, r.v] += 1
    assert got == {("a", 5): 66, (None, None): 34}
