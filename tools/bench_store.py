"""

    PYTHONPATH=. python tools/bench_store.py /root/testdata/sf0.1 [COPIES [CPUS]]

The events table is repeated COPIES times (100 by default), each copy shifted by some seconds, and kept as a compacted store.
Prints one JSON line: seconds of the best of three runs, rows a second, and bytes stored per raw byte.
"""

from __future__ import annotations

import json
import sys
import tempfile
import time

from pyspark.sql import functions as F

from logmill.functions.levels import level_name
from logmill.functions.syslog import parse_syslog
from logmill.plans.query import entries, histogram, matches
from logmill.plans.request import LogQuery
from logmill.queries.reference import FIRST, NOW
from logmill.schema import raw_bytes
from logmill.session import local_session
from logmill.sources.adapters import events_as_entries, events_as_frames
from logmill.sources.frames import encode_batch, read_batches
from logmill.sources.lines import decode_lines
from logmill.store import LogStore

HOUR = 3_600_000_000_000


def best(run, times: int = 3) -> float:
    out = []
    for _ in range(times):
        began = time.perf_counter()
        run()
        out.append(time.perf_counter() - began)
    return round(min(out), 3)


def main(sf_dir: str, copies: int = 100, cpus: str = "8") -> None:
    spark = local_session(cpus, "bench_store", "16g")
    spark.sparkContext.setLogLevel("ERROR")
    noop = lambda df: lambda: df.write.format("noop").mode("overwrite").save()
    with tempfile.TemporaryDirectory() as folder:
        events = spark.read.parquet(f"{sf_dir}/events.parquet").repartition(int(cpus))
        many = events.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.col("c")))
        many = many.withColumn("event_id", F.col("event_id") * copies + F.col("c")).drop("c")
        rows = events_as_entries(many)
        store = LogStore(spark, f"{folder}/store", ("env",))
        began = time.perf_counter()
        store.append(rows.repartitionByRange(int(cpus) * 4, "ts_ns"))
        wrote = time.perf_counter() - began
        n, raw = store.read().agg(F.count(F.lit(1)), F.sum(raw_bytes())).first()
        q = LogQuery(start_ns=FIRST, end_ns=NOW, limit=100).normalise(NOW)
        change = lambda **k: LogQuery(**{"start_ns": FIRST, "end_ns": NOW, "limit": 100, **k}).normalise(NOW)
        seconds = {
            "equality (service, level), 100 rows": best(lambda: entries(store.read(), change(level=4, labels={"service": "svc-3"})).collect()),
            "equality, all matches counted": best(lambda: matches(store.read(), change(level=4, labels={"service": "svc-3"})).count()),
            "slice of one hour, counted": best(lambda: matches(store.read(), change(start_ns=FIRST + 200 * HOUR, end_ns=FIRST + 201 * HOUR)).count()),
            "substring, counted": best(lambda: matches(store.read(), change(search="user 77 ERROR")).count()),
            "histogram": best(lambda: histogram(store.read(), q).collect()),
        }
        part = events_as_entries(events.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(min(copies, 10) - 1)))))
        fields = F.struct(F.col("ts_ns").alias("timestamp"), level_name(F.col("level")).alias("level"), "service", "message", "labels")
        part.select(F.to_json(fields).alias("value")).write.text(f"{folder}/lines")
        events_as_frames(events.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(min(copies, 10) - 1)))), "rfc3164").write.parquet(f"{folder}/frames")
        some = part.select("ts_ns", "level", "service", "message").limit(200_000).collect()
        for k in range(10):
            with open(f"{folder}/batch-{k}.bin", "wb") as f:
                f.write(encode_batch([tuple(r) for r in some[k * 20_000 : (k + 1) * 20_000]]))
        m = spark.read.text(f"{folder}/lines").count()
        rate = lambda count, df: round(count / best(noop(df)))
        rates = {
            "store, rows written a second": round(n / wrote),
            "NDJSON strict": rate(m, decode_lines(spark.read.text(f"{folder}/lines"), now_ns=NOW)),
            "NDJSON fast": rate(m, decode_lines(spark.read.text(f"{folder}/lines"), decoder="fast", now_ns=NOW)),
            "syslog": rate(m, parse_syslog(spark.read.parquet(f"{folder}/frames"), NOW)),
            "binary batches": rate(len(some), read_batches(spark, f"{folder}/batch-*.bin", NOW)),
        }
        print(json.dumps({"rows": n, "seconds": seconds, "rows_per_second": rates, "stored_per_raw_byte": round(store.stored_bytes() / raw, 3)}))


if __name__ == "__main__":
    main(sys.argv[1], *(int(x) for x in sys.argv[2:3]), *sys.argv[3:4])
