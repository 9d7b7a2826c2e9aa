"""Command line: serve, and query, tail, stats and ingest over a stored log table.

    python -m logmill.cli serve -http :9428 -syslog :9429 -data DIR
    python -m logmill.cli query --store DIR -search TEXT -level ERROR -service NAME -limit 50
    python -m logmill.cli stats --store DIR
    python -m logmill.cli tail --store DIR -filter TEXT
    ... | python -m logmill.cli ingest --store DIR -service NAME
"""

from __future__ import annotations

import argparse
import itertools
import json
import sys
import time

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from logmill.functions.levels import INFO, NAMES, parse_level_name
from logmill.plans.request import CLI_LIMIT, LogQuery

BATCH_LINES = 100
#: Terminal colours by level name.
COLOURS = {"DEBUG": "\x1b[36m", "INFO": "\x1b[32m", "WARN": "\x1b[33m", "ERROR": "\x1b[31m", "FATAL": "\x1b[35m"}
RESET = "\x1b[0m"


def line(ts: Column, level: Column, service: Column, message: Column) -> Column:
    """An entry as a line: time in milliseconds, level padded to 5, service padded to 16, message."""
    pad = lambda c, n: F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" ["), pad(level, 5), F.lit("] "), pad(service, 16), F.lit(" "), message)


def show(ts_ns: int, level: str, service: str, message: str, colour: bool = True, dated: bool = True) -> str:
    """The same for one entry, outside of Spark, with colours."""
    stamp = time.strftime("%Y-%m-%d %H:%M:%S" if dated else "%H:%M:%S", time.gmtime(ts_ns // 1_000_000_000)) + f".{ts_ns // 1_000_000 % 1000:03d}"
    c, r = (COLOURS.get(level, RESET), RESET) if colour else ("", "")
    return f"{stamp} {c}[{level:<5}]{r} {service:<16} {message}"


def run_query(store, args, out=sys.stdout, now_ns: int | None = None) -> int:
    from logmill.plans.query import run

    q = LogQuery(level=parse_level_name(args.level) if args.level else 0, labels={"service": args.service} if args.service else {}, search=args.search, limit=args.limit)
    got = run(store.read(), q, now_ns or time.time_ns())
    print(f"{got.total_hits} entries match ({got.duration_ms:.3f} ms)\n", file=out)
    for r in got.entries.collect():  # at most 10,000
        print(show(r["ts_ns"], NAMES[r["level"]] if r["level"] in range(6) else NAMES[0], r["service"] or "", r["message"] or ""), file=out)
    return 0


def run_stats(store, args, out=sys.stdout) -> int:
    from logmill.stats import RunningStats

    print(json.dumps(RunningStats(store).summary(), indent=2), file=out)
    return 0


def run_ingest(store, args, source=sys.stdin, out=sys.stdout) -> int:
    """Lines of the standard input as INFO entries, blank ones left out; batches of lines make one commit."""
    from logmill.schema import ENTRY
    from logmill.store import Ids

    ids, n = Ids(time.time_ns), 0
    lines = (x.strip() for x in source)
    for some in iter(lambda: list(itertools.islice((x for x in lines if x), BATCH_LINES * 100)), []):
        rows = [(i, time.time_ns(), INFO, args.service, text, None, None) for i, text in enumerate(some, ids.take(len(some)))]
        store.append(store.spark.createDataFrame(rows, ENTRY))
        n += len(some)
    print(f"{n} lines stored", file=out)
    return 0


def run_tail(store, args, out=sys.stdout, seconds: float | None = None) -> int:
    from logmill.streaming.tail import Hub, follow

    hub = Hub(compat=args.compat)
    inbox = hub.subscribe("cli", args.filter)
    stream = follow(store, hub)
    end = time.time() + seconds if seconds else None
    try:
        while end is None or time.time() < end:
            try:
                e = inbox.get(timeout=1)
            except Exception:  # nothing came
                continue
            print(show(e["ts_ns"], e["level_name"], e["service"] or "", e["message"] or "", dated=False), file=out)
    except KeyboardInterrupt:
        pass
    finally:
        stream.stop()
        hub.unsubscribe("cli")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logmill")
    sub = p.add_subparsers(dest="command", required=True)
    for name, options in {
        "query": [("search", ""), ("level", ""), ("service", ""), ("limit", CLI_LIMIT)], "tail": [("filter", ""), ("compat", "strict")], "stats": [], "ingest": [("service", "cli-client")],
    }.items():
        c = sub.add_parser(name)
        c.add_argument("--store", required=True)
        for option, default in options:
            c.add_argument(f"-{option}", f"--{option}", default=default, type=type(default))
    c = sub.add_parser("serve")
    for option, default in (("http", ":9428"), ("syslog", ":9429"), ("data", "./data"), ("compat", "strict")):
        c.add_argument(f"-{option}", f"--{option}", default=default)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    """Run a command in the caller's session, or the one that is active or that spark-submit configures, or else a local one."""
    from logmill.session import any_session
    from logmill.store import LogStore

    args = parser().parse_args(argv)
    spark = spark or any_session()
    if args.command == "serve":
        from logmill.server import main as run_server

        return run_server(spark, args, out)
    store = LogStore(spark, args.store)
    return {"query": run_query, "stats": run_stats, "ingest": run_ingest, "tail": run_tail}[args.command](store, args)


if __name__ == "__main__":
    sys.exit(main())
