import http.client
import io
import json
import random
import struct
import threading
from argparse import Namespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from logmill import cli
from logmill.functions.levels import INFO, level_from_json, parse_level
from logmill.functions.syslog import parse_syslog
from logmill.plans.query import run
from logmill.plans.request import LogQuery, from_http
from logmill.schema import canonical
from logmill.service import Service, serve, ws_frame
from logmill.sources import frames
from logmill.sources.lines import _PLAIN, decode_body, decode_entry, decode_lines, read_text
from logmill.stats import file_stats, mean_savings
from logmill.store import LogStore, assign_ids
from logmill.streaming import ingest as streams
from logmill.streaming.syslog_server import SyslogListener, spooled
from logmill.streaming.tail import Hub
from tests.conftest import T0

MIN = 60_000_000_000


def fixture_rows(n=200, seed=1):
    rng = random.Random(seed)
    return [
        {"id": i + 1, "ts_ns": T0 + rng.randrange(-5, 70) * MIN // 10, "level": rng.choice([0, 1, 2, 3, 4, 5, 9]), "service": rng.choice(["api", "Auth"]), "message": rng.choice(["Login OK 100%", "disk_full", "login failed"]),
         "labels": rng.choice([None, {"Env": "PROD"}, {"env": "dev", "service": "x"}]), "data": None} for i in range(n)
    ]


def model(rows, q):
    """The search as plain loops."""
    hits = []
    for r in rows:
        tags = {f"{k}={v}".lower() for k, v in (r["labels"] or {}).items()} | {f"service={r['service']}".lower()}
        if q.start_ns <= r["ts_ns"] <= q.end_ns and (not q.level or r["level"] == q.level) and all(f"{k}={v}".lower() in tags for k, v in q.labels.items()) and q.search.lower() in r["message"].lower():
            hits.append(r)
    bars = [[q.start_ns + b * q.width_ns, 0, 0, 0, 0, 0, 0] for b in range(q.buckets)]
    for r in hits:
        b = (r["ts_ns"] - q.start_ns) // q.width_ns
        if b < q.buckets:
            bars[b][1] += 1
            if 1 <= r["level"] <= 5:
                bars[b][1 + r["level"]] += 1
    first = sorted(hits[: q.limit], key=lambda r: (-r["ts_ns"], r["id"]))
    return len(hits), [tuple(b) for b in bars], [(r["ts_ns"], r["message"]) for r in first]


@pytest.mark.parametrize("seed", range(6))
def test_search_matches_model(logs, seed):
    rng = random.Random(seed)
    rows = fixture_rows(seed=seed)
    q = LogQuery(
        start_ns=T0 + rng.randrange(3) * MIN, end_ns=T0 + rng.choice([1, 2, 5, 6]) * MIN + rng.randrange(3), level=rng.choice([0, 0, 2, 4]), search=rng.choice(["", "LOGIN", "100%", "_", "k_f"]),
        labels=rng.choice([{}, {"ENV": "prod"}, {"service": "AUTH"}, {"service": "x"}, {"no": "such"}]), limit=rng.choice([0, 5, 10_000, 10_001]), buckets=rng.choice([0, 7, 50, 301]),
    )
    got = run(canonical(logs(rows)), q, T0)
    hits, bars, first = model(rows, q.normalise(T0))
    assert got.total_hits == hits
    assert [tuple(r) for r in got.histogram.orderBy("timestamp").collect()] == bars
    assert [(r.ts_ns, r.message) for r in got.entries.collect()] == first
    assert (json.loads(got.to_json())["entries"] is None) == (not first)


def test_corrected_mode(logs):
    rows = fixture_rows()
    q = LogQuery(start_ns=T0, end_ns=max(r["ts_ns"] for r in rows), limit=3, compat="corrected")
    got = run(canonical(logs(rows)), q, T0)
    newest = sorted((r for r in rows if r["ts_ns"] >= T0), key=lambda r: (-r["ts_ns"], r["id"]))[:3]
    assert [r.id for r in got.entries.collect()] == [r["id"] for r in newest]
    assert got.histogram.agg(F.sum("total")).first()[0] == got.total_hits


def test_requests():
    assert from_http(None, {"service": ["a"], "histogram_buckets": ["10"], "limit": ["-1"], "level": ["bogus"], "start": ["x"]}) == LogQuery(limit=100, level=INFO, labels={"service": "a", "histogram_buckets": "10"})
    assert from_http('{"level": 3, "search": "x"}') == LogQuery(limit=100)  # a body that doesn't fit is ignored
    assert from_http('{"Level": "warn", "labels": {"a": "b"}, "limit": 7, "histogram_buckets": 5}', {"limit": "9", "a": "c"}) == LogQuery(level=3, labels={"a": "c"}, limit=9, buckets=5)
    n = LogQuery(limit=10_001, buckets=-1).normalise(T0)
    assert (n.limit, n.buckets, n.end_ns, n.start_ns) == (100, 30, T0, T0 - 24 * 60 * MIN)
    assert LogQuery(start_ns=5, end_ns=5).normalise(T0).width_ns == 2_000_000_000 and LogQuery(start_ns=1, end_ns=6, buckets=50).normalise(T0).width_ns == 1


def test_requests_of_a_table_are_as_single_ones(spark):
    from logmill.plans.request import normalised
    from logmill.queries.tables import table
    from tests.conftest import SF

    rows = table(spark, SF, "searches").select("request_id", "asked_ns", "start_time", "end_time", "level", "limit_n", "histogram_buckets").distinct()
    got = {r.request_id: r for r in normalised(rows).collect()}
    for r in rows.collect():
        from logmill.functions.levels import parse_level_name

        q = LogQuery(start_ns=r.start_time or 0, end_ns=r.end_time or 0, level=parse_level_name(r.level) if r.level else 0, limit=r.limit_n or 0, buckets=r.histogram_buckets or 0)
        if r.asked_ns is not None or q.end_ns:
            q = q.normalise(r.asked_ns)
            g = got[r.request_id]
            assert (g.start_ns, g.end_ns, g.level, g.row_limit, g.buckets) == (q.start_ns, q.end_ns, q.level, q.limit, q.buckets)


def test_store_queries_are_pruned(spark):
    """Dates, times, promoted labels and the service reach the scan of the registered queries' store."""
    from logmill.queries.reference import QUERIES
    from tests.conftest import SF

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = lambda name: QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    plan = text("filter_time_range_pruned")
    assert "PartitionFilters: [isnotnull(date" in plan and "GreaterThanOrEqual(ts_ns" in plan and "labels" not in plan.split("ReadSchema")[1]
    assert "EqualTo(lbl_env,staging)" in text("store_label") and "EqualTo(lbl_user,17)" in text("store_label")
    assert "Or(EqualTo(service_lc,svc-3),EqualTo(service_label,true))" in text("store_service")


def test_service_selector_on_a_store(spark, logs, tmp_path):
    """A label by the name of service counts like the service itself."""
    rows = [{"id": i, "ts_ns": T0, "level": 2, "service": s, "message": "m", "labels": lb} for i, (s, lb) in enumerate([("A", None), ("b", {"Service": "a"}), ("b", {"x": "a"}), ("a", {"service": "b"}), (None, {"service": "A"}), (None, None)])]
    store = LogStore(spark, str(tmp_path / "s"))
    store.append(logs(rows))
    q = LogQuery(start_ns=T0, end_ns=T0 + 1, labels={"SERVICE": "a"})
    assert run(store.read(), q, T0).total_hits == 4 and run(canonical(logs(rows)), q, T0).total_hits == 4


def test_levels(spark):
    words = [" dbg ", "Trace", "NOTICE", "warning", "err", "panic", "CRIT", "", None, "UNKNOWN"]
    assert [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(parse_level(F.col("w"))).collect()] == [1, 1, 2, 3, 4, 5, 2, 2, 2, 2]
    texts = [None, "null", "3", '"3"', '"error"', "9", "256", "true", "-1", "1.5"]
    assert [r[0] for r in spark.createDataFrame([(w,) for w in texts], "w string").select(level_from_json(F.col("w"))).collect()] == [0, 2, 3, 2, 4, 9, 2, 2, 2, 2]


SYSLOG = [
    # raw, level, service, message, host, facility, ts (None: now)
    ("hello", 2, "system", "hello", None, None, None), ("  ", 2, "system", "", None, None, None), ("<14>hello  world", 2, "system", "hello  world", None, "1", None),
    ("Nov 12 13:14:15 box cron: nightly run", 2, "cron", "nightly run", "box", None, 1731417255 * 10**9), ("<34>Nov 12 13:14:15 host sshd[1]: hi  there", 4, "sshd[1]", "hi there", "host", "4", 1731417255 * 10**9),
    ("2025-03-04T05:06:07Z box cron nightly run", 2, "cron", "nightly run", "box", None, 1741064767 * 10**9), ("<77777>no such priority", 2, "system", "<77777>no such priority", None, None, None),
    ("<abc>text", 2, "system", "text", None, None, None), ("<14>2025-03-04T05:06:07Z", 2, "system", "<14>2025-03-04T05:06:07Z", None, "1", 1741064767 * 10**9),
    ("Nov 12 13:14:15 host", 2, "system", "", "host", None, 1731417255 * 10**9), ("<14>1 2025-03-04T05:06:07Z h app m", 2, "system", "1 2025-03-04T05:06:07Z h app m", None, "1", None),
    ("<7>2025-03-04T05:06:07.123456789+02:00 a b", 1, "system", "a b", None, "0", 1741057567123456789), ("feb 29 1:02:03.5 h x y", 2, "system", "x y", "h", None, 1709168523500000000),
    ("<4>", 3, "system", "", None, "0", None), ("\u0000" * 8000, 2, "system", "\u0000" * 8000, None, None, None), ("héllo 🎉", 2, "system", "héllo 🎉", None, None, None),
]


def test_syslog(spark):
    df = spark.createDataFrame([(i, r[0], "1.2.3.4") for i, r in enumerate(SYSLOG)] + [(99, "", "x"), (98, None, "x")], "k int, raw string, sender string")
    now = T0 + 1
    got = {r.k: r for r in parse_syslog(df, now).collect()}
    assert len(got) == len(SYSLOG)
    for i, (_, level, service, message, host, facility, ts) in enumerate(SYSLOG):
        r = got[i]
        assert (r.level, r.service, r.message, r.labels.get("host"), r.labels.get("facility"), r.ts_ns) == (level, service, message, host, facility, ts or now), SYSLOG[i]
        assert r.labels["source"] == "syslog" and r.labels["sender"] == "1.2.3.4"
    for pri, level in ((0, 4), (3, 4), (4, 3), (6, 2), (7, 1)):
        df = spark.createDataFrame([(f"<{pri}>2025-03-04T05:06:07Z box cron nightly run", "s")], "raw string, sender string")
        assert parse_syslog(df, now).first().level == level


def test_syslog_corrected(spark):
    raw = '<165>1 2025-03-04T05:06:07.5Z h app 12 ID7 [a@1 k="v ]"] the message'
    r = parse_syslog(spark.createDataFrame([(raw, "s")], "raw string, sender string"), T0, "corrected").first()
    assert (r.service, r.message, r.ts_ns) == ("app", "the message", 1741064767_500_000_000)
    assert {k: r.labels[k] for k in ("host", "procid", "msgid", "sd")} == {"host": "h", "procid": "12", "msgid": "ID7", "sd": '[a@1 k="v ]"]'}


def test_bodies():
    e = decode_body('[{"Timestamp": 5, "LEVEL": 3, "message": "m", "labels": {"a": "b"}, "data": {"x": [1, 2]}, "id": 7, "other": 1}, {}]', T0)
    assert e[0] == {"ts_ns": 5, "level": 3, "service": "", "message": "m", "labels": {"a": "b"}, "data": '{"x": [1, 2]}'} and e[1]["level"] == 0 and e[1]["ts_ns"] == T0
    for bad in ("", "  ", "[1]", "[null]", '[{"timestamp": 1.5}]', '[{"timestamp": "1"}]', '{"labels": {"a": 1}}', '{"message": 5}', "{x", '[{"level": "err"}, {"labels": 3}]'):
        with pytest.raises(ValueError):
            decode_body(bad, T0)
    assert [x["message"] for x in decode_body('{"message": "a"}\n\nbroken\n{"message": "b", "level": null}', T0)] == ["a", "b"]
    assert decode_body('{\n "message": "x"\n}', T0) == []  # taken for lines
    assert [x["message"] for x in decode_body('{"message": "a"}\n{"message": "' + "x" * 70_000 + '"}\n{"message": "c"}', T0)] == ["a"]
    assert decode_body("  plain\ntext ", T0)[0]["message"] == "plain\ntext"


ODD_LINES = [
    '{"timestamp": 5, "level": "err", "service": "s", "message": "m\\u00e9 \\"q\\" \\n", "labels": {"a": "b"}}', "", "  ", "{broken", '{"message": "x", "level": 9}', '{"level": null}', "{}", " { } ", "[]", "null", "5", '"x"',
    '{"timestamp": 1.0}', '{"timestamp": "1"}', '{"timestamp": 0123}', '{"timestamp": 99999999999999999999}', '{"timestamp": -7}', '{"level": 256}', '{"level": "3"}', '{"level": 3, "level": "warn"}', '{"level": "warn", "level": 3}',
    '{"level": " Dbg "}', '{"Level": 4, "MESSAGE": "up"}', '{"labels": {"a": 1}}', '{"labels": {"a": "1", "a": "2"}}', '{"labels": {}}', '{"labels": null}', '{"labels": {"level": "9"}, "level": 1}', '{"labels": {"level": "9"}}', '{"message": "a\tb"}',
    '{"message": "say \\"level\\": 5 x"}', '{"message": "\\ud83d\\ude00"}', '{"message": "\\ud83d"}', '{"data": {"x": [1, 2]}}', '{"data": "t"}', '{"other": [1], "message": "k"}', '{"other": true, "message": "k", "n": -1.5e3}', '{"Id": 5}', '{"id": 5}', '{"id": -5}',
    '{"message": "' + "y" * 200_000 + '"}', '{"a": ' + "[" * 5_000 + "]" * 5_000 + "}", '{"message": "x"} y', '{"message": "x",}', '{"message" : "x" , "service":"s"}\r', '{"message": NaN}', '{"x": NaN}', '{"message": "x", "message": "z"}', '{"service": null, "message": 5}', "plain {}",
]


def test_strict_lines_are_as_the_plain_decoder_says(spark):
    """What from_json is trusted with is what the decoder of single entries gives, and the rest goes to that."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ODD_LINES)] + [(999, None)], "k int, value string")
    got = {r.k: r for r in decode_lines(df, "value", "strict", T0).collect()}
    for i, line in enumerate(ODD_LINES):
        try:
            e = decode_entry(line)
        except (ValueError, RecursionError):
            assert i not in got, line[:80]
            continue
        r = got[i]
        level = e["level"] - 256 if e["level"] > 127 else e["level"]
        assert (r.ts_ns, r.level, r.service, r.message, r.labels, r.data) == (e["ts_ns"] or T0, level, e["service"], e["message"], e["labels"], e["data"]), line[:80]
    plain = spark.createDataFrame([(x,) for x in ODD_LINES], "v string").filter(F.col("v").rlike(_PLAIN)).count()
    assert plain >= 15


def test_decoders(spark, tmp_path):
    lines = ['{"timestamp": 5, "level": "err", "service": "s", "message": "m", "labels": {"a": "b"}}', "", "{broken", '{"message": "x", "level": 9}', '{"level": null}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "k int, value string")
    for decoder in ("strict", "fast"):
        got = {r.k: r for r in decode_lines(df, "value", decoder, T0).collect()}
        assert sorted(got) == [0, 3, 4]
        assert (got[0].ts_ns, got[0].level, got[0].labels) == (5, 4, {"a": "b"}) and (got[3].ts_ns, got[3].level, got[3].service) == (T0, 9, "") and got[4].level == 2
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    assert sorted(r.message for r in read_text(spark, str(tmp_path), T0).collect()) == ["one", "two"]
    assert read_text(spark, str(tmp_path), T0, whole=True).first().message == "one\ntwo\n"


ENTRIES = [(1, T0, 2, "auth", "User signed in", {"env": "test"}, None), (2, T0 + 1, 4, "db", "Deadlock ü", {"shard": "03", "": ""}, '{"a": 1}'), (2**63 + 5, -1, 200, "", "", {}, None)]


def slow_crc(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums(monkeypatch):
    rng = random.Random(2)
    data = rng.randbytes(20_000)
    sizes = [0, 1, 2, 3, 7, 8, 63, 64, 65, 1000, 4096, 4097, 5000, 8192, 9001]
    starts = [rng.randrange(20_000 - s) for s in sizes]
    want = [slow_crc(data[a : a + s]) for a, s in zip(starts, sizes)]
    for fold in (4096, 2, 10**6):
        monkeypatch.setattr(frames, "_FOLD_BYTES", fold)
        assert frames.crc32c_many(data, np.array(starts), np.array(sizes)).tolist() == want
    assert [frames.crc32c(data[a : a + s]) for a, s in zip(starts, sizes)] == want


def test_log_of_many_records(monkeypatch):
    entries = [(i, T0 + i, 2, "s", "m" * (i % 50), {}, None) for i in range(300)]
    log = bytearray(frames.encode_log(entries))
    for per_step in (4096, 7, 300):
        monkeypatch.setattr(frames, "_RECORDS", per_step)
        assert list(frames.decode_log(bytes(log))) == entries and list(frames.decode_log(b"")) == []
        bad = log[:]
        bad[len(frames.encode_log(entries[:120])) + 12] ^= 4
        assert list(frames.decode_log(bytes(bad))) == entries[:120]


def test_frames(spark, tmp_path):
    assert frames.crc32c(b"123456789") == 0xE3069283
    for e in ENTRIES:
        assert frames.decode_entry(frames.encode_entry(e)) == e
    for bad in [b"\0" * n for n in range(27)] + [b"\0" * 17 + b"\xff" + b"\0" * 32]:
        with pytest.raises(frames.DecodeError):
            frames.decode_entry(bad)
    log = frames.encode_log(ENTRIES)
    assert list(frames.decode_log(log)) == ENTRIES and list(frames.decode_log(log[:-1])) == ENTRIES[:2]
    size = struct.unpack_from("<I", log, 4)[0] + 8
    flipped = bytearray(log)
    flipped[size + 20] ^= 1
    assert list(frames.decode_log(bytes(flipped))) == ENTRIES[:1]
    with pytest.raises(ValueError):
        frames.encode_entry((1, 1, 1, "x" * 70_000, "", {}, None))
    (tmp_path / "x.wal").write_bytes(log)
    (tmp_path / "y.wal").write_bytes(bytes(flipped))
    got = frames.read_log(spark, str(tmp_path / "*.wal")).orderBy("path", "seq").collect()
    assert [(r.ts_ns, r.level, r.service, r.labels) for r in got] == [(T0, 2, "auth", {"env": "test"}), (T0 + 1, 4, "db", {"shard": "03", "": ""}), (-1, -56, "", {}), (T0, 2, "auth", {"env": "test"})]
    batch = frames.encode_batch([(T0, 4, "b", "failed"), (0, 2, "b", "ok")])
    assert list(frames.decode_batch(batch, 9)) == [(T0, 4, "b", "failed"), (9, 2, "b", "ok")] and len(list(frames.decode_batch(batch[:-1], 9))) == 1
    for bad in (b"", b"\0\0\0\0", struct.pack("<I", 500_001)):
        with pytest.raises(frames.DecodeError):
            list(frames.decode_batch(bad, 9))
    (tmp_path / "b.bin").write_bytes(batch)
    (tmp_path / "c.bin").write_bytes(b"\0")
    assert [r.message for r in frames.read_batches(spark, str(tmp_path / "*.bin"), 9).orderBy("seq").collect()] == ["failed", "ok"]


def test_store(spark, logs, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"), promoted=["Env"])
    rows = [r | {"message": r["message"] * 20} for r in fixture_rows(500)]
    store.append(logs(rows[:300]))
    store.append(logs(rows[300:]))
    q = LogQuery(start_ns=T0, end_ns=T0 + MIN, labels={"env": "Prod"})
    want = model(rows, q.normalise(T0))[0]
    assert run(store.read(), q, T0).total_hits == want
    from logmill.plans.query import matches

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = matches(store.read(), q.normalise(T0), ("env",))._jdf.queryExecution().toString()
    assert "EqualTo(lbl_env,prod)" in plan and "GreaterThanOrEqual(ts_ns" in plan and "PartitionFilters: [isnotnull(date" in plan
    before = store.files()
    for d in [str(r[0]) for r in store.read().select("date").distinct().collect()]:
        store.compact(d)
    assert store.files() <= before and store.read().count() == 500 and run(store.read(), q, T0).total_hits == want
    per_file = file_stats(store)
    assert per_file.agg(F.sum("n")).first()[0] == 500 and 0 < mean_savings(per_file).first()[0] < 100 and store.stored_bytes() > 0 and store.last_id() == 500
    ids = [r.id for r in assign_ids(logs(rows).drop("id"), 10).collect()]
    assert len(set(ids)) == 500 and min(ids) == 11


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"timestamp": T0 + i, "level": "warn", "service": "s", "message": f"m {i}"}) for i in range(50)] + ["{bad"]
    (tmp_path / "in/a.json").write_text("\n".join(lines[:20]))
    (tmp_path / "in/b.json").write_text("\n".join(lines[20:]))
    store, hub = LogStore(spark, str(tmp_path / "store")), Hub()
    inbox = hub.subscribe("t")
    entries = streams.entries_of(streams.watch(spark, str(tmp_path / "in"), 1), "ndjson", T0)
    stream = streams.ingest(entries, store, str(tmp_path / "cp"), lambda: T0, {"availableNow": True}, hub.on_batch)
    stream.awaitTermination(60)
    stored = store.read().select("id", "ts_ns", "level", "message").collect()
    batch = streams.entries_of(spark.read.text(str(tmp_path / "in")), "ndjson", T0).select("ts_ns", "level", "message").collect()
    assert sorted(tuple(r)[1:] for r in stored) == sorted(map(tuple, batch)) and len({r.id for r in stored}) == 50
    assert inbox.qsize() == 50
    again = streams.ingest(entries, store, str(tmp_path / "cp"), lambda: T0, {"availableNow": True})  # nothing new after a restart
    again.awaitTermination(60)
    assert store.read().count() == 50


def test_hub_is_lossy():
    hub, strict = Hub("corrected"), Hub()
    a, b = hub.subscribe("a", "BOOM"), strict.subscribe("b", "BOOM")
    for i in range(1500):
        for h in (hub, strict):
            h.publish({"message": "boom" if i == 3 else "x", "ts_ns": 1, "level_name": "INFO"})
    assert a.qsize() == 1 and b.qsize() == 1024 and strict.dropped["b"] == 1500 - 1024
    strict.unsubscribe("b")
    assert len(strict) == 0


def test_service_and_cli(spark, tmp_path):
    service = Service(LogStore(spark, str(tmp_path / "s")), now_ns=lambda: T0 + MIN)
    assert json.loads(service.handle("GET", "/api/v1/query")[1]) ["entries"] is None
    server = serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    http_ = http.client.HTTPConnection(*server.server_address, timeout=60)

    def ask(method, path, body=None):
        http_.request(method, path, body)
        r = http_.getresponse()
        return r.status, r.read().decode()

    assert ask("GET", "/health")[0] == 200 and ask("GET", "/api/v1/ingest")[0] == 405 and ask("POST", "/api/v1/ingest", "")[0] == 400 and ask("POST", "/api/v1/ingest", "[{]")[0] == 400
    body = json.dumps([{"timestamp": T0, "level": "ERROR", "service": "auth-api", "message": "Invalid token"}, {"timestamp": T0, "level": "INFO", "service": "pay", "message": "Invoice paid"}])
    assert ask("POST", "/api/v1/ingest", body) == (200, '{"status": "ok", "ingested": 2}')
    assert ask("POST", "/api/v1/ingest/binary", frames.encode_batch([(T0, 4, "bill", "Card failed"), (0, 2, "bill", "Refund")]))[0] == 200
    assert ask("POST", "/api/v1/ingest/binary", b"\0")[0] == 400
    got = json.loads(ask("GET", "/api/v1/query?service=AUTH-api&level=ERROR")[1])
    assert got["total_hits"] == 1 and got["entries"][0]["service"] == "auth-api" and len(got["histogram"]) == 30
    assert json.loads(ask("POST", "/api/v1/query", '{"level": "INFO", "search": "invoice"}')[1])["total_hits"] == 1
    assert json.loads(ask("GET", "/api/v1/query?histogram_buckets=10")[1])["total_hits"] == 0
    stats = json.loads(ask("GET", "/api/v1/stats")[1])
    assert stats["total_ingested"] == 4 and stats["active_chunks"] == 1
    server.shutdown()
    out = io.StringIO()
    cli.run_query(service.store, Namespace(search="", level="error", service="", limit=50), out, T0 + MIN)
    assert out.getvalue().startswith("2 entries match") and "2024-01-01 00:00:00.000" in out.getvalue()
    cli.run_ingest(service.store, Namespace(service="cli-client"), io.StringIO("a\n\n b \n"), out)
    assert out.getvalue().endswith("2 lines stored\n") and service.store.read().count() == 6
    out = io.StringIO()
    cli.run_stats(service.store, None, out)
    assert json.loads(out.getvalue())["total_ingested"] == 6
    assert ws_frame("x" * 200)[:4] == b"\x81\x7e\x00\xc8" and ws_frame("a") == b"\x81\x01a"


def test_server(spark, tmp_path):
    """Frames by UDP and TCP and requests by HTTP end up in one store, in order of arrival; a second server goes on where the first ended."""
    import socket
    import time

    from logmill.server import Server, address

    assert address(":9428") == ("0.0.0.0", 9428) and address("localhost:1") == ("localhost", 1)
    for run in (1, 2):
        server = Server(spark, str(tmp_path / "data"), "127.0.0.1:0", "127.0.0.1:0", now_ns=lambda: T0 + run * MIN, seconds=0.2)  # noqa: B023
        (host, port), (_, syslog) = server.addresses
        http_ = http.client.HTTPConnection(host, port, timeout=60)

        def ask(method, path, body=None):
            http_.request(method, path, body)  # noqa: B023
            r = http_.getresponse()  # noqa: B023
            return r.status, r.getheader("Content-Type"), r.read().decode()

        assert ask("GET", "/")[:2] == (200, "text/plain; charset=utf-8") and ask("GET", "/favicon.ico")[:2] == (200, "image/svg+xml") and ask("GET", "/nothing")[0] == 404
        u = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        u.sendto(f"<11>2024-01-01T00:00:00Z h app udp {run}".encode(), (host, syslog))
        with socket.create_connection((host, syslog)) as t:
            t.sendall(b"<14>by tcp\n")
        assert ask("POST", "/api/v1/ingest", '{"message": "by http", "service": "web"}')[0] == 200
        for _ in range(150):
            if json.loads(ask("GET", "/api/v1/query?service=app")[2])["total_hits"] == run and json.loads(ask("GET", "/api/v1/stats")[2])["total_ingested"] == 3 * run:
                break
            time.sleep(0.2)
        else:
            raise AssertionError("frames weren't stored")
        with socket.create_connection((host, syslog)) as t:
            t.sendall(b"<14>late frame\n") if run == 2 else None
            time.sleep(0.3)
        server.stop()
    rows = server.store.read().collect()
    assert sorted(r.message for r in rows) == ["by http"] * 2 + ["by tcp"] * 2 + ["late frame", "udp 1", "udp 2"]
    ids = {r.id for r in rows}
    assert len(ids) == 7 and max(r.id for r in rows if r.message == "udp 1") < min(r.id for r in rows if r.message == "udp 2")
    assert {r.ts_ns for r in rows if r.message == "by tcp"} == {T0 + MIN, T0 + 2 * MIN}


def test_ids_in_a_row(spark):
    from logmill.store import Ids, numbered

    ids = Ids(lambda: T0)
    df = spark.range(0, 50, 1, 7).select((F.col("id") * 2).alias("v")).filter("v % 3 = 0")
    got, first, n = numbered(df, ids.take)
    rows = sorted(got.collect(), key=lambda r: r.id)
    assert [r.id for r in rows] == list(range(first, first + n)) and [r.v for r in rows] == sorted(r.v for r in rows) and n == 17
    assert ids.take(1) == first + n and numbered(df.limit(0), ids.take)[2] == 0


def test_websocket_tail(spark, tmp_path):
    import socket
    import time

    service = Service(LogStore(spark, str(tmp_path / "s")), now_ns=lambda: T0)
    server = serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with socket.create_connection(server.server_address, timeout=20) as c:
        c.sendall(b"GET /api/v1/tail HTTP/1.1\r\nHost: x\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: dGhlIHNhbXBsZSBub25jZQ==\r\n\r\n")
        f = c.makefile("rb")
        head = [x for x in iter(f.readline, b"\r\n")]
        assert b"101" in head[0] and any(b"s3pPLMBiTxaQ9kYGzzhZRbK+xOo=" in x for x in head)  # the protocol's own example
        for _ in range(100):
            if len(service.hub):
                break
            time.sleep(0.05)
        service.hub.publish({"id": 7, "ts_ns": T0, "level_name": "WARN", "service": "s", "message": "m", "labels": {"a": "b"}, "data": None})
        _, n = f.read(2)
        assert json.loads(f.read(n)) == {"id": 7, "timestamp": T0, "level": "WARN", "service": "s", "message": "m", "labels": {"a": "b"}}
    server.shutdown()


def test_syslog_listener(spark, tmp_path):
    import socket
    import time

    folder = str(tmp_path / "spool")
    listener = SyslogListener(folder, port=0, seconds=0.2)
    u = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    u.sendto(b"<11>2024-01-01T00:00:00Z h app udp frame", ("127.0.0.1", listener.port))
    with socket.create_connection(("127.0.0.1", listener.port)) as t:
        t.sendall(b"<14>one\r\n\n<14>two\n")
    time.sleep(1)
    listener.stop()
    stream = parse_syslog(spooled(spark, folder), T0).writeStream.format("memory").queryName("frames").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    got = spark.table("frames").collect()
    assert sorted((r.service, r.level, r.message) for r in got) == [("app", 4, "udp frame"), ("system", 2, "one"), ("system", 2, "two")]
    assert {r.labels["sender"] for r in got} == {"127.0.0.1"}
