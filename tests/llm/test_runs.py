import random

import pytest
from pyspark.sql import functions as F

from logmill.llm.runs import collapse_runs, statement
from tests.conftest import T0

SAME = [
    ["user u752555 signed in from 10.142.72.60", "User u1 signed in from  fe80::1", "user u2 signed in from 10.0.0.1:80.", "USER x9 signed in from 1.2.3.4 !"],
    ["snapshot fd5aef8f discarded, 28704788 bytes", "snapshot bdbacdad discarded, 1 bytes"],
    ["rate limit for client c-126746a2: 489/min", "rate limit for client c-affbfdda: 1/min"],
    ["open /var/x/y.log failed", "open /etc/unit failed", "open C:\\tmp\\a failed", "open ./rel/path failed"],
    ['flag "a b" on', "flag 'c' on", "flag `x y z` on"],
    ["mail to a.b@c.example bounced", "mail to z@y bounced"],
    ["get https://a.example/x?y=z done", "get ftp://b done"],
    ["heartbeat", "Heartbeat", " heart" + "beat ", "heartbeat...", "HEARTBEAT!"],
    ["心跳正常", "心跳正常。"],
    ["stage a: ready\nstage b: ready", "stage a: ready stage b: ready"],
    ['{"user":"bob","say" : "a \\"b\\" c","n":5}', '{"user": "Ann C", "say":"x","n":17} '],
]
DIFFERENT = ["tick", "tock", "tick tock", "health check ok", "health check slow", "keepalive sent to all peers", "keepalive received from all peers", "mode strict", "mode lenient", "can't open it", "can't close it",
             "status=gone", "status=late", '{"event":"probe","ok":true}', '{"event":"probe","ok":false}', '{"name":"probe","ok":true}', "retrying_in_background", "read/write", "read/append"]


def test_statement(spark):
    def of(texts):
        return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "m string").select(statement(F.col("m"))).collect()]

    for group in SAME:
        assert len(set(of(group))) == 1, list(zip(group, of(group)))
    got = of(DIFFERENT)
    assert len(set(got)) == len(got), got
    assert of([None, "", "...", "x" * 1_000_000 + " 5"]) == [None, "", "", "x" * 1_000_000 + " 0"]


def brute(rows, least=3, gap=300_000_000_000):
    seen, by = set(), {}
    for r in rows:
        if r["id"] in seen or not r["ts_ns"] or r["service"] is None or not r["message"]:
            continue
        seen.add(r["id"])
        by.setdefault(r["service"].strip(" ").lower(), []).append((r["ts_ns"], r["id"], r["message"].split()[0]))
    out = set()
    for s, es in by.items():
        es.sort()
        start = 0
        for k in range(1, len(es) + 1):
            if k == len(es) or es[k][2] != es[k - 1][2] or es[k][0] - es[k - 1][0] > gap:
                if k - start >= least:
                    out.add((s, es[start][1], k - start, es[k - 1][0] - es[start][0]))
                start = k
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force_in_any_blocks(logs, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        rows.append({"id": i, "ts_ns": rng.choice([None, 0] + [T0 + rng.randrange(400) * 40_000_000_000] * 20), "service": rng.choice(["hot", "Hot ", "hot", None, "b"]), "message": rng.choice(["a 1", "a 2", "a 3", "b 1", "", None])})
    rows += rows[100:130]
    want = brute(rows)
    assert want
    for width in (30_000_000_000, 1_000_000_000_000, 10**15, None):
        got = [tuple(r) for r in collapse_runs(logs(rows, "i t s m b pos e n g k first last new"), width_ns=width).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_edges(logs):
    assert collapse_runs(logs([])).collect() == []
    row = lambda i, t: {"id": i, "ts_ns": T0 + t * 10**9, "service": "s", "message": "m"}
    assert collapse_runs(logs([row(1, 0), row(2, 0)])).collect() == []
    assert [tuple(r) for r in collapse_runs(logs([row(3, 0), row(2, 0), row(1, 0)])).collect()] == [("s", 1, 3, 0)]  # ties by id
    assert [tuple(r) for r in collapse_runs(logs([row(1, 0), row(2, 300), row(3, 600), row(4, 901)])).collect()] == [("s", 1, 3, 600 * 10**9)]
    one = [row(k, k) for k in range(50)]
    assert [tuple(r) for r in collapse_runs(logs(one), width_ns=10**9).collect()] == [("s", 0, 50, 49 * 10**9)]  # a run over many blocks
