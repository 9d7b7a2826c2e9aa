import random

import pytest

from logmill.operators import logparse
from logmill.operators.earley import Grammar, Parser
from logmill.operators.logparse import LineParser, assemble, entries_of_lines, parse_lines, parse_time
from logmill.queries.tables import table
from tests.conftest import SF, T0

US = T0 // 1000
LINES = [
    ("I0101 07:26:07.238846   27052 mailqd:71] could not open", (US + 26_767_238_846, "INFO", "mailqd", "could not open")),
    ("F0229 00:00:00.5 1 a.B:9] x", (1_709_164_800_500_000, "FATAL", "a.B", "x")),
    ('<126>1 2024-01-01T02:16:07.744605Z n53 mailqd 4824 M4 - plan: chosen', (US + 8_167_744_605, "INFO", "mailqd", "plan: chosen")),
    ('<35>1 2024-01-01T12:53:45Z h up 2 M2 [m@32473 k="5 3" s="]"] x ] y', (US + 46_425_000_000, "ERROR", "up", "x ] y")),
    ("<71>Jan  1 04:01:49 n09 api.Query[12]: a: b", (US + 14_509_000_000, "DEBUG", "api.Query", "a: b")),
    ("<37>Jan 01 04:01:49 n09 a-b: m", (US + 14_509_000_000, "INFO", "a-b", "m")),
    ('time=2024-01-01T02:00:00.5+02:00 level=DBG component=c.q msg="say \\"hi\\"" pid=1', (US + 500_000, "DEBUG", "c.q", 'say "hi"')),
    ('time=2024-01-01T00:00:00Z msg="x" component=c level=Info pid=1\r', (US, "INFO", "c", "x")),
    ('{"n": 4, "severity": "NOTICE", "@timestamp": 1704067200.25, "component": "a.b", "text": "q \\"r\\" \\u00fc"}', (US + 250_000, "INFO", "a.b", 'q "r" ü')),
    ('{"time":1704067200250,"lvl":"err","logger":"net/r","message":"","x":{"level":"debug","a":[1]}}', (US + 250_000, "ERROR", "net/r", "")),
    ("[01/Jan/2024:05:30:00 +0530] [net/relay] [critical] boom", (US, "FATAL", "net/relay", "boom")),
    ("\x1b[2m2024-01-01T00:00:00.000001Z\x1b[0m \x1b[33m WARN\x1b[0m a_b: m  n", (US + 1, "WARN", "a_b", "m  n")),
    ("2024-01-01 00:00:00.141 UTC [4836] net/relay EMERGENCY:  token refused", (US + 141_000, "FATAL", "net/relay", "token refused")),
    ("2024-01-01 00:00:00,307 - tile-press - CRIT - m - n", (US + 307_000, "INFO", "tile-press", "m - n")),
    ("2024-01-01 00:00:00,099 ERR   [pool-2-7] k.s.P - m", (US + 99_000, "ERROR", "k.s.P", "m")),
    ('time=2024-01-01T00:00:00Z level=info trace_id=7 msg="two"', (US, "INFO", None, "two")),
    ('request_id=ab-1 user.id=9 k1= err= ts=1704067200 lvl=warn svc=a.b http/code=200 msg=', (US, "WARN", "a.b", "")),
    ('{"ts":1704067200,"level":null,"msg":"x","component":7,"a":{"b":[[],{},[{"c":null}]],"ts":"no"}}', (US, "UNKNOWN", None, "x")),
    ("2024-01-01T00:00:00Z [main] INFO com.foo.Bar - hello", (US, "INFO", "com.foo.Bar", "hello")),
    ("[2024-01-01 00:00:00] ERROR foo: bar", (US, "ERROR", "foo", "bar")),
    ("2024-01-01 00:00:00 [WARN] foo.bar: a: b", (US, "WARN", "foo.bar", "a: b")),
    ("2024-01-01T00:00:00.5Z  INFO 4711 --- [  main] c.e.App   : up", (US + 500_000, "INFO", "c.e.App", "up")),
    ("2024-01-01 00:00:00 a b c INFO msg", (US, "INFO", None, "msg")),
    ("2024-01-01 00:00:00 a b c d INFO msg ERROR", (US, "INFO", None, "msg ERROR")),
    ("2024-01-01 00:00:00 (a=1, 'b') x y z <7> [warn] msg", (US, "WARN", None, "msg")),
]
OTHER = ["", "   ", None, "}", '  "at": "2022-03-04T05:06:07Z",', '  "level": "warn",', "Traceback (most recent call last):", "\tat c.q.Unit23.run(Unit.java:359)", "unit starting",
         "    00000000  92c0f4644ad45805 8cb7b60c9961937a", "c.q.err.EmptyFault: row 14315", "\twhere seen > '2021-05-06 07:08:09' and k = 4", '{"at": "x"}', "2024-13-45 99:99:99,000 - a - INFO - b", "2024-01-01 00:00:00 it went on to warn us of an error twice",
         "STATEMENT:  select n", "\x00\x01", '{"ts": "soon", "msg": "x"}', '{"ts": 1, "a": [1, 2', "<14>", "<77777>no such priority"]


def test_layouts():
    p = LineParser()
    for _ in range(2):  # once with fresh charts, once with those kept
        for line, want in LINES:
            got = p(line, T0)
            assert got is not None and got[:4] == want, (line, got)
        for line in OTHER:
            assert p(line, T0) is None, line


def test_unparsed_words_are_told():
    got = LineParser()("2024-01-01 00:00:00 what ever ERROR: boom", T0)
    assert got[1] == "ERROR" and got[3] == "boom" and got[4] == ["20-29"]


def test_headers_have_no_bound():
    """One of a thousand members, and one with more words than any table of charts before its level."""
    p = LineParser()
    for n in (3, 300, 30_000):
        line = "2024-01-01 00:00:00 " + "word-1, " * n + "ERROR: boom"
        assert p(line, T0)[:4] == (US, "ERROR", None, "boom")
        assert p("<14>Jan  1 00:00:00 " + "h." * n + "x c" + "/d" * n + f"[{n}]: m", T0)[:4] == (US, "INFO", "c" + "/d" * n, "m")
    assert p.parser.nodes < 6_000


def test_brackets_are_matched_by_charts_too(monkeypatch):
    monkeypatch.setattr(logparse, "LONG", 10**9)
    p = LineParser()
    line = '{"ts":1704067200,"a":' + "[" * 300 + '{"x":[1,{"level":"warn"}]}' + "]" * 300 + ',"level":"err"}'
    assert p(line, T0)[:2] == (US, "ERROR") and p(line.replace("]]", "]", 1), T0) is None


def test_year_of_arrival():
    assert parse_time("0229 00:00:00.0", T0) == 1_709_164_800_000_000
    assert parse_time("0229 00:00:00.0", T0 - 10**9) is None and parse_time("Jan  1 00:00:00", None) is None


@pytest.mark.parametrize("line", ["a b " * 200_000, '{"ts":1,"a":[' + "1," * 200_000 + '2],"msg":"x"}', '{"ts":1,"a":' + "[" * 50_000, '"' * 100_001, "2024-01-01 00:00:00 " + "b " * 100_000,
                                  "time=2024-01-01T00:00:00Z " + "k=v " * 100_000])
def test_long_lines_end_soon(line):
    LineParser()(line, T0)


def test_long_structured_lines_are_whole():
    p = LineParser()
    blob = "aB3/+x9." * 5_000
    pair, json_line = LINES[6], LINES[8]
    assert p(pair[0] + " blob=" + blob, T0)[:4] == pair[1] and p(f"blob={blob} " + pair[0], T0)[:4] == pair[1]
    assert p(pair[0] + "".join(f" k={i}" for i in range(50_000)), T0)[:4] == pair[1]
    assert p(pair[0] + ' q="' + "x y " * 9_000 + '"' + " blob=" + blob, T0)[:4] == pair[1]
    members = "".join(f', "k{i}": {v}' for i, v in enumerate(["1", '"x"', "null", "[1, 2]", '{"a": [{}, {"b": []}]}'] * 4_000))
    assert p(json_line[0][:-1] + members + "}", T0)[:4] == json_line[1]
    deep = json_line[0][:-1] + ', "d": ' + "[" * 50_000 + "]" * 50_000 + "}"
    assert p(deep, T0)[:4] == json_line[1] and p(deep.replace("]]", "]"), T0) is None
    for bad in (pair[0] + " blob=" + blob + "=x", f"a={blob} b=1", pair[0] + f" blob={blob} ", pair[0] + f" blob={blob} x", pair[0] + f" blob={blob} =k", json_line[0][:-1] + members, "{" + members[2:] + "}", json_line[0][:-1] + members + "} x"):
        assert p(bad, T0) is None


def test_long_lines_are_as_short_ones(monkeypatch):
    """Structured lines give the same without charts as with them, and charts the same whether kept or not."""
    p, q, rng = LineParser(), LineParser(), random.Random(3)
    q.parser.shared = 3
    lines = [x for x, _ in LINES if x.startswith(("time=", "request", "{"))]
    for _ in range(1500):
        line = rng.choice(lines)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(line))
            line = line[:k] + rng.choice(['"', "=", " ", "x", ",", "}", "7", "", "{", "[", "]", '[{"a":1}]', ":", "level", "_"]) + line[k + 1 :]
        if logparse._PAIR.match(line) or line.startswith("{"):
            want = p(line, T0)
            assert q(line, T0) == want
            monkeypatch.setattr(logparse, "LONG", 0)
            assert p(line, T0) == want, line
            monkeypatch.undo()


def test_weights_choose_the_parse():
    g = Grammar("Line 0 = REST\nLine 1 = A REST\nLine 2 = B B END\nA = x | x x\nB = x")
    p = Parser(g, frozenset("AB"))
    assert p.parse(iter("xx"))[0] == 2 and [s[0] for s in p.parse(iter("xx"))[1]] == ["B", "B"]
    assert p.parse(iter("xxx"))[0] == 1 and p.parse(iter("y")) == (0.0, [], 0)


def brute(rows):
    p, seen, out, last = LineParser(), set(), {}, {}
    for i, t, s, m in sorted(rows, key=lambda r: r[0]):
        if i in seen:
            continue
        seen.add(i)
        got = p(m, t)
        if got:
            out[i] = [1, *got[:4]]
            last[s] = i
        elif s in last:
            out[last[s]][0] += 1
    return {(i, *v) for i, v in out.items()}


def test_whole_table_matches_brute_force_in_any_blocks(spark):
    raw = table(spark, SF, "raw_entries")
    rows = [(r.id, r.ts_ns, (r.labels or {}).get("sender"), r.message) for r in raw.collect()]
    want = brute(rows)
    assert {tuple(r) for r in entries_of_lines(raw).collect()} == want
    for block in (1, 7, 64):
        got = assemble(parse_lines(raw), block).select("first_id", "n_lines", "ts_us", "level", "component", "message").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_odd_rows(logs):
    head = LINES[4][0]
    rows = [
        {"id": 1, "ts_ns": T0, "message": "before", "labels": {"sender": "a"}}, {"id": 2, "ts_ns": T0, "message": head, "labels": {"sender": "a"}},
        {"id": 3, "ts_ns": None, "message": None, "labels": {"sender": "a"}}, {"id": 4, "ts_ns": T0, "message": "x", "labels": None}, {"id": 5, "ts_ns": None, "message": head, "labels": None},
        {"id": 6, "ts_ns": T0, "message": "", "labels": {}}, {"id": 2, "ts_ns": T0, "message": head, "labels": {"sender": "a"}}, {"id": None, "ts_ns": T0, "message": "y", "labels": {"sender": "a"}},
    ]
    random.Random(1).shuffle(rows)
    got = {(r.first_id, r.n_lines, r.ts_us) for r in entries_of_lines(logs(rows, "b p pos size head sender till last n g owner")).collect()}
    assert got == {(2, 2, US + 14_509_000_000), (5, 2, None)}
    assert entries_of_lines(logs([])).collect() == []
