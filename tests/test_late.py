import random

from logmill.functions.entries import HOUR_NS
from logmill.operators.late import arrivals, clocks, combine, fates, late_cases, partials
from logmill.operators.prefix import carry_in
from logmill.streaming.late import PeriodTable
from tests.conftest import T0


def brute(rows):
    clock, out = None, {}
    for i, t in sorted({(r["id"], r["ts_ns"]) for r in rows if r["id"] is not None and r["ts_ns"] and T0 - 10**18 < r["ts_ns"] < 2_208_988_800_000_000_000 and r["ts_ns"] >= 1_577_836_800_000_000_000}):
        late = clock is not None and clock >= t // HOUR_NS * HOUR_NS + HOUR_NS
        out[i] = "on_time" if not late else "dropped" if clock - t > 6 * HOUR_NS else "corrects"
        clock = t if clock is None else max(clock, t)
    return out


def sample(n=800):
    rng = random.Random(3)
    rows, at = [], T0
    for i in range(n):
        at += rng.randrange(HOUR_NS // 20)
        t = rng.choice([at] * 8 + [at - rng.randrange(12 * HOUR_NS), None, 0, -5, 2**62, at // HOUR_NS * HOUR_NS])
        rows.append({"id": i * 3 + rng.randrange(3), "ts_ns": t})
    return rows + rows[10:40] + [{"id": None, "ts_ns": at}]


def test_fates_match_brute_force_in_any_blocks(logs):
    rows = sample()
    want = brute(rows)
    for batch in (7, 100, 1 << 16):
        got = fates(logs(rows, "i t b p carry near fate clock"), batch=batch).collect()
        assert len(got) == len(want) and {r.id: r.fate for r in got} == want
    assert {(r.id, r.fate) for r in late_cases(logs(rows)).collect()} == {(i, f) for i, f in want.items() if f != "on_time"}


def test_partials_merge_to_the_whole(logs):
    judged = fates(logs(sample()), batch=50)
    merged = {r.period: r for r in combine(partials(judged)).collect()}
    for r in judged.collect():
        merged[r.period]
    assert sum(r.n + r.n_dropped for r in merged.values()) == judged.count()


def test_empty(logs):
    assert fates(logs([])).collect() == [] and arrivals(logs([])).collect() == [] and late_cases(logs([{"id": 1, "ts_ns": None}])).collect() == []


def test_clocks(logs):
    parts = arrivals(logs([{"id": i, "ts_ns": T0 + t} for i, t in ((1, 5), (2, 9), (11, 3), (12, 4), (35, 20))]), batch=10)
    assert {r.batch: (r.clock_before, r.clock_after) for r in clocks(parts).collect()} == {0: (None, T0 + 9), 1: (T0 + 9, T0 + 9), 3: (T0 + 9, T0 + 20)}
    assert {r.batch: r.clock_before for r in clocks(parts, T0 + 10).collect()} == {0: T0 + 10, 1: T0 + 10, 3: T0 + 10}


def test_incremental_merge_equals_one_pass(spark, logs, tmp_path):
    """Records come again in their own batch and in later ones, batches run again, and parts are merged in between."""
    rows = [r for r in sample(300) if r["id"] is not None]
    rows = list({(r["id"]): r for r in rows}.values())
    rows.sort(key=lambda r: r["id"])
    table = PeriodTable(spark, str(tmp_path / "periods"))
    rng = random.Random(9)
    key = lambda r: (r.period, r.n_on_time, r.n_corrects, r.n_dropped, r.n)

    def same(upto):
        assert sorted(map(key, table.read().collect())) == sorted(map(key, combine(partials(fates(logs(rows[:upto])))).collect()))
        assert sorted(r.id for r in table.refused().collect()) == sorted(i for i, f in brute(rows[:upto]).items() if f == "dropped")

    for n, first in enumerate(range(0, 300, 60)):
        again = rng.sample(rows[: first + 60], 25)  # of earlier batches, and of this one
        for _ in range(1 + (n == 2)):  # a batch that runs again takes its own place
            refused = table.merge(logs(rows[first : first + 60] + again + rows[first : first + 5]), n)
        assert {r.id for r in refused.collect()} <= {r["id"] for r in rows[first : first + 60]}
        same(first + 60)
        if n in (1, 3):
            table.compact(n)
            same(first + 60)
    assert table.merge(logs([]), 5).collect() == [] and table.merge(logs(rows[:50]), 6).collect() == []
    same(300)
    assert len(table._numbers("ids", "arrived")) == 4 and table._numbers("ids_merged", "upto") == [2]


def test_carry_in(spark):
    df = spark.createDataFrame([("a", b, b if b % 3 else None) for b in range(30)] + [("b", 5, 1)], "k string, b bigint, v bigint")
    for how, f in (("max", max), ("sum", sum)):
        got = {(r.k, r.b): r.carry for r in carry_in(df, ["k"], "b", "v", how, fan=4).collect()}
        for b in range(30):
            before = [x for x in range(b) if x % 3]
            assert got["a", b] == (f(before) if before else None)
        assert got["b", 5] is None
