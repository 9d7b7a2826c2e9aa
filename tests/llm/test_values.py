import random
from collections import Counter

import numpy as np
import pytest

from logmill.llm.lossy import LossyCounter, frequent_values, lossy_counts
from logmill.llm.termcounts import entry_term_counts, term_counts


@pytest.mark.parametrize("epsilon", [0.2, 0.01, 0.003])
def test_lossy_counter_bounds(epsilon):
    rng = np.random.default_rng(1)
    values = np.where(rng.random(20_000) < 0.3, rng.integers(0, 5, 20_000), rng.integers(10, 10**6, 20_000))
    c = LossyCounter(epsilon)
    for part in np.array_split(values, 17):
        c.add(part)
    keys, counts, under = c.summary()
    true = Counter(values.tolist())
    assert c.n == 20_000 and c.bucket <= 2 * epsilon * c.n
    for k, n, d in zip(keys.tolist(), counts.tolist(), under.tolist()):
        assert n <= true[k] <= n + d
    kept = set(keys.tolist())
    assert all(n <= c.bucket for k, n in true.items() if k not in kept)
    assert len(keys) <= c.width + (1 / epsilon) * np.log(max(2, epsilon * c.n)) + c.width


def rows_of(n=3000):
    rng = random.Random(5)
    rows = [{"id": i, "message": rng.choice(["hot", "hot", "Hot", "warm", None, "", f"u{rng.randrange(10**6)}", "x" * 5000])} for i in range(n)]
    return rows + rows[:200]


def test_frequent_values_match_exact_counts(logs):
    rows = rows_of()
    once = {r["id"]: r["message"] for r in rows}
    true = Counter(m for m in once.values() if m)
    got = {r["value"]: r for r in frequent_values(logs(rows, "i h n d low high total value"), "message", 0.05, 0.004).collect()}
    assert {v: r["n"] for v, r in got.items()} == {v: n for v, n in true.items() if n >= 0.05 * len(once)}
    assert all(r["low"] <= r["n"] <= r["high"] and r["total"] == len(once) for r in got.values())
    wide = lossy_counts(logs(rows), "message", 0.004).collect()
    assert all(r["high"] - r["low"] <= 0.004 * r["total"] + 1 for r in wide)


def test_frequent_values_edges(logs):
    assert frequent_values(logs([]), "message", 0.1).collect() == []
    assert frequent_values(logs([{"id": 1, "message": None}, {"id": 2, "message": ""}]), "message", 0.1).collect() == []
    assert [r["n"] for r in frequent_values(logs([{"id": None, "message": "a"}, {"id": 3, "message": "a"}]), "message", 0.5).collect()] == [2]
    with pytest.raises(ValueError):
        frequent_values(logs([]), "message", 0.1, 0.2)


def test_term_counts(spark):
    rng = random.Random(2)
    recs = [[rng.choice(["a", "b", None, f"t{rng.randrange(500)}", ""]) for _ in range(rng.randrange(6))] for _ in range(1000)] + [None, []]
    df = spark.createDataFrame([(r, "x", 1) for r in recs], "terms array<string>, term string, n int").repartition(5)
    n, held = Counter(), Counter()
    for r in recs:
        n.update(t for t in r or [] if t is not None)
        held.update({t for t in r or [] if t is not None})
    got = term_counts(df).collect()
    assert {r["term"]: (r["n"], r["n_records"]) for r in got} == {t: (n[t], held[t]) for t in n} and len(got) == len(n)
    assert sorted(r["code"] for r in got) == list(range(len(n)))
    assert term_counts(df.limit(0)).collect() == []


def test_entry_terms_and_marks(logs):
    rows = [{"id": i, "level": [None, 0, 2, 2][i % 4], "service": " API" if i % 2 else None, "labels": {"Env": "P", "env": "p", "z": None, "e": ""} if i < 30 else None} for i in range(50)]
    rows.append({"id": 60, "service": "once"})
    rows += rows[:10]
    got = {(r["field"], r["term"]): (r["n"], r["n_entries"], r["mark"]) for r in entry_term_counts(logs(rows, "i s v l terms term code n field mark")).collect()}
    assert got == {
        ("service", "api"): (25, 25, None), ("service", "once"): (1, 1, "rare"), ("level", "UNKNOWN"): (13, 13, None), ("level", "INFO"): (24, 24, None),
        ("label", "env=p"): (60, 30, "common"), ("label", "e="): (30, 30, "common"),
    }
    assert entry_term_counts(logs([])).collect() == []
