import random

import numpy as np
import pytest

from logmill.llm import leakage, mixing
from logmill.llm.leakage import Items, held, in_passages, leak_report, leaked_items, tiled, tiles
from logmill.llm.mixing import Mix, token_counts
from logmill.llm.repetition import beta_prior, repeated_words, repetition, sentence_shares, sentences
from logmill.llm.words import words
from logmill.queries.tables import table
from tests.conftest import SF

DOCS = "doc_id bigint, applicant string, text string, source string"
RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(4000)]
ITEM = " ".join(RNG.sample(WORDS, 80))
OTHER = " ".join(RNG.sample(WORDS, 400))


def docs_of(spark, rows, extra=""):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, r.get("applicant"), r.get("text"), r.get("source")) for i, r in enumerate(rows)], DOCS)
    return df.select("*", *[F.lit("x").alias(c) for c in extra.split()])


def test_words():
    assert words("Größe 12, a_b [0012] 心跳!") == ["größe", "a", "b", "心", "跳"] and words(None) == words("12 _") == []


def leak_cases():
    w = ITEM.split()
    o = OTHER.split()
    altered = [x if k % 10 else "zz" for k, x in enumerate(w)]
    shuffled = w[:]
    RNG.shuffle(shuffled)
    return {
        "whole": ITEM, "case and marks": "; ".join(x.upper() for x in w), "numbered": " ".join(w[:30]) + "\n\n[0007] " + " ".join(w[30:]), "altered": " ".join(altered), "inside": OTHER + " " + ITEM + " " + OTHER,
        "sixty percent": " ".join(o[:50] + w[:48] + o[50:]), "two passages": " ".join(o[:50] + w[:25] + o[50:90] + w[40:68] + o[90:]),
        "halves swapped": " ".join(w[40:] + w[:40]), "passages swapped": " ".join(o[:50] + w[44:] + o[50:90] + w[:34] + o[90:]),
    }, {
        "shuffled": " ".join(shuffled), "bits swapped": " ".join(x for k in range(70, -1, -10) for x in w[k : k + 10]), "a clause": " ".join(o + w[:20]), "scattered": " ".join(x for p in zip(w, o) for x in p), "other": OTHER, "none": None, "empty": "", "half": " ".join(o + w[:40]),
    }


def test_leaks(spark):
    yes, no = leak_cases()
    names = [*yes, *no]
    docs = docs_of(spark, [{"text": x} for x in [*yes.values(), *no.values()]], "doc item held tiled item_id")
    items = spark.createDataFrame([(1, ITEM), (2, " ".join(RNG.sample(WORDS, 60))), (3, None), (4, ""), (5, "12 34"), (1, ITEM)], "item_id bigint, text string")
    got = leaked_items(docs, items).collect()
    assert sorted((names[r.doc_id], r.item_id) for r in got) == sorted((n, 1) for n in yes)
    report = leak_report(docs, items).collect()
    assert [(r.item_id, r.n_docs, r.n_reordered) for r in report] == [(1, len(yes), 2)]
    assert leaked_items(docs.limit(0), items).collect() == [] and leaked_items(docs, items.limit(0)).count() == 0


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    yes, no = leak_cases()
    docs = docs_of(spark, [{"text": x} for x in yes.values()])
    items = spark.createDataFrame([(k, ITEM if k == 3 else " ".join(RNG.sample(WORDS, 50))) for k in range(9)], "item_id bigint, text string")
    want = sorted(map(tuple, leaked_items(docs, items).collect()))
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 100)
    assert sorted(map(tuple, leaked_items(docs, items).collect())) == want and len(want) == len(yes)


def all_matches(doc, item, least=3):
    """The longest matches of `least` words or more, word by word. 0 is no item's word."""
    least, out = min(least, len(item)), []
    for i in range(len(doc)):
        for j in range(len(item)):
            if doc[i] == item[j] and not (i and j and doc[i - 1] == item[j - 1]):
                n = next((k for k in range(min(len(doc) - i, len(item) - j)) if doc[i + k] != item[j + k]), min(len(doc) - i, len(item) - j))
                if n >= least and doc[i]:
                    out.append((i, j, n))
    return out


def brute_tiles(doc, item, least):
    """Greedy string tiling as it is defined: mark the longest unmarked match until none is left."""
    a, b, total = [0] * len(doc), [0] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sorted(total)
        total.append(n)
        for k in range(n):
            a[i + k] = b[j + k] = 1


@pytest.mark.parametrize("seed", range(20))
def test_tiles_match_brute_force(seed):
    rng = random.Random(seed)
    item = [rng.choice("abcd") for _ in range(25)]
    doc = [rng.choice("abcde") for _ in range(40)]
    got = tiles(all_matches(doc, item), len(doc), len(item))
    want = brute_tiles(doc, item, 3)
    assert sum(n for *_, n in got) == pytest.approx(sum(want), abs=4)  # ties may be broken otherwise
    used = [x + k for x, _, n in got for k in range(n)]
    assert len(used) == len(set(used)) and max((n for *_, n in got), default=0) == max(want, default=0)


def test_held_keeps_order():
    assert held([(0, 20, 20), (40, 0, 20)], 40) == 0.5
    assert held([(0, 0, 20), (40, 20, 20)], 40) == 1.0
    assert held([(0, 0, 9), (40, 20, 9)], 40) == 0.0
    assert held([], 0) == 0.0


def test_passages_with_few_long_seeds_are_found(spark):
    """Two altered words in each of three passages leave 15 of 86 five-word seeds, though 57 % of the item stands unaltered."""
    w, o = RNG.sample(WORDS, 90), OTHER.split()
    passages = [w[s : s + 4] + ["zz"] + w[s + 5 : s + 10] + ["yy"] + w[s + 11 : s + 19] for s in (0, 30, 60)]
    filled = [x if k % 7 < 3 else "zz" for k, x in enumerate(w)]  # set phrases of three words, filled in otherwise
    texts = [" ".join(" ".join(o[k * 50 : k * 50 + 40] + p) for k, p in enumerate(passages)), " ".join(filled)]
    items = spark.createDataFrame([(1, " ".join(w)), (2, "one two"), (3, "uno")], "item_id bigint, text string")
    got = leaked_items(docs_of(spark, [{"text": t} for t in [*texts, "x One, two!", "one x two", "uno"]]), items).collect()
    assert sorted(map(tuple, got)) == [(0, 1), (2, 2), (4, 3)]


@pytest.mark.parametrize("seed", range(10))
def test_candidates_lose_nothing(seed, monkeypatch):
    rng = random.Random(seed)
    items = Items([(k, " ".join(rng.choice("abcdefgh") for _ in range(n))) for k, n in enumerate((1, 2, 4, 7, 20, 30, 30))])
    docs = [items.encode(" ".join(rng.choice("abcdefghi") for _ in range(rng.randrange(90)))) for _ in range(30)]
    docs += [items.encode(" ".join(x if rng.random() < 0.8 else "i" for x in "abc")) for _ in range(5)]
    for w in items.words:
        docs.append(np.where(np.arange(len(w)) % 7 < 4, w, 0))
    every = {(d, i): all_matches(x.tolist(), w.tolist()) for d, x in enumerate(docs) for i, w in enumerate(items.words)}
    for share in (held, lambda m, n: tiled(m, n)[0]):
        want = {p: h for p, m in every.items() if (h := share(m, len(items.words[p[1]]))) >= leakage.COVER}
        for most in (4_000_000, 50, 1):
            monkeypatch.setattr(leakage, "BATCH_SEEDS", most)
            assert want and {(d, i): h for d, i, m in items.candidates(docs) if (h := share(m, len(items.words[i]))) >= leakage.COVER} == want


def altered_copies(rng, n, share=0.1):
    """Copies of ITEM, each with other words replaced by words of its own, with text between them."""
    w = ITEM.split()
    copies = [" ".join("zz" if rng.random() < share else x for x in w) for _ in range(n)]
    return [f" {OTHER} ".join(copies[:k]) for k in range(1, n + 1)]


def test_a_further_copy_never_lowers_held():
    items = Items([(1, ITEM)])
    w = items.words[0]
    for seed in range(60):
        shares = []
        for text in altered_copies(random.Random(seed), 3):
            doc = items.encode(text)
            found = next(m for _, _, m in items.candidates([doc]))
            shares.append(held(found, len(w)))
            assert shares[-1] >= held(tiles(found, len(doc), len(w)), len(w)) and tiled(found, len(w))[0] >= 0.55
        assert shares == sorted(shares) and shares[0] >= 0.55


def test_copies_altered_differently_are_found(spark):
    texts = [t for seed in range(40) for t in altered_copies(random.Random(seed), 3)]
    got = leaked_items(docs_of(spark, [{"text": t} for t in texts]), spark.createDataFrame([(1, ITEM)], "item_id bigint, text string"))
    assert got.count() == len(texts)


def test_passages_hold_together_closely():
    assert in_passages([(0, 0, 5), (7, 7, 9), (40, 20, 13), (60, 40, 7), (69, 46, 8)], 14) == [(0, 0, 5), (7, 7, 9), (60, 40, 7), (69, 46, 8)]
    assert in_passages([(0, 0, 7), (12, 8, 7)], 14) == [] and in_passages([], 1) == []
    assert tiled([(0, 30, 30), (90, 0, 28)], 60) == (1.0, 58 / 60) and tiled([(0, 0, 10), (90, 20, 10), (200, 40, 10)], 60) == (0.0, 0.0)


def test_short_items_in_two_pieces(spark):
    w, o = WORDS[:15], OTHER.split()
    items = spark.createDataFrame([(1, " ".join(w))], "item_id bigint, text string")
    got = leaked_items(docs_of(spark, [{"text": " ".join(o[:30] + w[:7] + o[30:60] + w[7:])}, {"text": " ".join(o[:30] + w[:4] + o[30:60] + w[10:])}]), items)
    assert [r.doc_id for r in got.collect()] == [0]


def test_one_word_over_and_over(spark):
    """Every place matches every place; steps of bounded size find the one match of each diagonal."""
    items = spark.createDataFrame([(1, "ha " * 60), (2, "ho " * 60)], "item_id bigint, text string")
    got = leaked_items(docs_of(spark, [{"text": "ha " * 4_000}, {"text": "ha " * 30}, {"text": "hu " * 4_000}]), items)
    assert [(r.doc_id, r.item_id) for r in got.collect()] == [(0, 1)]


def test_planted_copies_in_real_documents(spark):
    """Recall and precision on documents and items that share set phrases, with copies and decoys planted into some of them."""
    rng = random.Random(11)
    items = [r for r in table(spark, SF, "eval_items").collect() if len(words(r.text)) >= 50]
    docs = sorted(table(spark, SF, "documents").filter("length(text) > 400").collect(), key=lambda r: r.doc_id)
    there = {(r.doc_id, r.item_id) for r in leaked_items(table(spark, SF, "documents"), table(spark, SF, "eval_items")).collect()}
    rows, want = [], set()
    for n in range(600):
        doc, item = rng.choice(docs), rng.choice(items)
        w, d = item.text.split(), doc.text.split()
        kind = n % 6
        size = len(w)
        if kind in (0, 1):  # whole, or sixty percent and more
            k = size if kind == 0 else int(size * rng.uniform(0.62, 0.9))
            a = rng.randrange(size - k + 1)
            parts = [w[a : a + k]]
        elif kind in (2, 3):  # two passages, in order or not
            parts = [w[: int(size * 0.44)], w[int(size * 0.56) :]][:: 1 if kind == 2 else -1]
        elif kind == 4:  # the words in another order
            parts = [rng.sample(w, size)]
        else:  # a part
            parts = [w[: int(size * 0.4)]]
        if kind < 4:
            parts = [[x if rng.random() > 0.1 else "quux" for x in p] for p in parts]
        for p in parts:
            at = rng.randrange(len(d) + 1)
            d[at:at] = [*p, "Furthermore,", "besides,", "see", "above."]
        if kind == 2 or kind == 3:  # both somewhere, the first before the second
            d = doc.text.split()
            d = [*d[:40], *parts[0], "Furthermore,", "besides,", *d[40:120], *parts[1], *d[120:]]
        rows.append({"text": " ".join(d)})
        if kind < 4:
            want.add((n, item.item_id))
        want |= {(n, i) for e, i in there if e == doc.doc_id}
    got = {(r.doc_id, r.item_id) for r in leaked_items(docs_of(spark, rows), spark.createDataFrame([(r.item_id, r.text) for r in items], "item_id bigint, text string")).collect()}
    recall, precision = len(got & want) / len(want), len(got & want) / len(got)
    print("planted copies:", len(want), "recall", recall, "precision", precision)
    assert recall >= 0.97 and precision >= 0.99


def test_repeated_share(spark):
    w = OTHER.split()
    first = " ".join(w[:100])
    rows = [
        {"text": first, "applicant": "A"}, {"text": first + ". " + first, "applicant": " a"}, {"text": (" ".join(w[:12]) + " 7. ") * 20, "applicant": "b"}, {"text": None}, {"text": "", "applicant": "b"},
        {"text": "x"}, {"text": "go on " * 100, "applicant": "c"}, {"text": first + " " + " ".join(w[100:140]) + " " + " ".join(w[:15]), "applicant": None}, {"text": "粉塵が入らない。" * 30},
    ]
    got = {r.doc_id: r for r in repetition(docs_of(spark, rows, "host n failed repeated host_docs _salt")).collect()}
    assert len(got) == len(rows)
    assert [i for i in sorted(got) if got[i].repetitive] == [1, 2, 6, 8]
    assert got[0].repeated == 0 and got[1].repeated == 0.5 and got[2].repeated == pytest.approx(0.95) and got[3].n_words == got[4].n_words == 0
    assert got[0].host == got[1].host == "a" and got[0].host_docs == 2 and got[3].host_repetitive is None
    assert repetition(docs_of(spark, [])).collect() == []


def test_repetition_between_documents_is_none():
    ids = np.array(list(range(20)) * 2)
    codes = np.random.default_rng(1).integers(1, 2**63, 20, np.uint64)
    assert not repeated_words(ids, np.repeat([0, 1], 20), codes).any()
    assert repeated_words(ids, np.zeros(40, int), codes).sum() == 20
    assert repeated_words(ids[:3], np.zeros(3, int), codes).sum() == 0


def test_sentences():
    assert sentence_shares(sentences("A b. a B! c d.")) == (pytest.approx(2 / 6), 0.0, [False, True, False])
    assert sentence_shares(sentences("...")) == (0.0, 0.0, [])


def short_sentences(n, size, drawn, seed=7):
    """A text of `drawn` sentences in random order, of n different ones of `size` words."""
    rng = random.Random(seed)
    own = [" ".join(rng.sample(WORDS, size)) for _ in range(n)]
    return ". ".join(rng.choices(own, k=drawn)) + "."


def test_sentences_count_where_no_ten_words_repeat(spark):
    texts = [short_sentences(20, 4, 100), short_sentences(40, 8, 160), "A b. " * 2 + OTHER]
    got = {r.doc_id: r for r in repetition(docs_of(spark, [{"text": t} for t in texts])).collect()}
    for i, t in enumerate(texts):
        assert (got[i].said_before, got[i].top_sentence) == sentence_shares(sentences(t))[:2]
    assert got[0].said_before > 0.7 and got[1].said_before > 0.7 and got[2].said_before > 0
    assert got[0].repetitive and got[1].repetitive and not got[2].repetitive


def test_set_sentence_between_new_words(spark):
    text = "".join(f"{' '.join(WORDS[3 * k : 3 * k + 3])}. This is said again and again here. " for k in range(200))
    r = repetition(docs_of(spark, [{"text": text}])).first()
    assert r.repeated == pytest.approx(0.7, abs=0.01) and r.repetitive


def brute_repeated(text, gram=10):
    """Share of words in ten-word runs or sentences that the text had before, place by place."""
    parts = sentences(text)
    w = [x for p in parts for x in p]
    marks, at = [False] * len(w), 0
    for i in range(len(w) - gram + 1):
        if any(w[j : j + gram] == w[i : i + gram] for j in range(i)):
            marks[i : i + gram] = [True] * gram
    for k, p in enumerate(parts):
        if p in parts[:k]:
            marks[at : at + len(p)] = [True] * len(p)
        at += len(p)
    return sum(marks) / max(1, len(w))


def test_repeated_matches_brute_force(spark):
    rng = random.Random(5)
    texts = [short_sentences(rng.randrange(2, 12), rng.randrange(1, 14), rng.randrange(1, 15), seed) for seed in range(40)]
    texts += [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(5)]
    got = {r.doc_id: r.repeated for r in repetition(docs_of(spark, [{"text": t} for t in texts])).collect()}
    assert [got[i] for i in range(len(texts))] == [pytest.approx(brute_repeated(t)) for t in texts]


def test_hosts_move_the_needed_share(spark):
    """Near the threshold the host decides; far from it, or without a host, the document alone."""
    w = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    part = lambda k: ". ".join([" ".join(w), " ".join(w[:k])])  # noqa: E731  repeats k words of 100 + k
    rows = [{"text": part(80), "applicant": a} for a in ("spam", "odd")] + [{"text": part(80)}]  # 0.444
    rows += [{"text": part(100), "applicant": "spam"} for _ in range(60)] + [{"text": part(20), "applicant": f"h{k % 9}"} for k in range(90)] + [{"text": part(20), "applicant": "spam"}]
    got = {r.doc_id: r for r in repetition(docs_of(spark, rows)).collect()}
    assert got[0].repetitive and not got[1].repetitive and not got[2].repetitive and got[2].needed == 0.45
    assert 0.42 <= got[0].needed < 0.444 < got[1].needed and not got[len(rows) - 1].repetitive and got[5].repetitive


def test_prior_shrinks_small_hosts(spark):
    hosts = spark.createDataFrame([(100, 2), (100, 4), (50, 40), (2, 2), (1, 1)], "n bigint, failed bigint")
    a, b = beta_prior(hosts)
    assert a > 0 and b > 0 and (2 + a) / (2 + a + b) < (40 + a) / (50 + a + b) + 0.2
    assert beta_prior(hosts.limit(0)) == (0.5, 0.5)
    assert all(x > 0 for x in beta_prior(hosts.filter("failed > 100 or n = 1")))


def test_mix(spark):
    rows = [{"source": s, "text": " ".join(RNG.choices(WORDS, k=RNG.randrange(5, 60)))} for s, n in (("big", 3000), ("small", 60), ("mid", 500), ("off", 50)) for _ in range(n)] + [{"source": None, "text": "x y"}, {"source": "mid", "text": None}]
    docs = docs_of(spark, rows, "tokens b rank o copies parts carry")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("mid", 0.15, 2), ("gone", 0.05, 9)], "source string, target_share double, max_repeats int")
    m = Mix(docs, targets)
    report = {r.source: r for r in m.report().collect()}
    total = sum(r.tokens for r in report.values())
    assert {s for s, r in report.items() if r.short} == {"small", "gone"}
    assert report["small"].n_copies == 240 and report["small"].most_copies == 4 and report["gone"].mixed_tokens == 0
    for s in ("big", "mid"):
        assert report[s].mixed_tokens / total == pytest.approx(report[s].target_share, rel=0.08)
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    copies = m.copies().collect()
    assert len({r.doc_id for r in copies}) == len(copies) and all(r.copies <= 4 and r.source in report for r in copies)
    expected = sum(report[s].target_share * total / report[s].tokens * report[s].n_docs for s in ("big", "mid"))
    assert abs(sum(r.copies for r in copies if r.source in ("big", "mid")) - expected) <= 2  # one a source


def test_mix_in_blocks_gives_the_same_counts(spark, monkeypatch):
    docs = docs_of(spark, [{"source": "a" if i % 3 else "b", "text": "w " * (i % 7)} for i in range(500)])
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 2)], "source string, target_share double, max_repeats int")
    one = {r.source: r.n_copies for r in Mix(docs, targets).report().collect()}
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 20)
    many = {r.source: r.n_copies for r in Mix(docs, targets).report().collect()}
    assert all(abs(one[s] - many[s]) <= 1 for s in one)
    assert Mix(docs.limit(0), targets).copies().collect() == [] and {r.actual_share for r in Mix(docs.limit(0), targets).report().collect()} == {None}
    with pytest.raises(ValueError):
        Mix(docs, targets.union(targets))


def test_tokens(spark):
    got = {r.doc_id: r.tokens for r in token_counts(docs_of(spark, [{"text": "hello world", "source": "a"}, {"text": None}, {"text": ""}, {"text": "a " * 50_000}, {"text": "<|endoftext|>"}])).collect()}
    assert got[0] == 2 and got[1] == got[2] == 0 and got[3] > 49_000 and got[4] > 1
