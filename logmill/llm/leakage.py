"""Which documents contain which evaluation items, wholly or in part, by greedy string tiling.

1. Seeds: three-word grams that a document shares with an item, found for a whole batch of documents at once by their
   Karp-Rabin hashes in the items' sorted gram table, and joined to matches. Pairs whose matches can't make up passages
   enough are out.
2. Passages: matches that follow each other closely on both sides, in the item's order.
3. Tiles: of the matches in passages of some length, the longest that isn't marked is marked, again and again. The
   passages may come in any order; what the tiles cover of the item must be enough.
4. Passages that keep the item's order among each other may be shorter. There the best choice of passages counts.

The items are a fixed set, small against the documents. They are sent to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.llm.words import words

#: Words of a seed, and of the shortest match.
TILE = 3
#: Words between two tiles of one passage, on either side.
NEAR = 4
#: Words of a passage among others that keep the item's order, and of one anywhere; less is a clause or a set phrase. Of
#: short items a third, and half, are enough.
PASSAGE, FREE_PASSAGE = 10, 14
COVER = 0.55
#: Share of an item's words that must stand unaltered in these passages. COVER with one word in ten altered keeps 0.48 on
#: average in matches; set phrases filled in otherwise (up to 0.44 on the test documents) are no copy.
KEPT = 0.45
#: Seeds held at a time, about: a document's words after these many are looked up in a further step.
BATCH_SEEDS = 4_000_000
#: Words of one block of items: what a task holds of them at a time.
BLOCK_WORDS = 1_000_000


class Items:
    """The words of some items as numbers, and their table of seeds."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.words = [], []
        for item, text in rows:
            w = words(text)
            if w:
                self.ids.append(item)
                self.words.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64))
        rng = np.random.default_rng(7)
        self.codes = np.append(np.uint64(0), rng.integers(1, 2**63, len(self.vocabulary), np.uint64) * np.uint64(2) + np.uint64(1))
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(np.append(0, self.sizes + 1))[:-1]
        self.flat = np.concatenate([np.append(w, -1) for w in self.words]) if self.words else np.empty(0, np.int64)
        self.owner = np.repeat(np.arange(len(self.words)), self.sizes + 1)
        self.tables = {}
        for k in sorted({min(TILE, len(w)) for w in self.words}):
            own = [i for i, w in enumerate(self.words) if min(TILE, len(w)) == k]
            grams = np.concatenate([self.grams(self.words[i], k) for i in own])
            places = np.concatenate([self.starts[i] + np.arange(self.sizes[i] - k + 1) for i in own])
            order = np.argsort(grams, kind="stable")
            self.tables[k] = grams[order], places[order]

    def grams(self, w: np.ndarray, k: int) -> np.ndarray:
        n = max(0, len(w) - k + 1)
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.codes[w[i : i + n]]
        return h

    def encode(self, text: str | None) -> np.ndarray:
        w = words(text)
        get = self.vocabulary.get
        return np.fromiter((get(x, 0) for x in w), np.int64, len(w))

    def candidates(self, docs: list[np.ndarray], cover: float = COVER) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
        """Pairs (document, item) by their places that may hold `cover`, with the matches that passages of theirs can have.

        Left out is only what can't count. The matches of a passage lie near each other, in the document and by diagonals, and
        have PASSAGE words. Each has k words at least and NEAR others before the next, so that of a passage more than
        k / (k + NEAR) is in matches.
        """
        out = []
        lengths = np.array([len(d) + 1 for d in docs])
        flat = np.concatenate([np.append(d, 0) for d in docs]) if docs else np.empty(0, np.int64)  # 0 is no item's word
        starts, owner = np.cumsum(np.append(0, lengths)), np.repeat(np.arange(len(docs)), lengths)
        unknown = np.cumsum(np.append(0, flat == 0))
        for k, (table, places) in self.tables.items():
            if len(flat) <= k:
                continue
            fit = np.flatnonzero(unknown[k:] == unknown[:-k])
            h = self.grams(flat, k)[fit]
            lo = np.searchsorted(table, h)
            count = np.searchsorted(table, h, "right") - lo
            found = []
            for a, b in _steps(count, BATCH_SEEDS):
                c = count[a:b]
                x = np.repeat(fit[a:b], c)
                y = places[np.repeat(lo[a:b], c) + np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c)]
                # Seeds next to each other on one diagonal form a match, from the one without a predecessor to the one without a successor.
                begins, ends = (x == 0) | (flat[x - 1] != self.flat[y - 1]), flat[x + k] != self.flat[y + k]
                found.append((x[begins], y[begins], x[ends], y[ends]))
            if not found:
                continue
            x, y, last, z = (np.concatenate(f) for f in zip(*found))
            last = last[np.lexsort((last, z - last))]
            order = np.lexsort((x, y - x))
            x, y = x[order], y[order]
            n = last + k - x
            pair = owner[x] * len(self.words) + self.owner[y]
            order = np.lexsort((y - x, pair))
            x, y, n, pair = x[order], y[order], n[order], pair[order]
            near = np.cumsum((np.diff(pair, prepend=-1) != 0) | (np.diff(y - x, prepend=0) > NEAR))
            least = _least(self.sizes)[pair % len(self.words)]
            keep = np.flatnonzero(np.bincount(near, n)[near] >= least)
            keep = keep[np.lexsort((x[keep], near[keep]))]
            x, y, n, pair, near, least = (a[keep] for a in (x, y, n, pair, near, least))
            place = near * (len(flat) + NEAR + 1) + x
            reach = np.maximum.accumulate(place + n)
            group = np.cumsum(np.append(True, place[1:] - reach[:-1] > NEAR)[: len(x)])
            keep = np.bincount(group, n)[group] >= least
            x, y, n, pair = (a[keep] for a in (x, y, n, pair))
            keep = np.bincount(pair, n)[pair] * (k + NEAR) >= cover * k * self.sizes[pair % len(self.words)]
            x, y, n, pair = (a[keep] for a in (x, y, n, pair))
            order = np.argsort(pair, kind="stable")
            x, y, n, pair = x[order], y[order], n[order], pair[order]
            pairs, first = np.unique(pair, return_index=True)
            for p, a, b in zip(pairs.tolist(), first, np.append(first[1:], len(pair))):
                d, i = divmod(p, len(self.words))
                out.append((d, i, list(zip((x[a:b] - starts[d]).tolist(), (y[a:b] - self.starts[i]).tolist(), n[a:b].tolist()))))
        return out


def _steps(count: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts of an array into stretches that add up to about `most`, or are one number."""
    sums, at = np.cumsum(count), 0
    while at < len(count):
        till = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most, "right")))
        yield at, till
        at = till


def _least(size, most: int = PASSAGE, part: int = 3):
    """Words of the shortest passage of items of some sizes."""
    return np.minimum(most, np.maximum(np.minimum(5, size), -(-size // part)))


def tiles(found: Iterable[tuple[int, int, int]], doc_size: int, item_size: int, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling over matches: (place in doc, place in item, words) of the marked ones, longest first, no word twice."""
    k = min(least, item_size)
    heap = [(-n, x, y) for x, y, n in found]
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(doc_size, bool), np.zeros(item_size, bool)
    out = []
    while heap:
        n, x, y = heapq.heappop(heap)
        n = -n
        free = ~(in_doc[x : x + n] | in_item[y : y + n])
        if free.all():
            out.append((x, y, n))
            in_doc[x : x + n] = in_item[y : y + n] = True
            continue
        # What the marks left of this match goes back, if it is long enough.
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for s, e in zip(edge[::2], edge[1::2]):
            if e - s >= k:
                heapq.heappush(heap, (-int(e - s), x + int(s), y + int(s)))
    return out


def in_passages(found: Iterable[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """The matches that lie in a passage of at least `least` words in matches."""
    runs = sorted(found)
    starts = [x for x, _, _ in runs]
    widest = max((n for _, _, n in runs), default=0)
    before: list[list[tuple[int, int]]] = []
    most = []  # words of the longest passage that ends with a match
    for a, (x, y, n) in enumerate(runs):
        links = []
        for b in range(bisect_left(starts, x - NEAR - widest), a):
            px, py, pn = runs[b]
            s = max(0, px + pn - x, py + pn - y)  # what both have counts for the first
            if s < n and py < y and x + s - px - pn <= NEAR and y + s - py - pn <= NEAR:
                links.append((b, n - s))
        before.append(links)
        most.append(max((most[b] + w for b, w in links), default=n))
    best = most[:]  # words of the longest passage that a match is in
    for a in range(len(runs) - 1, -1, -1):
        for b, w in before[a]:
            best[b] = max(best[b], most[b] + w + best[a] - most[a])
    return [r for r, w in zip(runs, best) if w >= least]


def tiled(found: Iterable[tuple[int, int, int]], size: int) -> tuple[float, float]:
    """Shares of an item in tiles of passages in any order: with the words altered between them, and without.

    Up to NEAR words of the item between two tiles count as altered, wherever the tiles are in the document, so that it
    doesn't matter if they come from several copies.
    """
    runs = in_passages(found, int(_least(size, FREE_PASSAGE, 2)))
    if not size or sum(n for _, _, n in runs) * (TILE + NEAR) < TILE * COVER * size:
        return 0.0, 0.0
    first = min(x for x, _, _ in runs)
    marked = tiles([(x - first, y, n) for x, y, n in runs], max(x + n for x, _, n in runs) - first, size)
    spans = sorted((y, y + n) for _, y, n in marked)
    between = [b - a for (_, a), (b, _) in zip(spans, spans[1:])]
    kept = sum(n for _, _, n in marked)
    return (kept + sum(g for g in between if g <= NEAR)) / size, kept / size


def held(found: Iterable[tuple[int, int, int]], size: int, altered: bool = True) -> float:
    """Share of an item's words in passages that keep its order. A word altered inside a passage counts as held, if altered.

    found has matches (place in doc, place in item, words), which may overlap; where they do, the later one counts from
    the earlier one's end. Of all ways to join them to passages and these to an order the best counts, so that no further
    match, and so no further copy of the item, lowers the share.
    """
    least = int(_least(size))
    runs = sorted((x + n, y + n, x, y) for x, y, n in found)
    ends = [r[0] for r in runs]
    # States of each match: by the words of the passage that it ends, the most item words held till its end, less its item end if altered.
    states: list[dict[int, int]] = []
    # The most item words held by passages that end at a place of the item or before, from each place in the document on.
    since, tops = [-1], [[0] * (size + 1)]
    for a, (de, ie, x, y) in enumerate(runs):
        state: dict[int, int] = {}
        n = de - x

        def put(words: int, value: int) -> None:
            words = min(least, words)
            if value > state.get(words, -size - 1):
                state[words] = value

        at = bisect_right(since, x) - 1
        for v in range(at, bisect_left(since, de)):  # passages that end inside the match leave it the words after them
            s = max(0, since[v] - x)
            top = tops[v]
            put(n - s, top[y + s] - y - s if altered else top[y + s] + n - s)
            for t in range(s + 1, n):
                if top[y + t] > top[y + t - 1]:
                    put(n - t, top[y + t] - y - t if altered else top[y + t] + n - t)
        for b in range(bisect_left(ends, x - NEAR), a):
            pd, pi = runs[b][:2]
            s = max(0, pd - x, pi - y)
            if s < n and x + s - pd <= NEAR and y + s - pi <= NEAR:
                for words, value in states[b].items():
                    put(words + n - s, value if altered else value + n - s)
        states.append(state)
        if least in state and (total := state[least] + ie * altered) > tops[-1][ie]:
            top = tops[-1][:ie] + [max(total, z) for z in tops[-1][ie:]]
            if since[-1] == de:
                tops[-1] = top
            else:
                since.append(de)
                tops.append(top)
    return tops[-1][size] / size if size else 0.0


def _matched(found: Iterable[tuple[int, int, int]], size: int) -> int:
    """Words of an item that any match has."""
    marks = bytearray(size)
    for _, y, n in found:
        marks[y : y + n] = b"\1" * n
    return sum(marks)


SCHEMA = "doc bigint, item bigint, tiled double, tiled_kept double, held double, held_kept double"


def _scan(rows: list[tuple[int, str]], cover: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows)
        for batch in batches:
            ids, texts = batch.column("doc"), batch.column("text")
            found = []
            for first in range(0, len(ids), 256):
                docs = [items.encode(t) for t in texts.slice(first, 256).to_pylist()]
                for d, i, runs in items.candidates(docs, cover):
                    size = len(items.words[i])
                    if _matched(runs, size) < cover * KEPT / COVER * size:
                        continue  # too little of it stands unaltered
                    found.append((ids[first + d].as_py(), items.ids[i], *tiled(runs, size), held(runs, size), held(runs, size, False)))
            cols = list(zip(*found)) if found else [()] * 6
            kinds = (pa.int64(), pa.int64(), *[pa.float64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc", "item", "tiled", "tiled_kept", "held", "held_kept"])

    return run


def tiled_pairs(documents: DataFrame, items: DataFrame, cover: float = COVER) -> DataFrame:
    """Pairs that may reach `cover` and have enough of it unaltered: doc_id, item_id, tiled (share of the item in tiles of passages in any order), held (share
    in passages in its order), and of both the share that is unaltered, tiled_kept and held_kept.

    Null or empty texts, of items or documents, match nothing. An item of fewer than five words must occur as one piece.
    Items alike in text are found alike. Texts of any length are read whole. Empty tables give no rows. A document listed
    twice gives its rows twice; further columns are not read.
    """
    docs = documents.select(F.col("doc_id").alias("doc"), "text").filter("text is not null")
    known = items.select("item_id", "text").filter("text is not null and item_id is not null").distinct()
    size = known.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * BLOCK_WORDS)))
    out = None
    for b in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in known.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        found = docs.mapInArrow(_scan(rows, cover), SCHEMA)
        out = found if out is None else out.unionAll(found)
    return out.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "tiled", "tiled_kept", "held", "held_kept")


def _leaked(cover: float, *kinds: str) -> Column:
    """Whether a pair is a case by its tiles, or by passages in order."""
    any_of = [(F.col(k) >= cover) & (F.col(f"{k}_kept") >= cover * KEPT / COVER) for k in kinds]
    return any_of[0] if len(any_of) == 1 else any_of[0] | any_of[1]


def leaked_items(documents: DataFrame, items: DataFrame, cover: float = COVER) -> DataFrame:
    """The documents that hold at least `cover` of an item, in passages that keep its order: doc_id, item_id. Rules as for tiled_pairs."""
    return tiled_pairs(documents, items, cover).filter(_leaked(cover, "tiled", "held")).select("doc_id", "item_id")


def leak_report(documents: DataFrame, items: DataFrame, cover: float = COVER) -> DataFrame:
    """Per leaked item: the number of documents that hold it, and of those that have its passages in another order."""
    pairs = tiled_pairs(documents, items, cover).filter(_leaked(cover, "tiled", "held"))
    return pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(~_leaked(cover, "held")).alias("n_reordered"))
