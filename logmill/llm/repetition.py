"""How much of a document repeats what it said before, and whether its host tends to such texts.

Each document is measured against rules. Rule failures are added up per host, here the applicant. A host's rate of failure is
shrunk towards the empirical beta prior of all hosts, so that a host of few documents isn't judged by chance, and the
host's verdict is joined back to its documents, where it moves the share from which a document counts as repetitive.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.words import words
from logmill.operators.skew import salted_join
from logmill.session import materialize

#: A word is repeated if it lies in a run of this many words that the document had before, or in a sentence it had before.
#: The set wording of claims is no run of this length and no sentence by itself.
GRAM = 10
#: Share of repeated words from which a document is made up mainly of repetition.
SHARE = 0.45
#: Further rules of a document: shares of its words in sentences said before, and in its one most frequent sentence.
SENTENCE_SHARE, TOP_SHARE = 0.40, 0.25
#: A host's shrunk rate of failing documents from which it is a repetitive host.
HOST_RATE = 0.5
#: A measured share is off by about this much, as runs begin and end in mid-sentence. By so much, times the log odds of its
#: host against those of all hosts, less is asked of a document; at most by HOST_MOST, either way.
HOST_PART, HOST_MOST = 0.01, 0.03

_SENTENCE = re.compile(r"[.!?;。！？；]+\s*|\n+")


def repeated_words(ids: np.ndarray, owner: np.ndarray, codes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Which words of texts laid end to end (owner tells whose) lie in a gram that the same text had before."""
    n = len(ids) - gram + 1
    again = np.zeros(len(ids), bool)
    if n <= 0:
        return again
    h = np.zeros(n, np.uint64)
    for i in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[ids[i : i + n]]
    inside = np.flatnonzero(owner[gram - 1 :] == owner[:n])
    h = (h[inside] + owner[inside].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)  # the same gram of two texts differs
    order = np.argsort(h, kind="stable")
    same = np.append(False, h[order][1:] == h[order][:-1])
    later = inside[order[same]]
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, later, 1)
    np.add.at(edges, later + gram, -1)
    return np.cumsum(edges)[:-1] > 0


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence that has any; end to end they are the text's words."""
    return [w for s in _SENTENCE.split(text.lower()) if (w := words(s))] if text else []


def sentence_shares(parts: list[list[str]]) -> tuple[float, float, list[bool]]:
    """Shares of the letters of sentences in those said before, and in the most frequent one if that occurs three times; and
    of each sentence whether it was said before."""
    seen: dict[str, int] = defaultdict(int)
    total = again = 0
    said = []
    for s in parts:
        key = "".join(s)
        total += len(key)
        again += len(key) if seen[key] else 0
        said.append(seen[key] > 0)
        seen[key] += 1
    if not total:
        return 0.0, 0.0, said
    return again / total, max((len(k) * n for k, n in seen.items() if n >= 3), default=0) / total, said


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary: defaultdict[str, int] = defaultdict(count().__next__)
    rng = np.random.default_rng(11)
    codes = np.empty(0, np.uint64)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        n_words, share, said, top = [], [], [], []
        for first in range(0, len(texts), 256):
            parts = [sentences(t) for t in texts[first : first + 256]]
            some = [[x for s in p for x in s] for p in parts]
            lengths = np.array([len(w) for w in some])
            ids = np.fromiter((vocabulary[x] for w in some for x in w), np.int64, lengths.sum())
            if len(codes) < len(vocabulary):
                codes = np.append(codes, rng.integers(1, 2**63, len(vocabulary) - len(codes), np.uint64) * np.uint64(2) + np.uint64(1))
            owner = np.repeat(np.arange(len(some)), lengths)
            shares = [sentence_shares(p) for p in parts]
            before = np.fromiter((f for (*_, flags), p in zip(shares, parts) for f, s in zip(flags, p) for _ in s), bool, len(ids))
            again = np.bincount(owner, before | repeated_words(ids, owner, codes), minlength=len(some)) if len(ids) else np.zeros(len(some))
            n_words += lengths.tolist()
            share += (again / np.maximum(1, lengths)).tolist()
            said += [a for a, _, _ in shares]
            top += [b for _, b, _ in shares]
            if len(vocabulary) > 2_000_000:  # bounds the task's memory; numbers hold within a batch only
                vocabulary.clear()
                vocabulary.default_factory = count().__next__
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), pa.array(n_words, pa.int64()), pa.array(share, pa.float64()), pa.array(said, pa.float64()), pa.array(top, pa.float64())], ["doc_id", "host", "n_words", "repeated", "said_before", "top_sentence"])


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """a and b of the beta distribution whose mean and variance the hosts' failure rates have, by moments over all hosts.

    Hosts of two documents or more count, by their documents. Without spread, or without hosts, a weak prior at the mean.
    """
    r = F.col("failed") / F.col("n")
    row = hosts.filter("n >= 2").agg(F.sum("n").alias("n"), F.sum("failed").alias("f"), F.sum(F.col("n") * r * r).alias("s"), F.sum(F.lit(1.0)).alias("k")).first()
    if not row["n"]:
        return 0.5, 0.5
    mean = row["f"] / row["n"]
    within = mean * (1 - mean) * row["k"] / row["n"]  # of the variance, what chance alone gives
    between = row["s"] / row["n"] - mean * mean - within
    if not 0 < mean < 1:
        return (0.5, 0.5) if mean == 0.5 else (max(1e-3, mean), max(1e-3, 1 - mean))
    size = mean * (1 - mean) / between - 1 if between > 1e-9 else 1000.0
    size = min(1000.0, max(1.0, size))
    return mean * size, (1 - mean) * size


def repetition(documents: DataFrame, share: float = SHARE, host_rate: float = HOST_RATE) -> DataFrame:
    """Each document's shares and verdicts: doc_id, host, n_words, repeated, said_before, top_sentence, n_failed, host_docs,
    host_failure, host_repetitive, needed and repetitive.

    repeated is the share of words in runs of ten words, or in sentences, that the document had before; case, digits and
    punctuation don't matter. n_failed counts the rules that the document fails, host_failure is the host's shrunk rate of
    failing documents. needed is share, moved by the host's log odds (HOST_PART); repetitive: repeated >= needed. Documents
    without an applicant have no host verdict, and share is needed of them. A null or empty text has 0 words and
    shares of 0. A text that occurs in several documents is no repetition. Texts of any length are read whole. An empty table
    gives no rows; further columns are not read.
    """
    slim = documents.select("doc_id", F.lower(F.trim("applicant")).alias("host"), "text")
    schema = "doc_id bigint, host string, n_words bigint, repeated double, said_before double, top_sentence double"
    rules = [F.col("repeated") >= share, F.col("said_before") >= SENTENCE_SHARE, F.col("top_sentence") >= TOP_SHARE]
    failed = sum((r.cast("int") for r in rules[1:]), rules[0].cast("int"))
    docs = materialize(slim.mapInArrow(_measure, schema).withColumn("n_failed", failed))
    hosts = docs.filter("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_failed") > 0).alias("failed"))
    a, b = beta_prior(hosts)
    judged = hosts.select("host", F.col("n").alias("host_docs"), ((F.col("failed") + a) / (F.col("n") + a + b)).alias("host_failure"))
    out = salted_join(docs, judged, "host", "doc_id")
    odds = F.ln(F.col("host_failure") / (1 - F.col("host_failure"))) - float(np.log(a / b))
    moved = F.greatest(F.lit(-HOST_MOST), F.least(F.lit(HOST_MOST), HOST_PART * odds))
    out = out.withColumn("host_repetitive", F.col("host_failure") >= host_rate).withColumn("needed", F.lit(share) - F.when(odds.isNotNull(), moved).otherwise(0.0))
    return out.withColumn("repetitive", F.col("repeated") >= F.col("needed"))
