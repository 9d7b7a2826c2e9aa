"""The most frequent values of a column by lossy counting, in bounded memory, with guaranteed intervals.

Each task runs lossy counting over its share of the rows: a bucket ends every 1/epsilon values, and entries whose count
plus maximum undercount doesn't exceed the number of the bucket are dropped. A task's summary has at most about
(1/epsilon) log(epsilon n) entries. Summaries merge by adding counts and undercounts; a value absent from a summary may
have been undercounted there by that task's number of buckets.

Values travel as 64-bit hashes. The few candidates get their texts, and their exact counts, in a second pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.session import materialize

#: Undercount as a share of the rows.
EPSILON = 2e-5
#: Candidates that may be broadcast; more are joined as the optimizer sees fit.
MOST_BROADCAST = 1_000_000


class LossyCounter:
    """Lossy counting over arrays of int64, a bucket at a time."""

    def __init__(self, epsilon: float):
        self.width = int(np.ceil(1 / epsilon))
        self.n, self.bucket = 0, 0
        self.keys = np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)
        self.under = np.empty(0, np.int64)
        self.rest: list[np.ndarray] = []
        self.waiting = 0

    def _prune(self) -> None:
        self._flush()
        self.bucket += 1
        keep = self.counts + self.under > self.bucket
        self.keys, self.counts, self.under = self.keys[keep], self.counts[keep], self.under[keep]

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        while len(values):
            room = self.width - self.waiting
            self.rest.append(values[:room])
            self.waiting += len(values[:room])
            values = values[room:]
            if self.waiting == self.width:
                self._prune()

    def _flush(self) -> None:
        """Count what waits into the entries; a new entry may have been missed in every earlier bucket."""
        if not self.waiting:
            return
        new, n = np.unique(np.concatenate(self.rest), return_counts=True)
        self.rest, self.waiting = [], 0
        at = np.searchsorted(self.keys, new)
        here = (at < len(self.keys)) & (self.keys[np.minimum(at, max(0, len(self.keys) - 1))] == new) if len(self.keys) else np.zeros(len(new), bool)
        self.counts[at[here]] += n[here]
        keys = np.concatenate([self.keys, new[~here]])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.counts = np.concatenate([self.counts, n[~here]])[order]
        self.under = np.concatenate([self.under, np.full((~here).sum(), self.bucket)])[order]

    def summary(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries, their counts and undercounts. After a first bucket, a begun one counts as a whole and is pruned too."""
        if self.bucket and self.waiting:
            self._prune()
        self._flush()
        return self.keys, self.counts, self.under


def _summaries(epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = LossyCounter(epsilon / 2)  # a begun bucket that is pruned at the end costs as much again, at most
        total = 0
        for b in batches:
            h = b.column("h")
            total += len(h)
            counter.add(h.drop_null().to_numpy())
        keys, counts, under = counter.summary()
        # One more row tells the task's rows and its number of buckets.
        yield pa.RecordBatch.from_arrays([
            pa.array([None, *keys.tolist()], pa.int64()), pa.array([total, *counts.tolist()], pa.int64()), pa.array([counter.bucket, *(under - counter.bucket).tolist()], pa.int64())
        ], ["h", "n", "d"])

    return run


def lossy_counts(logs: DataFrame, column: str, epsilon: float = EPSILON, least: float = 0.0) -> DataFrame:
    """Values of a string column with guaranteed bounds: h (hash), low, high and total, the number of all records.

    The true count n of each value of `least` times total or more satisfies low <= n <= high, high - low <= epsilon
    total; values whose high is less are left out. Null and empty values aren't counted but are in total. Replayed rows
    count once by id. An empty table gives no rows.
    """
    value = F.col(column)
    rows = logs.select(F.col("id").alias("i"), F.when(value != "", F.xxhash64(value)).alias("h")).distinct()
    parts = rows.select("h").mapInArrow(_summaries(epsilon), "h bigint, n bigint, d bigint")
    # A value's undercount is, over all tasks, their buckets, less what a task that has it rules out.
    merged = parts.groupBy("h").agg(F.sum("n").alias("low"), F.sum("d").alias("d"))
    merged = materialize(merged)
    whole = merged.filter("h is null").first()
    total, missed = (whole["low"], whole["d"]) if whole else (0, 0)
    found = merged.filter("h is not null").withColumn("high", F.col("low") + F.col("d") + F.lit(missed)).withColumn("total", F.lit(total).cast("bigint"))
    return found.filter(F.col("high") >= F.lit(total * least)).select("h", "low", "high", "total")


def frequent_values(logs: DataFrame, column: str, least: float, epsilon: float = EPSILON) -> DataFrame:
    """The exact values held by at least `least` of all records: value, n, low, high, total.

    Lossy counting names the candidates, at most 1/(least - epsilon) of them, and their intervals; their exact counts and
    texts come from a second pass that reads only rows with a candidate's hash. Case and blanks are kept; other rules as
    for lossy_counts.
    """
    if not 0 < epsilon < least:
        raise ValueError("epsilon must lie between 0 and least")
    candidates = lossy_counts(logs, column, epsilon, least)
    value = F.col(column)
    rows = logs.filter(value != "").select(F.col("id").alias("i"), value.alias("value"), F.xxhash64(value).alias("h"))
    few = 1 / (least - epsilon) <= MOST_BROADCAST
    held = rows.join(F.broadcast(candidates) if few else candidates, "h").distinct()
    exact = held.groupBy("value", "low", "high", "total").agg(F.count(F.lit(1)).alias("n"))
    return exact.filter(F.col("n") >= F.col("total") * F.lit(least)).select("value", "n", "low", "high", "total")
