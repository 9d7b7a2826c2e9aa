"""How often every distinct term occurs, and in how many records, through a global integer dictionary.

1. Each task encodes its records block by block: a block's own dictionary, and two count arrays over it, one for
   occurrences and one for records. A hot term is one entry of each block from here on.
2. The distinct terms of all blocks form the global dictionary; each gets an integer identifier.
3. Blocks are recoded to global identifiers, and their arrays are summed by ranges of identifiers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmill.functions.entries import int_div, label_terms, service_key
from logmill.functions.levels import level_name
from logmill.session import materialize

#: Identifiers of one range, the length of the arrays that are summed.
RANGE = 1 << 16
#: Terms of a slice of the dictionary, which one task sorts; and slices, whose sizes are broadcast.
SLICE_TERMS, MOST_SLICES = 200_000, 1 << 16
#: Distinct terms after which a task closes a block, which bounds its memory.
BLOCK_TERMS = 500_000


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of records, each with a list of terms, into (term, n, n_records) of blocks."""
    codes: dict[str, int] = {}
    seen, held = np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def flush() -> pa.RecordBatch:
        k = len(codes)
        out = pa.RecordBatch.from_arrays([pa.array(codes, pa.string()), pa.array(seen[:k].copy()), pa.array(held[:k].copy())], ["term", "n", "n_records"])
        codes.clear()
        seen[:], held[:] = 0, 0
        return out

    for batch in batches:
        terms = batch.column("terms")
        owner, flat = pc.list_parent_indices(terms).to_numpy(), terms.flatten().dictionary_encode()
        local = flat.indices.to_numpy(zero_copy_only=False)
        words = flat.dictionary.to_pylist()
        code = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
        if len(codes) > len(seen):
            grow = max(len(codes), 2 * len(seen)) - len(seen)
            seen, held = np.append(seen, np.zeros(grow, np.int64)), np.append(held, np.zeros(grow, np.int64))
        if len(local):
            k = len(words)
            seen[code] += np.bincount(local, minlength=k)
            held[code] += np.bincount(np.unique(owner.astype(np.int64) * k + local) % k, minlength=k)
        if len(codes) >= BLOCK_TERMS:
            yield flush()
    yield flush()


def _with_ids(terms: DataFrame, at_most: int) -> DataFrame:
    """Give each distinct term a dense integer identifier: its slice's offset plus its place in the slice.

    Slices go by the terms' hash, so each holds about an equal number of them, SLICE_TERMS or less as there are at_most so many
    terms; only the sizes of the slices meet in one place.
    """
    slices = min(MOST_SLICES, max(1, -(-at_most // SLICE_TERMS)))
    cut = terms.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int"))
    sizes = cut.groupBy("slice").count()  # at most `slices` rows
    offset = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("slice", F.coalesce(F.sum("count").over(offset), F.lit(0)).alias("offset"))
    place = Window.partitionBy("slice").orderBy("term")
    return cut.withColumn("place", F.row_number().over(place)).join(F.broadcast(offsets), "slice").select("term", (F.col("offset") + F.col("place") - 1).alias("code"))


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the arrays of the ranges a task has, range by range as they come (they come sorted)."""
    now, n, r = None, np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64)

    def out() -> pa.RecordBatch:
        held = np.flatnonzero(r)
        return pa.RecordBatch.from_arrays([pa.array(held + now * RANGE, pa.int64()), pa.array(n[held]), pa.array(r[held])], ["code", "n", "n_records"])

    for b in batches:
        code, bn, br = (b.column(c).to_numpy() for c in ("code", "n", "n_records"))
        span = code // RANGE
        cuts = [0, *(np.flatnonzero(np.diff(span)) + 1).tolist(), len(span)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if span[lo] != now:
                if now is not None:
                    yield out()
                now = int(span[lo])
                n[:], r[:] = 0, 0
            at = code[lo:hi] - now * RANGE
            np.add.at(n, at, bn[lo:hi])
            np.add.at(r, at, br[lo:hi])
    if now is not None:
        yield out()


def term_counts(records: DataFrame) -> DataFrame:
    """Counts of every distinct term: term, code, n (occurrences) and n_records, of records (terms array<string>).

    A term that a record has twice counts twice in n and once in n_records. Null terms and null or empty arrays count
    nothing. An empty table gives no rows. Columns other than terms are not read.
    """
    terms = F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda t: t.isNotNull())
    blocks = materialize(records.select(terms.alias("terms")).mapInArrow(_count_blocks, "term string, n bigint, n_records bigint"))
    dictionary = materialize(_with_ids(blocks.select("term").distinct(), blocks.count()))
    coded = blocks.join(dictionary, "term").select("code", "n", "n_records")
    ranged = coded.withColumn("span", int_div(F.col("code"), RANGE))
    # Several tasks share a range's blocks; a second round adds up what they give.
    salted = ranged.withColumn("salt", F.pmod(F.xxhash64("code", "n", "n_records"), F.lit(8)))
    part = salted.repartition("span", "salt").sortWithinPartitions("span").select("code", "n", "n_records").mapInArrow(_sum_batches, "code bigint, n bigint, n_records bigint")
    total = part.repartition(int_div(F.col("code"), RANGE)).sortWithinPartitions("code").mapInArrow(_sum_batches, "code bigint, n bigint, n_records bigint")
    return total.join(dictionary, "code").select("term", "code", "n", "n_records")


def entry_terms(logs: DataFrame) -> DataFrame:
    """Terms of each entry, counted once by id, as field\\u0001term: its service key, its level name, its label terms."""
    tagged = lambda field, c: F.when(c.isNotNull(), F.array(F.concat(F.lit(field + "\u0001"), c))).otherwise(F.array().cast("array<string>"))
    once = logs.select(F.col("id").alias("i"), service_key(F.col("service")).alias("s"), F.col("level").alias("v"), label_terms(F.col("labels")).alias("l")).distinct()
    labels = F.transform("l", lambda t: F.concat(F.lit("label\u0001"), t))
    return once.select(F.concat(F.array(F.lit("\u0001")), tagged("service", F.col("s")), tagged("level", level_name(F.col("v"), None)), labels).alias("terms"))


def entry_term_counts(logs: DataFrame, rare: int = 2, common: float = 0.5) -> DataFrame:
    """Every service key, level name and label term: field, term, n, n_entries and mark (rare, common or null).

    rare: at most `rare` entries hold it; common: at least `common` of all entries do; a term that is both is rare.
    Null services, levels, labels and values are no term; an empty value is one. Replayed rows count once. Further columns are not read.
    """
    counts = materialize(term_counts(entry_terms(logs)))
    every = counts.filter(F.col("term") == "\u0001").first()  # the term that every entry holds
    total = every["n_records"] if every else 0
    out = counts.filter(F.col("term") != "\u0001").withColumn("field", F.substring_index("term", "\u0001", 1)).withColumn("term", F.expr("substring(term, instr(term, '\u0001') + 1)"))
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") >= F.lit(total * common), "common")
    return out.select("field", "term", "n", F.col("n_records").alias("n_entries"), mark.alias("mark"))
