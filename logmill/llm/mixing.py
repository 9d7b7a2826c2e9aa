"""A mix of sources by target shares of all tokens, small sources repeated up to a cap.

Each document of a source is expected to be emitted the same, possibly broken, number of times. Over a fixed order
within the source these expectations are summed up from a random offset, and a document is emitted once for each whole number
its interval crosses. So the number of copies of any stretch of the order is off by less than one.

The order is by hash, in blocks of bounded size, so that the sums of a source of any size need no single task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmill.operators.prefix import carry_in
from logmill.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer's vocabulary expects texts to be cut up first.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Expected copies are whole numbers of this part of a copy.
PART = 1_000_000
BLOCK_DOCS = 100_000
#: A row of the target table is a source's setting; more than this is no target table.
MOST_SOURCES = 10_000


def _count_tokens(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, f)}
        encode = tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return run


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """doc_id, source, tokens of each document by a public tokenizer; null and empty texts have none."""
    return documents.select("doc_id", "source", "text").mapInArrow(_count_tokens(tokenizer, pattern), "doc_id bigint, source string, tokens bigint")


class Mix:
    """The mix of documents by targets (source, target_share, max_repeats).

    Documents without a source, or of a source without a target, take no part. Sources without documents stay in the
    report. A source named twice in targets is an error; null shares and repeats count as 0. Without any documents all
    shares are null.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, seed: int = 1, tokenizer: str = TOKENIZER):
        spark = documents.sparkSession
        rows = targets.filter("source is not null").select("source", "target_share", "max_repeats").limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES or len({r["source"] for r in rows}) < len(rows):
            raise ValueError("targets must name each source once, and be few")
        self.seed = seed
        part = documents.filter(F.col("source").isin([r["source"] for r in rows]) if rows else F.lit(False))
        self.sizes = materialize(token_counts(part, tokenizer))
        have = {r["source"]: r for r in self.sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}  # a row per target
        total = sum(r["tokens"] for r in have.values())
        self.documents = sum(r["n"] for r in have.values())
        plan = []
        for r in rows:
            share, most = r["target_share"] or 0.0, r["max_repeats"] or 0
            tokens, n = (have[r["source"]]["tokens"], have[r["source"]]["n"]) if r["source"] in have else (0, 0)
            copies = min(float(most), share * total / tokens) if tokens else 0.0
            plan.append((r["source"], share, most, n, tokens, share * total, int(round(copies * PART))))
        self.plan = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, n_docs bigint, tokens bigint, wanted double, parts bigint")

    def copies(self) -> DataFrame:
        """doc_id, source, tokens and copies (1 or more) of the documents in the mix."""
        blocks = max(1, -(-self.documents // BLOCK_DOCS))
        placed = self.sizes.withColumn("b", F.pmod(F.xxhash64("doc_id", F.lit(self.seed)), F.lit(blocks)))
        sums = placed.groupBy("source", "b").agg(F.count(F.lit(1)).alias("n"))
        before = carry_in(sums, ["source"], "b", "n", "sum")
        order = Window.partitionBy("source", "b").orderBy("doc_id")
        rank = F.row_number().over(order) - 1 + F.coalesce("carry", F.lit(0))
        offset = F.pmod(F.xxhash64("source", F.lit(self.seed)), F.lit(PART))
        joined = placed.join(before, ["source", "b"], "left").withColumn("rank", rank).join(F.broadcast(self.plan.select("source", "parts")), "source")
        crossed = F.expr(f"((rank + 1) * parts + o) div {PART} - (rank * parts + o) div {PART}")
        return joined.withColumn("o", offset).withColumn("copies", crossed).filter("copies > 0").select("doc_id", "source", "tokens", "copies")

    def report(self) -> DataFrame:
        """Per source: target and actual share, tokens, copies, and short: the mix has every document as often as max_repeats
        allows, and yet fewer tokens than wanted."""
        got = self.copies().groupBy("source").agg(
            F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies")
        )
        out = self.plan.drop("parts").join(got, "source", "left").fillna(0, ["mixed_tokens", "n_copies", "most_copies"])
        used_up = F.col("mixed_tokens") >= F.col("tokens") * F.col("max_repeats")
        out = out.withColumn("short", used_up & (F.col("mixed_tokens") < F.col("wanted"))).drop("wanted")
        everything = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # a row per target
        return out.withColumn("actual_share", F.col("mixed_tokens") / F.nullif(everything, F.lit(0)))
