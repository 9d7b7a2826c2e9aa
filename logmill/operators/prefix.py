"""Running results over an order that spans the whole table, without one task that holds it all.

Rows are cut into blocks of their order. Each block is summed up, the summaries are scanned in two levels, and each
block gets what precedes it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COMBINE = {"max": (F.max, lambda a, b: F.greatest(a, b)), "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b))}


def carry_in(blocks: DataFrame, by: Sequence[str], block: str, value: str, how: str, fan: int = 4096) -> DataFrame:
    """For each row of blocks (one per by and block) the value combined over all earlier blocks of the same `by`.

    The result has by, block and `carry`, null where nothing precedes. Null values are passed over. how is max or sum.
    The widest task scans one block in `fan`, or `fan` neighbours.
    """
    agg, join2 = COMBINE[how]
    b = blocks.select(*by, F.col(block).alias("_b"), F.expr(f"`{block}` div {fan}L").alias("_s"), F.col(value).alias("_v"))
    tops = b.groupBy(*by, "_s").agg(agg("_v").alias("_t"))
    before = lambda part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*by, "_s", agg("_t").over(before(by or [F.lit(0)], "_s")).alias("_t"))
    near = b.withColumn("_n", agg("_v").over(before([*by, "_s"], "_b")))
    return near.join(tops, [*by, "_s"], "left").select(*by, F.col("_b").alias(block), join2(F.col("_t"), F.col("_n")).alias("carry"))
