"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 16


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str],
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join rows with one row per key.

    ``small`` is an aggregate with at most one row per key, copied once per salt; the rows
    of a hot key go to ``salts`` partitions. When the aggregate is small, the planner broadcasts
    it and nothing is shuffled; it goes by the size before the copies, often that of packed
    files. A merge hint on ``small`` keeps an aggregate of many short rows off the driver.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")


#: Bits of a number that tell the rows of one block apart.
BLOCK_BITS = 16


def running_totals(df: DataFrame, keys: list[str], index: str, value: Column, name: str,
                   bits: int = BLOCK_BITS) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same key with a smaller ``index``, a
    whole number that is unique within its key.

    A key is cut into blocks by the high bits of the index. Sums run within a block and over
    the totals of the blocks, so with 32-bit numbers no window holds more than 65,536 rows of a
    key, whatever its size. Rows and totals come from one exchange, so ``df`` is worked out
    once if both need the same columns: all of ``df`` should be in ``keys``, ``index`` and ``value``.
    """
    # never null, and with the largest index among the totals, so that rows and totals need the
    # same columns of the same rows
    block = F.coalesce(F.shiftright(F.col(index).cast("bigint"), bits), F.lit(0))
    cut = df.withColumn("_block", block).repartition(*keys, "_block")
    blocks = cut.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"), F.max(index).alias("_last"))
    earlier = _before(Window.partitionBy(*keys).orderBy("_block"))
    starts = blocks.select(*keys, "_block", "_last", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    within = _before(Window.partitionBy(*keys, "_block").orderBy(index))
    placed = cut.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    # always true, but no condition that the optimizer could carry to one side only
    joined = placed.join(starts, [*keys, "_block"]).filter(F.coalesce(F.col(index) <= F.col("_last"), F.lit(True)))
    return joined.withColumn(name, F.col("_start") + F.col("_within")).drop("_block", "_last", "_start", "_within")


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


#: Ranges of the digests that order the rows of a key.
RANK_RANGES = 4096


def spread_ranks(df: DataFrame, keys: list[str], by: list[str], name: str) -> DataFrame:
    """Adds ``name``: the rank of a row (from 1) among those of the same key, in the order of a
    digest of ``by``. The order depends on these values only, not on partitions or other keys.

    Digests spread evenly, so a key is cut into 4,096 ranges of digests: ranks run within a
    range and counts over the ranges. No window holds all rows of a frequent key.
    """
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in by]))
    cut = df.withColumn("_digest", digest).withColumn("_range", _range_of(F.col("_digest")))
    counts = cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = _before(Window.partitionBy(*keys).orderBy("_range"))
    starts = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_range").orderBy("_digest", *by)
    ranked = cut.withColumn("_within", F.row_number().over(within))
    joined = ranked.join(starts, [*keys, "_range"])
    return joined.withColumn(name, F.col("_start") + F.col("_within")).drop("_digest", "_range", "_start", "_within")


def _range_of(digest: Column) -> Column:
    """The first three hexadecimal digits as a number below ``RANK_RANGES``."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")
