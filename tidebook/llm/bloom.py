"""Blocked Bloom filters made of DataFrame functions only.

The filter is a small table (block, bits): ``bits`` is a 4 KB bitmap and an item
sets ``PROBES`` of the 32,768 bits of one block. A *repeat filter* holds only
the bits that at least two rows set, so a row whose bits are not all in it is
certain to be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32_768
PROBES = 2
#: The largest filter that is broadcast: 2^30 bits, 128 MB.
MAX_BLOCKS = 1 << 15


def n_blocks(n_rows: int, bits_per_row: int = 32) -> int:
    """Blocks for ``n_rows``, at most ``MAX_BLOCKS``; beyond that more rows count as
    possibly repeated, which costs shuffle but no correctness."""
    return max(1, min(MAX_BLOCKS, -(-n_rows * bits_per_row // BLOCK_BITS)))


def _block(item: Column, blocks: int) -> Column:
    return F.pmod(item, F.lit(blocks)).cast("int")


def _probe(item: Column, i: int) -> Column:
    return F.pmod(F.xxhash64(item, F.lit(i)), F.lit(BLOCK_BITS)).cast("int")


def repeat_filter(items: DataFrame, col: str, blocks: int) -> DataFrame:
    """(block, bits) of the bits that two or more rows of ``items`` set in the same probe."""
    bits = items.select(
        _block(F.col(col), blocks).alias("block"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _probe(F.col(col), i).alias("p")) for i in range(PROBES)])).alias("x"),
    )
    twice = bits.groupBy("block", F.col("x.p").alias("pos")).agg(F.count("*").alias("n")).filter("n >= 2")
    return twice.repartition("block").groupBy("block").agg(F.bitmap_construct_agg(F.col("pos").cast("long")).alias("bits"))


def with_maybe_repeated(rows: DataFrame, col: str, blocks: int, bits: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: false means that no other row has this item."""
    keyed = rows.withColumn("__block", _block(F.col(col), blocks))
    joined = keyed.join(
        F.broadcast(bits.select(F.col("block").alias("__block"), F.col("bits").alias("__bits"))), "__block", "left"
    )
    hit = F.col("__bits").isNotNull()
    for i in range(PROBES):
        p = _probe(F.col(col), i)
        byte = F.conv(F.hex(F.col("__bits").substr(F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = hit & (F.getbit(byte, (p % 8).cast("int")) == 1)
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("__block", "__bits")


def member_filter(items: DataFrame, col: str, blocks: int) -> DataFrame:
    """(block, bits) of the bits that any row of ``items`` sets."""
    bits = items.select(
        _block(F.col(col), blocks).alias("block"),
        F.explode(F.array(*[_probe(F.col(col), i) for i in range(PROBES)])).alias("pos"),
    ).distinct()
    return bits.repartition("block").groupBy("block").agg(F.bitmap_construct_agg(F.col("pos").cast("long")).alias("bits"))


def with_maybe_member(rows: DataFrame, col: str, blocks: int, bits: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: false means that the item isn't in the filter."""
    return with_maybe_repeated(rows, col, blocks, bits, name)


def without(rows: DataFrame, key: str, dropped: DataFrame, n_dropped: int) -> DataFrame:
    """Anti join on the long ``key``: only rows that may be in ``dropped`` are shuffled."""
    blocks = n_blocks(n_dropped)
    flagged = with_maybe_member(rows, key, blocks, member_filter(dropped.select(key), key, blocks), "__hit")
    passed = flagged.filter(~F.col("__hit")).drop("__hit")
    tested = flagged.filter("__hit").drop("__hit").join(dropped.select(key), key, "left_anti")
    return passed.unionByName(tested)
