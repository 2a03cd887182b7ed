"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one hashes every text and keeps the filter bits that two rows set. Pass two
tests every row: those that miss are unique and pass straight through, the
others alone are shuffled and grouped by SHA-256 of the normalised text.

Defined results: null text counts as empty; texts that are equal after deleting
``[\\x20\\x09-\\x0D]`` are one group; the row with the most code points, then the
smallest doc_id stays (null ids last); rows that repeat both id and text of the
row that stays are all reported as kept by ``exact_groups``, while
``exact_dedup`` returns exactly one row per group. An empty table gives an empty
result. Columns other than id and text are carried along, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .base import attach_groups, checkpointed, text_or_empty

#: The white space that equality ignores.
WHITE_SPACE = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]


def normalised(text: Column) -> Column:
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), WHITE_SPACE, text)


def _digest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = normalised(text_or_empty(text_col))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.char_length(text_or_empty(text_col)).alias("n"),
        F.unhex(F.sha2(norm, 256)).alias("sha"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = checkpointed(_digest(docs, id_col, text_col).withColumn("h", F.xxhash64("sha")))
    n_rows = keys.count()
    blocks = bloom.n_blocks(n_rows)
    flagged = bloom.with_maybe_repeated(keys, "h", blocks, bloom.repeat_filter(keys, "h", blocks), "maybe")
    alone = flagged.filter(~F.col("maybe")).select(
        "doc_id", "sha", "n", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.col("n").alias("keep_n")
    )
    maybe = flagged.filter("maybe").select("doc_id", "sha", "n")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id")))
    groups = checkpointed(
        maybe.groupBy("sha")
        .agg(best.alias("b"), F.count("*").alias("group_size"))
        .select("sha", F.col("b.doc_id").alias("keep_id"), "group_size", (-F.col("b.n")).alias("keep_n"))
    )
    both = alone.unionByName(attach_groups(maybe, groups, "sha", "group_size", n_rows))
    return both.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns in the given order."""
    cols = docs.columns
    keys = docs.select(F.xxhash64(normalised(text_or_empty(text_col))).alias("h"))
    keys = checkpointed(keys)
    blocks = bloom.n_blocks(keys.count())
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"),
        normalised(text_or_empty(text_col)).alias("norm"),
        F.char_length(text_or_empty(text_col)).alias("n"),
        F.col(id_col).alias("id"),
    ).withColumn("h", F.xxhash64("norm"))
    flagged = bloom.with_maybe_repeated(packed, "h", blocks, bloom.repeat_filter(keys, "h", blocks), "maybe")
    alone = flagged.filter(~F.col("maybe")).select("row")
    stays = (
        flagged.filter("maybe")
        .groupBy(F.sha2("norm", 256).alias("sha"))
        .agg(F.min_by("row", F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("z"), F.col("id"))).alias("row"))
        .select("row")
    )
    return alone.unionByName(stays).select(*[F.col(f"row.`{c}`").alias(c) for c in cols])


ORACLE = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents
)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       doc_id = first_value(doc_id) over w as kept,
       text_sha256
from t
window w as (partition by text_sha256 order by n desc, doc_id)
"""
