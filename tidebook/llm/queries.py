"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, grouped_packing, html_extract, langid, lexical, line_dedup, mixing, near_dedup, packing, prefix_trie, secrets, sharding, topk
from .base import table


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dropped_lines(table(spark, sf_dir, "documents")).drop("h")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, F.array("source"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size")).cast("long").alias("taken"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = secrets.scan(table(spark, sf_dir, "documents"))
    return secrets.digest(findings)


def packed_digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers  # where it is missing, the other queries work

    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_grouped_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = grouped_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packed.drop("ids")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_language_id,
        op2_kd_shards,
        op3_html_text,
        op4_line_dedup,
        op5_near_dedup,
        op6_exact_dedup,
        op7_mix,
        op8_secrets,
        op9_pack,
        op10_top_k,
        op11_grouped_pack,
        op12_lexical_search,
        op13_prefix_trie,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": exact_dedup.ORACLE,
        "op10_top_k": topk.ORACLE,
        "op12_lexical_search": lexical.ORACLE,
        "op13_prefix_trie": prefix_trie.ORACLE,
    }
