"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are the binary digits of n,
the largest first, with as many pieces of ``max_length`` as fit. Each piece is a
sequence of its own, so no sequence crosses documents and none is padded; equal
lengths form a bucket, from which a loader draws batches of one shape.

One narrow pass: nothing is shuffled. Sequence ids are unique, not gapless: they
number the pieces within each input partition.

Defined results: null text counts as empty (it has the end id alone); repeated
rows give repeated pieces under their own sequence ids; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import in_arrow
from .wordbpe import word_bpe

MAX_LENGTH = 2048
END_ID = 1


def piece_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Powers of two, in falling order, that add up to ``n``."""
    whole, rest = divmod(n, max_length)
    return [max_length] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_length: int = MAX_LENGTH,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset, bucket.

    ``vocabulary``: path of the tokenizer file, the same on every executor.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe(vocabulary)
        encode = encoder.encode
        for part in batches:
            texts = [t or "" for t in part.column(1).to_pylist()]
            cols: list[list] = [[], [], [], [], []]
            for doc, ids in zip(part.column(0).to_pylist(), encode(texts)):
                n = len(ids) + 1
                raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                start = 0
                for length in piece_lengths(n, max_length):
                    for col, value in zip(cols, (doc, start, length, raw[4 * start : 4 * (start + length)], n)):
                        col.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
        encoder.forget()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    packed = in_arrow(rows, pieces, "doc_id long, start long, length long, ids binary, doc_tokens long")
    return packed.withColumns(
        {
            "sequence_id": F.monotonically_increasing_id(),
            "offset": F.lit(0).cast("long"),
            "bucket": F.col("length").cast("int"),
        }
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet files, one folder for each length."""
    packed.write.partitionBy("bucket").parquet(path)
