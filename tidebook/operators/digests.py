"""Order-sensitive digests of tables: a hash tree over ranges of the order column.

A leaf hashes the rows of ``CHUNK`` units of the order, a node the leaves or nodes of ``FAN`` ranges,
each with its number, up to one root per key. The height is fixed, so equal tables have equal
roots whatever their partitions. Two tables are compared from the root down: only the first
child that differs is opened, so one chunk of rows is read in the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import join_equal
from .selection import written


class Shape(NamedTuple):
    """A tree covers ``chunk * fan ** height`` units of the order column, from 0."""

    chunk: int = 1024
    fan: int = 256
    height: int = 4


def row_text(columns: Sequence[str]) -> Column:
    """One text for the values of a row: length, colon and value of each, a dash for null."""
    text = [F.col(f"`{c}`").cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def _joined(order: Column, text: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), ""), 256)


def row_digests(rows: DataFrame, columns: Sequence[str], by: Sequence[str], order: str = "seq") -> DataFrame:
    """keys, order, digest; rows of the same place count together, in no order."""
    text = rows.select(*by, F.col(order).cast("long").alias("__o"), F.sha2(row_text(columns), 256).alias("__t"))
    return text.groupBy(*by, "__o").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("__t")), ""), 256).alias("digest"))


def leaves(rows: DataFrame, columns: Sequence[str], by: Sequence[str], order: str = "seq", shape: Shape = Shape()) -> DataFrame:
    """keys, node, n, digest of every chunk with rows."""
    own = row_digests(rows, columns, by, order)
    most = shape.chunk * shape.fan**shape.height
    fits = F.when((F.col("__o") >= 0) & (F.col("__o") < most), F.col("__o")).otherwise(F.raise_error(F.lit(f"{order} must lie in 0 to {most}")).cast("long"))
    own = own.withColumn("node", F.floor(fits / shape.chunk))
    return own.groupBy(*by, "node").agg(F.sum("n").alias("n"), _joined(F.col("__o"), F.col("digest")).alias("digest"))


def parents(nodes: DataFrame, by: Sequence[str], shape: Shape = Shape()) -> DataFrame:
    """The next level of ``nodes``."""
    text = F.concat(F.col("node").cast("string"), F.lit(":"), F.col("digest"))
    return nodes.groupBy(*by, F.floor(F.col("node") / shape.fan).alias("up")).agg(F.sum("n").alias("n"), _joined(F.col("node"), text).alias("digest")).withColumnRenamed("up", "node")


def levels(rows: DataFrame, columns: Sequence[str], by: Sequence[str], order: str = "seq", shape: Shape = Shape()) -> list[DataFrame]:
    """Leaves first, roots last; the leaves are written once."""
    found = [written(leaves(rows, columns, by, order, shape))]
    for _ in range(shape.height):
        found.append(parents(found[-1], by, shape))
    return found


def digests(rows: DataFrame, columns: Sequence[str], by: Sequence[str], order: str = "seq", shape: Shape = Shape()) -> DataFrame:
    """keys, n_rows, digest of each key's rows in order."""
    nodes = leaves(rows, columns, by, order, shape)
    for _ in range(shape.height):
        nodes = parents(nodes, by, shape)
    return nodes.select(*by, F.col("n").alias("n_rows"), "digest")


def _unequal(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ``keys`` of rows whose digests differ or which only one side has."""
    left, right = (x.select(*keys, "digest") for x in (a, b))
    both = left.withColumn("__s", F.lit(0)).unionByName(right.withColumn("__s", F.lit(1)))
    return both.groupBy(*keys).agg(F.count("*").alias("__n"), F.count_distinct("digest").alias("__d")).filter("__n = 1 or __d = 2").select(*keys)


def first_difference(a: DataFrame, b: DataFrame, columns: Sequence[str], by: Sequence[str], order: str = "seq", shape: Shape = Shape()) -> DataFrame:
    """keys, and where (in ``order``) their rows in ``a`` and ``b`` differ first; keys that agree have no row."""
    trees = [levels(x, columns, by, order, shape) for x in (a, b)]
    open_ = _unequal(trees[0][-1], trees[1][-1], [*by, "node"])
    for level in range(shape.height - 1, -1, -1):
        up = open_.withColumnRenamed("node", "__up")
        sides = [join_equal(t[level].withColumn("__up", F.floor(F.col("node") / shape.fan)), up, [*by, "__up"], "left_semi") for t in trees]
        open_ = _unequal(*sides, [*by, "node"]).groupBy(*by).agg(F.min("node").alias("node"))
    chunk = [x.withColumn("node", F.floor(F.col(order) / shape.chunk)) for x in (a, b)]
    kept = [row_digests(join_equal(x, open_, [*by, "node"], "left_semi"), columns, by, order) for x in chunk]
    return _unequal(*kept, [*by, "__o"]).groupBy(*by).agg(F.min("__o").alias(order))


def content(rows: DataFrame) -> DataFrame:
    """One row that tells tables apart without regard to order: row count, and two sums over row hashes."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("sum"))
