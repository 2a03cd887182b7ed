"""Running values of a long stream, in parallel.

A stream is cut into chunks of its order column. Of a chunk only its last known values go to the
later ones: "the last known value, or what came in" is all that a chunk does to such a
state, and these functions compose. So one row per chunk is scanned, in two levels of
``FAN`` chunks each, and every row then needs its own chunk alone. No key has to hold a
whole stream, and no window sorts more than a chunk or ``FAN`` summaries.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Units of the order column in a chunk; chunks per group of the scan.
CHUNK, FAN = 1 << 16, 1024
NUMBER = "__chunk"


def in_chunks(rows: DataFrame, at: str = "seq", width: int = CHUNK) -> DataFrame:
    return rows.withColumn(NUMBER, F.floor(F.col(at) / F.lit(width)))


def chunk_window(by: Sequence[str], order: Sequence[str | Column] = ("seq",)) -> WindowSpec:
    return Window.partitionBy(*by, NUMBER).orderBy(*order)


def join_equal(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join on ``keys`` in which nulls are equal; ``right`` keeps its other columns only."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def _last(values: Sequence[str], order: Column) -> list[Column]:
    return [F.max_by(v, F.when(F.col(v).isNotNull(), order)).alias(v) for v in values]


def before_chunks(rows: DataFrame, values: Sequence[str], by: Sequence[str], order: Sequence[str] = ("seq",), fan: int = FAN) -> DataFrame:
    """One row per key and chunk: the last non-null of each of ``values`` in earlier chunks."""
    own = rows.groupBy(*by, NUMBER).agg(*_last(values, F.struct(*order))).withColumn("__fan", F.floor(F.col(NUMBER) / fan))
    near = Window.partitionBy(*by, "__fan").orderBy(NUMBER).rowsBetween(Window.unboundedPreceding, -1)
    far = Window.partitionBy(*by).orderBy("__fan").rowsBetween(Window.unboundedPreceding, -1)
    fans = own.groupBy(*by, "__fan").agg(*_last(values, F.col(NUMBER)))
    fans = fans.select(*by, "__fan", *[F.last(v, True).over(far).alias(f"__far_{v}") for v in values])
    near_values = own.select(*by, NUMBER, "__fan", *[F.last(v, True).over(near).alias(v) for v in values])
    both = join_equal(near_values, fans, [*by, "__fan"])
    return both.select(*by, NUMBER, *[F.coalesce(v, f"__far_{v}").alias(v) for v in values])


def with_last(
    rows: DataFrame,
    values: Mapping[str, Column],
    by: Sequence[str],
    order: Sequence[str] = ("seq",),
    own_row: bool = False,
    fan: int = FAN,
) -> DataFrame:
    """Adds for each name the last non-null value in the rows before (or up to the row with ``own_row``), over all chunks of the key."""
    named = rows.withColumns(dict(values))
    names = list(values)
    came_in = before_chunks(named, names, by, order, fan).withColumnsRenamed({n: f"__in_{n}" for n in names})
    window = chunk_window(by, order).rowsBetween(Window.unboundedPreceding, 0 if own_row else -1)
    joined = join_equal(named, came_in, [*by, NUMBER])
    return joined.withColumns({n: F.coalesce(F.last(n, True).over(window), f"__in_{n}") for n in names}).drop(*[f"__in_{n}" for n in names])


def over_groups(rows: DataFrame, group: str, least: Mapping[str, Column], by: Sequence[str]) -> DataFrame:
    """Adds the minimum of each of ``least`` over all rows of the key with the same ``group``, which may span many chunks.

    A group has one row per chunk on the way, so a group of any length spreads over its chunks.
    """
    keys = [*by, NUMBER, group]
    parts = rows.groupBy(*keys).agg(*[F.min(c).alias(n) for n, c in least.items()])
    whole = Window.partitionBy(*by, group)
    return join_equal(rows, parts.select(*keys, *[F.min(n).over(whole).alias(n) for n in least]), keys)
