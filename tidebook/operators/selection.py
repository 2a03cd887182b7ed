"""Exact quantiles of any number of groups at once, without a buffer of values.

All rows are sorted once by (group, value) over the whole cluster; a range of that order is a
partition, and equal rows are told apart by a number, so no group and no repeated value has to
lie in one task. From one row per (partition, group) it is known where a rank lies, and
only the rows at the ranks asked for are read back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shared_folder
from .scans import join_equal


def written(df: DataFrame) -> DataFrame:
    """``df`` as it stands in the shared folder, so that all later reads agree on it."""
    df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def exact_quantiles(rows: DataFrame, value: str | Column, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, and quantiles: for each of ``probs`` the value at p * (n - 1), linearly between neighbours; nulls don't count."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    order = [*keys, "__v", "__salt"]
    numbered = rows.select(*keys, v.alias("__v"), F.monotonically_increasing_id().alias("__salt")).filter("__v is not null")
    placed = numbered.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.select(*keys, "__v", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    held = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumns({"__before": F.coalesce(F.sum("__n").over(earlier), F.lit(0)), "n": F.sum("__n").over(Window.partitionBy(*keys))})

    def ask(i: int, p: float) -> list[Column]:
        place = F.lit(float(p)) * (F.col("n") - 1)
        return [F.struct(F.lit(i).alias("i"), (rank - place).alias("off"), rank.cast("long").alias("rank")) for rank in (F.floor(place), F.ceil(place))]

    asked = held.withColumn("__q", F.explode(F.array(*[x for i, p in enumerate(probs) for x in ask(i, p)])))
    local = F.col("__q.rank") - F.col("__before")
    found = asked.filter((local >= 0) & (local < F.col("__n"))).select(*keys, "n", "__q.i", "__q.off", (F.col("__first") + local).alias("__at"))
    met = found.join(placed.select("__at", "__v"), "__at")
    # of the two neighbours each weighs by how near the other is; one that is hit exactly comes twice with weight 1/2
    weight = F.when(F.col("off") == 0, 0.5).otherwise(1 - F.abs("off"))
    each = met.groupBy(*keys, "n", "i").agg(F.sum(F.col("__v") * weight).alias("q"))
    return each.groupBy(*keys, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("quantiles"))


def with_quantiles(totals: DataFrame, rows: DataFrame, value: str | Column, named: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """``totals`` (one row per key) with a column for each of ``named``."""
    found = exact_quantiles(rows, value, list(named.values()), keys).drop("n")
    both = join_equal(totals, found, keys, "left") if keys else totals.join(F.broadcast(found), F.lit(True), "left")  # one row each
    return both.withColumns({n: F.get("quantiles", F.lit(i)) for i, n in enumerate(named)}).drop("quantiles")
