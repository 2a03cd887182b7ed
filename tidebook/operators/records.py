"""What interval estimates and gates take in: records of sessions, windows and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BY = ("session_id",)
SUMS = ("matched_net_pnl", "matched_gross_pnl", "matched_fees", "matched_inventory_pnl", "matched_qty")


def session_records(pnl: DataFrame, lots: DataFrame, fills: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """One row per session: net result, what matched lots and the rest of the inventory made of it, and orders per fill.

    ``pnl``, ``lots`` as ``operators.pnl`` gives them. The residual's result is null where a lot's mids aren't known.
    """
    known = F.count("inventory_pnl") == F.count("*")
    matched = lots.groupBy(*by).agg(
        F.sum("net_pnl").alias("matched_net_pnl"), F.sum(F.col("realized_pnl").cast("double")).alias("matched_gross_pnl"), F.sum("total_fees").alias("matched_fees"),
        F.when(known, F.sum("inventory_pnl")).alias("matched_inventory_pnl"), F.sum("qty").alias("matched_qty"),
    )
    orders = fills.groupBy(*by).agg(F.count_distinct("order_id").alias("orders"), F.count_if("is_maker").alias("maker_fills"))
    rows = pnl.select(*by, F.col("n_fills").alias("fills"), "net_pnl", "inventory_pnl", F.abs("position").alias("abs_residual_inventory"))
    rows = rows.join(orders, list(by), "left").join(matched, list(by), "left")
    # without lots nothing is matched; an unknown result of lots stays unknown
    none = {c: F.when(F.col("matched_qty").isNull(), F.lit(0)).otherwise(F.col(c)) for c in SUMS}
    rows = rows.withColumns(none)
    return rows.withColumns(
        {
            "residual_inventory_pnl": F.col("inventory_pnl") - F.col("matched_inventory_pnl"),
            "orders_per_fill": F.try_divide(F.col("orders").cast("double"), F.col("fills").cast("double")),
        }
    )


def window_records(sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Session records added up per window; a sum with an unknown part is unknown, and residual inventory is its mean."""
    strict = [F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c) for c in ("net_pnl", *SUMS[:3], "matched_qty", "residual_inventory_pnl")]
    rows = sessions.groupBy(*keys).agg(*strict, F.avg("abs_residual_inventory").alias("abs_residual_inventory"), *[F.sum(c).alias(c) for c in ("fills", "maker_fills", "orders")])
    return rows.withColumn("orders_per_fill", F.try_divide(F.col("orders").cast("double"), F.col("fills").cast("double")))


def gate_rows(windows: DataFrame, window: str, provenance: dict[str, object]) -> DataFrame:
    """What a strategy gate reads of each window: its policies and settings, fills, matched and full results."""
    told = [F.lit(None if v is None else str(v)).cast("string").alias(k) for k, v in sorted(provenance.items())]
    return windows.select(
        F.col(window).alias("window"), *told, "fills", "maker_fills", F.col("matched_qty").alias("matched_quantity"), "matched_net_pnl",
        F.col("net_pnl").alias("full_strategy_net_pnl"), F.col("abs_residual_inventory").alias("average_abs_residual_inventory"),
    )


def queue_means(diagnostics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Means over ``queue_diagnostics``: orders, filled ones, their queue at arrival, and what drained all queues."""
    filled = F.col("first_fill_ms").isNotNull()
    return diagnostics.groupBy(*keys).agg(
        F.count("*").alias("orders"), F.count_if(filled).alias("filled_orders"), F.avg(F.when(filled, F.col("queue_at_arrival"))).alias("avg_queue_at_arrival_filled"),
        *[F.sum(f"drained_by_{r}").alias(f"drained_by_{r}") for r in ("trade", "cancellation")],
    )
