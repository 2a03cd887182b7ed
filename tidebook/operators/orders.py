"""Order life cycles from the event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bps, sign
from .asof import asof
from .pnl import rolling_vol_bps
from .signals import with_mid

BY = ("session_id",)


def order_contexts(events: DataFrame, fills: DataFrame, quotes: DataFrame, marks: DataFrame | None, vol_window_ms: int = 60_000, by: Sequence[str] = BY) -> DataFrame:
    """One row per limit order: status, times, distance from mid and volatility when placed, age in the queue, first fill's markout.

    ``marks``: keys, fill_id, markout_bps at one horizon.
    """
    t, what, d = F.col("time_ms"), F.col("event_type"), F.col("detail")

    def first(kind: str, value):
        return F.min_by(F.when(what == kind, value), F.when(what == kind, F.col("seq")))

    o = events.groupBy(*by, "order_id").agg(
        first("placed", d).alias("p"), first("placed", t).alias("placed_ms"), first("queued", t).alias("queued_ms"),
        first("filled", t).alias("t_filled"), first("cancelled", t).alias("t_cancelled"), first("cancelled", d).alias("c"),
        first("invalidated", t).alias("t_invalidated"), first("expired", t).alias("t_expired"),
    ).filter(F.col("p")["type"] == "limit")
    f = fills.groupBy(*by, "order_id").agg(F.min_by("fill_id", "seq").alias("fill_id"))
    o = o.join(f, [*by, "order_id"], "left")
    part = F.col("fill_id").isNotNull()
    status = (
        F.when(F.col("t_filled").isNotNull(), "filled")
        .when(F.col("t_cancelled").isNotNull() & (F.col("c")["reason"] == "post_only_would_cross"), "post_only_rejected")
        .when(F.col("t_cancelled").isNotNull(), F.when(part, "partial_then_cancelled").otherwise("cancelled_unfilled"))
        .when(F.col("t_invalidated").isNotNull(), F.when(part, "partial_then_invalidated").otherwise("gap_invalidated"))
        .when(F.col("t_expired").isNotNull(), F.when(part, "partial_then_expired").otherwise("replay_expired"))
        .otherwise("open")
    )
    end = F.coalesce("t_filled", "t_cancelled", "t_invalidated", "t_expired")
    o = o.select(
        *by, "order_id", F.col("p")["side"].alias("side"), F.col("p")["price"].cast("double").alias("price"), F.col("p")["qty"].cast("double").alias("qty"),
        "placed_ms", "queued_ms", end.alias("terminal_ms"), status.alias("final_status"), F.greatest(F.lit(0).cast("long"), end - F.col("queued_ms")).alias("age"), "fill_id",
    )
    o = o.withColumn("quote_age_ms", F.when(F.col("queued_ms").isNotNull() & F.col("terminal_ms").isNotNull(), F.col("age"))).drop("age")
    o = asof(o, with_mid(quotes), by, ["mid"], at="placed_ms", prefix="placed_")
    o = rolling_vol_bps(o, quotes, vol_window_ms, by, at="placed_ms")
    o = o.withColumn("distance_bps", F.when(F.col("placed_mid") > 0, bps(sign(F.col("side")) * (F.col("placed_mid") - F.col("price")), F.col("placed_mid"))))
    if marks is not None:
        o = o.join(marks.select(*by, "fill_id", "markout_bps"), [*by, "fill_id"], "left")
    return o.withColumn("filled", F.col("fill_id").isNotNull())


def queue_diagnostics(events: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Per order: what drained its queue and why, when it first filled, and how it ended."""
    what, d = F.col("event_type"), F.col("detail")
    drained = d["drained_qty"].cast("double")
    sums = [
        F.coalesce(F.sum(F.when((what == "queue_drain") & (d["reason"] == r), drained)), F.lit(0.0)).alias(f"drained_by_{r}")
        for r in ("trade", "cancellation", "own_order_cancel")
    ]
    filled = what.isin("filled", "partial_fill")
    ends = what.isin("filled", "cancelled", "invalidated", "expired")
    return events.groupBy(*by, "order_id").agg(
        F.min_by(F.when(what == "queued", d["queue_ahead"].cast("double")), F.when(what == "queued", F.col("seq"))).alias("queue_at_arrival"), *sums,
        F.min(F.when(filled, F.col("time_ms"))).alias("first_fill_ms"), F.max_by(F.when(ends, what), F.when(ends, F.col("seq"))).alias("final_status"),
    )


def activation_summary(events: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """How orders ended up: counts by event and reason."""
    return events.groupBy(*by, "event_type", F.coalesce(F.col("detail")["reason"], F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def open_loop_fills(orders: DataFrame, trades: DataFrame, by: Sequence[str] = BY, bucket_qty: int = 256) -> DataFrame:
    """Maker fills of single orders without cancel credit: the overlap of the volume traded at the price since
    arrival with [queue, queue + qty). ``orders``: keys, order_id, side, price, qty, arrival_ms, queue.

    Each trade covers an interval of the running volume at its price, and an order waits for the interval that begins
    ``queue`` units after what was traded up to its arrival. Intervals meet in shared buckets of ``bucket_qty``
    units, so that an order meets the few trades around its fills, not all that come after it.
    """
    from pyspark.sql import Window

    line = [*by, "side", "price"]
    t = trades.withColumn("side", F.when(F.col("is_buyer_maker"), "buy").otherwise("sell")).filter("qty > 0")
    t = t.select(*line, F.col("time_ms").alias("t_ms"), F.col("seq").alias("t_seq"), F.col("qty").alias("t_qty"))
    w = Window.partitionBy(*line).orderBy("t_ms", "t_seq").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("hi", F.sum("t_qty").over(w)).withColumn("lo", F.col("hi") - F.col("t_qty"))
    # an interval that goes on beyond all trades is not cut into more buckets than these
    o = asof(orders, t, line, ["hi"], at="arrival_ms", quote_time="t_ms", quote_seq="t_seq", prefix="__").join(t.groupBy(*line).agg(F.max("hi").alias("__all")), line)
    o = o.withColumn("__lo", F.coalesce("__hi", F.lit(0)) + F.greatest("queue", F.lit(0)))
    o = o.withColumn("__hi", F.least(F.coalesce("__hi", F.lit(0)) + F.col("queue") + F.col("qty"), F.col("__all")))

    def cut(rows: DataFrame, lo: str, hi: str) -> DataFrame:
        span = F.sequence(F.floor(F.col(lo) / bucket_qty), F.greatest(F.floor(F.col(lo) / bucket_qty), F.ceil(F.col(hi) / bucket_qty) - 1))
        return rows.filter(F.col(lo) < F.col(hi)).withColumn("__bucket", F.explode(span))

    met = cut(o.select(*line, "order_id", "__lo", "__hi"), "__lo", "__hi").join(cut(t, "lo", "hi"), [*line, "__bucket"])
    start = F.greatest("lo", "__lo")
    got = met.filter(F.col("__bucket") == F.floor(start / bucket_qty)).withColumn("fill_qty", F.least("hi", "__hi") - start)  # each overlap once
    return got.filter("fill_qty > 0").select(*by, "order_id", F.col("t_ms").alias("time_ms"), "price", "fill_qty")
