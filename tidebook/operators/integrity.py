"""Hour-by-hour integrity of captures: file checks, snapshot bridges, sequences, and every reason to reject an hour.

Hours are independent but for their neighbours' last ids, so all sequence checks run in windows of one hour.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scans import CHUNK
from .streams import snapshot_links

#: Names of the reasons, in the order in which they are listed.
REASONS = (
    "at_or_after_cutoff", "missing_depth_file", "missing_trade_file", "depth_decode_error", "trade_decode_error", "no_depth_snapshot", "no_depth_diffs", "no_trade_rows",
    "depth_snapshot_bridge_gap", "depth_sequence_gap", "depth_cross_hour_gap", "trade_sequence_gap", "trade_cross_hour_gap",
)


def _before_error(rows: DataFrame, hour: Sequence[str]) -> DataFrame:
    """Rows up to the first of an hour that can't be decoded, with ``failed``."""
    first_bad = F.min(F.when(F.col("bad"), F.col("seq"))).over(Window.partitionBy(*hour))
    seen = rows.withColumn("__bad", first_bad).withColumn("failed", F.col("__bad").isNotNull())
    return seen.filter(F.col("__bad").isNull() | (F.col("seq") <= F.col("__bad"))).drop("__bad")


def depth_by_hour(depth: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and gaps of each hour's depth rows: keys, hour_ms, seq, event_type (snapshot or diff), first_id, last_id, bad.

    After a snapshot the diffs that it covers are passed over; the first other one must hold the snapshot's next id,
    and each later one starts where the last one ended.
    """
    hour = [*by, "hour_ms"]
    rows = _before_error(depth, hour)
    snap, diff = ~F.col("bad") & (F.col("event_type") == "snapshot"), ~F.col("bad") & (F.col("event_type") == "diff")
    part = F.sum(F.when(snap, 1).otherwise(0)).over(Window.partitionBy(*hour).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    whole, order = Window.partitionBy(*hour, "__part"), Window.partitionBy(*hour, "__part").orderBy("seq")
    rows = rows.withColumn("__part", part).withColumn("__snap", F.max(F.when(snap, F.col("last_id"))).over(whole))
    fresh = diff & (F.col("__snap").isNull() | (F.col("last_id") > F.col("__snap")))
    rows = rows.withColumns({"__first": F.min(F.when(fresh, F.col("seq"))).over(whole), "__prev": F.lag("last_id").over(order)})
    following = F.col("__snap") + 1
    bridged = (F.col("first_id") <= following) & (following <= F.col("last_id"))
    return rows.groupBy(*hour).agg(
        F.count_if(~F.col("bad")).alias("depth_rows"), F.count_if(snap).alias("depth_snapshots"), F.count_if(diff).alias("depth_diffs"), F.max("failed").alias("depth_failed"),
        F.min_by(F.when(diff, F.col("first_id")), F.when(diff, F.col("seq"))).alias("depth_first_id"), F.max_by(F.when(diff, F.col("last_id")), F.when(diff, F.col("seq"))).alias("depth_last_id"),
        F.count_if(diff & (F.col("seq") == F.col("__first")) & F.col("__snap").isNotNull() & ~bridged).alias("bridge_gaps"),
        F.count_if(diff & (F.col("seq") > F.col("__first")) & (F.col("first_id") != F.col("__prev") + 1)).alias("depth_gaps"),
    )


def trades_by_hour(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and gaps of each hour's trades: keys, hour_ms, seq, agg_trade_id, bad."""
    hour = [*by, "hour_ms"]
    rows, good = _before_error(trades, hour), ~F.col("bad")
    gap = F.col("agg_trade_id") != F.lag("agg_trade_id").over(Window.partitionBy(*hour).orderBy("seq")) + 1
    return rows.withColumn("__gap", gap).groupBy(*hour).agg(
        F.count_if(good).alias("trade_rows"), F.max("failed").alias("trade_failed"), F.min_by(F.when(good, F.col("agg_trade_id")), F.when(good, F.col("seq"))).alias("trade_first_id"),
        F.max_by(F.when(good, F.col("agg_trade_id")), F.when(good, F.col("seq"))).alias("trade_last_id"), F.count_if(good & F.coalesce("__gap", F.lit(False))).alias("trade_gaps"),
    )


def rejections(hours: DataFrame, depth: DataFrame, trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per hour of the dense calendar ``hours`` (keys, hour_ms, eligible, depth_exists, trade_exists): counts, reasons and ``valid``."""
    hour = [*by, "hour_ms"]
    rows = hours.join(depth_by_hour(depth, by), hour, "left").join(trades_by_hour(trades, by), hour, "left")
    zero, no = F.lit(0).cast("long"), F.lit(False)
    counts = ("depth_rows", "depth_snapshots", "depth_diffs", "bridge_gaps", "depth_gaps", "trade_rows", "trade_gaps")
    rows = rows.withColumns({**{c: F.coalesce(c, zero) for c in counts}, **{c: F.coalesce(c, no) for c in ("depth_failed", "trade_failed")}})
    w = Window.partitionBy(*by).orderBy("hour_ms")  # one row per hour
    rows = rows.withColumns(
        {
            "depth_cross_gap": F.coalesce(F.col("depth_first_id") != F.lag("depth_last_id").over(w) + 1, no),
            "trade_cross_gap": F.coalesce(F.col("trade_first_id") != F.lag("trade_last_id").over(w) + 1, no),
        }
    )
    depth_read, trade_read = F.col("depth_exists") & ~F.col("depth_failed"), F.col("trade_exists") & ~F.col("trade_failed")
    found = (
        ~F.col("eligible"), ~F.col("depth_exists"), ~F.col("trade_exists"), F.col("depth_failed"), F.col("trade_failed"), depth_read & (F.col("depth_snapshots") == 0),
        depth_read & (F.col("depth_diffs") == 0), trade_read & (F.col("trade_rows") == 0), F.col("bridge_gaps") > 0, F.col("depth_gaps") > 0, F.col("depth_cross_gap"),
        F.col("trade_gaps") > 0, F.col("trade_cross_gap"),
    )
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in zip(REASONS, found)]))
    return rows.withColumn("rejection_reasons", reasons).withColumn("valid", F.size("rejection_reasons") == 0)


def accepted(hours: DataFrame, tolerate: Sequence[str] = ()) -> DataFrame:
    """``hours`` as ``rejections`` gives them, ``valid`` if no reason holds but those that a study tolerates."""
    if unknown := sorted(set(tolerate) - set(REASONS)):
        raise ValueError(f"no such reasons: {', '.join(unknown)}")
    left = F.array_except("rejection_reasons", F.array(*[F.lit(r) for r in tolerate]).cast("array<string>"))
    return hours.withColumn("valid", F.size(left) == 0)


def snapshot_timing(depth: DataFrame, by: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """One row per snapshot: how long until diffs came, bridged its id and reached the policy's boundary.

    ``depth``: keys, seq, recv_ms, request_ms (null in old captures), event_type (snapshot or diff), time_ms,
    first_update_id, last_update_id. Delays count from the request, or the receipt if that is unknown. Diffs that the
    snapshot covers are passed over; the first other one must bridge its id and each later one continue the last.
    The boundary is the first of these that was received after the response (``>=`` if the request time is known, else
    ``>``). What follows the boundary or a break isn't looked at. A snapshot without diffs has null times.
    """
    rows = snapshot_links(depth, by, chunk).filter("snap is not null")
    diff, tag = F.col("event_type") != "snapshot", F.col("snap.tag")
    rows = rows.filter(F.col("seq") <= F.coalesce(F.least("broke", "out.seq"), "seq")).withColumn("__of", F.col("snap.seq"))
    kept = F.col("kept")
    bound = F.when(F.col("broke").isNull() | (F.col("out.seq") < F.col("broke")), F.col("out"))
    found = rows.groupBy(*by, "__of").agg(
        F.first("snap").alias("s"),
        F.min_by("recv_ms", F.when(diff & (F.col("recv_ms") > tag), F.col("seq"))).alias("first_recv_ms"),
        F.min(F.when(kept, F.struct("seq", "time_ms", "recv_ms"))).alias("bridge"),
        F.first(bound).alias("bound"),
        F.coalesce(F.max(F.col("seq") == F.col("broke")), F.lit(False)).alias("broken"),
        F.count_if(kept & F.coalesce(F.col("seq") != F.col("broke"), F.lit(True))).alias("buffered"),
    )
    tag = F.col("s.tag")
    return found.select(
        *by, F.col("s.seq").alias("seq"), (~F.col("s.timed")).alias("legacy_tag"), tag.alias("tag_ms"), (F.col("first_recv_ms") - tag).alias("first_delay_ms"),
        F.col("bridge.time_ms").alias("bridge_ms"), (F.col("bridge.time_ms") - tag).alias("bridge_delay_ms"), F.col("bridge.recv_ms").alias("bridge_recv_ms"),
        (F.col("bridge").isNotNull() & ~F.col("broken")).alias("bridge_valid"), F.col("bound.time_ms").alias("boundary_ms"), F.col("bound.recv_ms").alias("boundary_recv_ms"),
        (F.col("bound.time_ms") - tag).alias("boundary_delay_ms"), F.col("bound").isNotNull().alias("boundary_valid"), "buffered",
    )
