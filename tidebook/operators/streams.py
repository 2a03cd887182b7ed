"""Validation of ordered streams: gaps, snapshot bridging, censoring, integrity.

Whatever depends on earlier rows is a running value by chunks (``scans``), so one stream without any key is as parallel as many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import CHUNK, NUMBER, in_chunks, over_groups, with_last

BY = ("session_id",)
HOUR_MS = 3_600_000


def _continues(rows: DataFrame, first: str, last: str, by: Sequence[str], order: Sequence[str], chunk: int) -> DataFrame:
    """``has_gap``: ``first`` isn't the last known ``last`` plus one. The first row is never a gap."""
    known = with_last(in_chunks(rows, order[0], chunk), {"__last": F.col(last)}, by, order)
    return known.withColumn("has_gap", F.coalesce(F.col(first) != F.col("__last") + 1, F.lit(False))).drop("__last", NUMBER)


def trade_gaps(trades: DataFrame, by: Sequence[str] = BY, order: Sequence[str] = ("seq",), chunk: int = CHUNK) -> DataFrame:
    """``has_gap``: the trade id isn't the last one plus one."""
    return _continues(trades, "agg_trade_id", "agg_trade_id", by, order, chunk)


def depth_gaps(diffs: DataFrame, by: Sequence[str] = BY, order: Sequence[str] = ("seq",), chunk: int = CHUNK) -> DataFrame:
    """``has_gap``: a diff's first id isn't the last diff's final id plus one."""
    return _continues(diffs, "first_update_id", "last_update_id", by, order, chunk)


def monotone_violations(rows: DataFrame, time: str = "time_ms", by: Sequence[str] = BY, order: Sequence[str] = ("seq",), chunk: int = CHUNK) -> DataFrame:
    """Rows whose time is before their predecessor's."""
    known = with_last(in_chunks(rows, order[0], chunk), {"before_ms": F.col(time)}, by, order)
    return known.filter(F.col(time) < F.col("before_ms")).drop(NUMBER)


def require_monotone(rows: DataFrame, time: str = "time_ms", by: Sequence[str] = BY, order: Sequence[str] = ("seq",), chunk: int = CHUNK) -> DataFrame:
    """``rows``, failing at run time at the first time that goes back."""
    known = with_last(in_chunks(rows, order[0], chunk), {"__before": F.col(time)}, by, order)
    ok = F.coalesce(F.col(time) >= F.col("__before"), F.lit(True))
    checked = known.withColumn("__ok", F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(f"{time} is not monotone")).cast("boolean")))
    return checked.filter("__ok").select(*rows.columns)


def merge_events(depth: DataFrame, trades: DataFrame) -> DataFrame:
    """One stream of both kinds; order by (time_ms, kind, seq) puts depth before trades of the same time."""
    return depth.withColumn("kind", F.lit(0)).unionByName(trades.withColumn("kind", F.lit(1)), allowMissingColumns=True)


def position_in(rows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("time_ms", "kind", "seq")
    return rows.withColumn("event_no", F.row_number().over(w))


def snapshot_links(depth: DataFrame, by: Sequence[str] = BY, chunk: int = CHUNK) -> DataFrame:
    """Each row of a recorded depth stream with its snapshot's state machine: what is pending, and where that ends.

    Adds snap (the last snapshot up to the row: seq, id, cutoff, tag, timed), kept (a diff that the snapshot doesn't
    cover), linked (of kept ones: it bridges the snapshot's id, or continues the last kept one), before_id (the last
    row's final id), and of the whole stretch up to the next snapshot broke (first kept diff that isn't linked)
    and out (first kept diff received after the response: seq, time_ms, recv_ms).
    """
    is_snap = F.col("event_type") == "snapshot"
    state = F.struct(
        "seq",
        F.col("last_update_id").alias("id"),
        F.col("recv_ms").alias("cutoff"),
        F.coalesce("request_ms", "recv_ms").alias("tag"),
        F.col("request_ms").isNotNull().alias("timed"),
    )
    rows = with_last(in_chunks(depth, "seq", chunk), {"snap": F.when(is_snap, state)}, by, own_row=True)
    rows = rows.withColumn("kept", ~is_snap & (F.col("snap").isNull() | (F.col("last_update_id") > F.col("snap.id"))))
    last_kept = F.when(F.col("kept"), F.struct(F.col("snap.seq").alias("of"), F.col("last_update_id").alias("id")))
    rows = with_last(rows, {"__kept": last_kept, "before_id": F.col("last_update_id")}, by)
    previous = F.when(F.col("__kept.of").eqNullSafe(F.col("snap.seq")), F.col("__kept.id"))
    continues = F.col("first_update_id") == previous + 1
    bridges = (F.col("first_update_id") <= F.col("snap.id") + 1) & (F.col("snap.id") + 1 <= F.col("last_update_id"))
    linked = F.when(previous.isNotNull(), continues).otherwise(F.col("snap").isNull() | bridges)
    rows = rows.withColumn("linked", F.when(F.col("kept"), linked)).withColumn("__of", F.col("snap.seq"))
    after = F.when(F.col("snap.timed"), F.col("recv_ms") >= F.col("snap.cutoff")).otherwise(F.col("recv_ms") > F.col("snap.cutoff"))
    ends = {"broke": F.when(~F.col("linked"), F.col("seq")), "out": F.when(F.col("kept") & after, F.struct("seq", "time_ms", "recv_ms"))}
    return over_groups(rows, "__of", ends, by).drop("__kept", "__of", NUMBER)


def bridge_snapshots(depth: DataFrame, by: Sequence[str] = BY, chunk: int = CHUNK) -> DataFrame:
    """What a recorded depth stream gives to a replay, in recorded order.

    ``depth``: keys, seq, recv_ms, request_ms (null in old captures), event_type
    (snapshot or diff), time_ms (null for snapshots), first_update_id, last_update_id,
    and any payload. After a snapshot, diffs that it covers are dropped; the first one
    kept must bridge its id, later ones must be contiguous, and all wait for the first that
    was received after the response (``>=`` if the request time is known, else ``>``).
    That boundary's time then holds for the snapshot and the diffs before it, and only
    the boundary itself reaches the strategy. A failed bridge discards the snapshot:
    of its waiting rows only the failing diff remains, marked as a gap. A resync row at the
    request time marks where the old book ends. Past the pending state every diff counts, with plain contiguity.

    Columns added: has_gap, dispatch, sub (0 resync, 1 else); rows that never reach the replay are left out.
    """
    rows = snapshot_links(depth, by, chunk)
    is_snap = F.col("event_type") == "snapshot"
    has, out, broke = F.col("snap").isNotNull(), F.col("out.seq"), F.col("broke")
    released = out.isNotNull() & (broke.isNull() | (out < broke))
    rows = rows.withColumn("__released", F.coalesce(released, F.lit(False)))
    end = F.when(F.col("__released"), out).otherwise(broke)
    rows = rows.withColumn("__waits", has & (end.isNull() | (F.col("seq") <= end)))
    waits, free = F.col("__waits"), F.col("__released")
    goes = (
        F.when(~has, ~is_snap)
        .when(is_snap, free)
        .when(waits, F.col("kept") & (free | F.coalesce(F.col("seq") == broke, F.lit(False))))
        .otherwise(F.lit(True))
    )
    plain = F.coalesce(F.col("first_update_id") != F.col("before_id") + 1, F.lit(False))
    gap = F.when(is_snap, F.lit(False)).when(has & ~waits, plain).otherwise(F.coalesce(~F.col("linked"), F.lit(False)))
    time = F.when(waits & free, F.col("out.time_ms")).otherwise(F.col("time_ms"))
    dispatch = F.when(is_snap, F.lit(False)).when(waits & free, F.col("seq") == out).otherwise(F.lit(True))
    names = [c for c in depth.columns if c != "time_ms"]
    body = rows.filter(goes).select(*names, time.alias("time_ms"), gap.alias("has_gap"), dispatch.alias("dispatch"), F.lit(1).alias("sub"))
    resync = depth.filter(is_snap).withColumns(
        {
            "event_type": F.lit("resync"),
            "time_ms": F.coalesce("request_ms", "recv_ms"),
            "has_gap": F.lit(False),
            "dispatch": F.lit(False),
            "sub": F.lit(0),
        }
    )
    return body.unionByName(resync.select(*body.columns))


def gap_state(events: DataFrame, by: Sequence[str] = BY, trade_gaps_pause: bool = True, chunk_ms: int = HOUR_MS) -> DataFrame:
    """Adds ``censored`` (its whole millisecond is tainted by a gap) and ``in_gap`` (not applied).

    ``events``: keys, time_ms, kind (0 depth, 1 trade), seq, event_type, has_gap. A replay starts in
    a gap, enters one at a resync, a gap or a tainted millisecond, and leaves it at a snapshot.
    """
    reports = F.col("has_gap") & ((F.col("kind") == 0) | F.lit(trade_gaps_pause))
    rows = in_chunks(events, "time_ms", chunk_ms)  # a millisecond lies in one chunk
    ms = Window.partitionBy(*by, NUMBER, "time_ms")
    rows = rows.withColumn("censored", F.max(F.when(reports, 1).otherwise(0)).over(ms) == 1)
    mark = (
        F.when(F.col("censored"), F.lit(True))
        .when(F.col("event_type") == "resync", F.lit(True))
        .when(F.col("event_type") == "snapshot", F.lit(False))
    )
    rows = with_last(rows, {"in_gap": mark}, by, ("time_ms", "kind", "seq"), own_row=True)
    return rows.withColumn("in_gap", F.coalesce("in_gap", F.lit(True))).drop(NUMBER)


def replay_counters(rows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Counts of a replay's events per key; ``rows`` as ``gap_state`` gives them."""
    kind = F.col("event_type")
    return rows.groupBy(*by).agg(
        F.count("*").alias("total_events"),
        F.count_if(kind == "resync").alias("snapshot_resyncs"),
        F.count_if(kind == "snapshot").alias("snapshots"),
        F.count_if(kind == "diff").alias("depth_diffs"),
        F.count_if(F.col("kind") == 1).alias("trade_events"),
        F.count_if(F.col("has_gap")).alias("gaps_detected"),
        F.count_if(F.col("has_gap") & (F.col("kind") == 0)).alias("depth_gaps_detected"),
        F.count_if(F.col("has_gap") & (F.col("kind") == 1)).alias("trade_gaps_detected"),
        F.count_if(F.col("censored") | (F.col("in_gap") & kind.isin("diff", "trade"))).alias("events_during_gap"),
    )


def hour_calendar(rows: DataFrame, by: Sequence[str] = BY, time: str = "time_ms") -> DataFrame:
    """Every hour from a key's first to its last, as milliseconds."""
    hour = F.lit(HOUR_MS)
    ends = rows.groupBy(*by).agg(F.min(F.floor(F.col(time) / hour)).alias("lo"), F.max(F.floor(F.col(time) / hour)).alias("hi"))
    return ends.select(*by, F.explode(F.sequence("lo", "hi")).alias("h")).select(*by, (F.col("h") * hour).cast("long").alias("hour_ms"))


def hour_integrity(depth: DataFrame, trades: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """A row per hour of the dense calendar: counts, gaps, first and last ids, gaps across hours, and reasons to reject it."""
    hour = (F.floor(F.col("time_ms") / F.lit(HOUR_MS)) * HOUR_MS).cast("long")
    d = depth_gaps(depth, by).withColumn("hour_ms", hour).groupBy(*by, "hour_ms").agg(
        F.count("*").alias("n_depth"), F.count_if("has_gap").alias("depth_gaps"),
        F.min_by("first_update_id", "seq").alias("first_id"), F.max_by("last_update_id", "seq").alias("last_id"),
    )
    t = trade_gaps(trades, by).withColumn("hour_ms", hour).groupBy(*by, "hour_ms").agg(F.count("*").alias("n_trades"), F.count_if("has_gap").alias("trade_gaps"))
    rows = hour_calendar(depth, by).join(d, [*by, "hour_ms"], "left").join(t, [*by, "hour_ms"], "left")
    w = Window.partitionBy(*by).orderBy("hour_ms")
    cross = F.coalesce(F.col("first_id") != F.lag("last_id").over(w) + 1, F.lit(False))
    rows = rows.withColumns({"cross_gap": cross, **{c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_depth", "depth_gaps", "n_trades", "trade_gaps")}})
    rules = {
        "no_depth": F.col("n_depth") == 0,
        "no_trades": F.col("n_trades") == 0,
        "depth_gap": F.col("depth_gaps") > 0,
        "trade_gap": F.col("trade_gaps") > 0,
        "cross_hour_gap": F.col("cross_gap"),
    }
    reasons = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("rejection_reasons", reasons).withColumn("valid", F.size("rejection_reasons") == 0)


def candidate_starts(hours: DataFrame, length: int, by: Sequence[str] = BY) -> DataFrame:
    """Hours from which ``length`` hours in a row are valid. ``hours``: keys, hour_ms, valid."""
    w = Window.partitionBy(*by).orderBy("hour_ms").rangeBetween(0, (length - 1) * 3_600_000)
    return hours.filter("valid").withColumn("__n", F.count("*").over(w)).filter(F.col("__n") == length).select(*by, "hour_ms")


def timing_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    v = F.col(value)
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.median(v).alias("median"), F.avg(v).alias("mean"),
        F.percentile(v, 0.9).alias("p90"), F.percentile(v, 0.95).alias("p95"), F.max(v).alias("max"),
    )


def same_ms_overlap(depth: DataFrame, trades: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Milliseconds that have both depth and trades, and how many rows of each fall in them."""
    d = depth.groupBy(*by, "time_ms").agg(F.count("*").alias("nd"))
    t = trades.groupBy(*by, "time_ms").agg(F.count("*").alias("nt"))
    both = d.join(t, [*by, "time_ms"], "full")
    shared = F.col("nd").isNotNull() & F.col("nt").isNotNull()
    return both.groupBy(*by).agg(
        F.count_if(shared).alias("shared_ms"), F.coalesce(F.sum(F.when(shared, F.col("nd"))), F.lit(0)).alias("depth_in_shared"),
        F.coalesce(F.sum(F.when(shared, F.col("nt"))), F.lit(0)).alias("trades_in_shared"), F.count_if(F.col("nd").isNotNull()).alias("depth_ms"),
        F.count_if(F.col("nt").isNotNull()).alias("trade_ms"),
    )


def exposed_to(rows: DataFrame, spans: DataFrame, at: str, bucket_ms: int, by: Sequence[str] = BY) -> DataFrame:
    """Rows whose ``at`` lies in any span [lo_ms, hi_ms) of their key: spans are cut into buckets and equi-joined."""
    cut = spans.select(*by, "lo_ms", "hi_ms", F.explode(F.sequence(F.floor(F.col("lo_ms") / bucket_ms), F.floor(F.col("hi_ms") / bucket_ms))).alias("__b"))
    keyed = rows.withColumn("__b", F.floor(F.col(at) / bucket_ms))
    on = [keyed[k] == cut[k] for k in (*by, "__b")] + [keyed[at] >= cut["lo_ms"], keyed[at] < cut["hi_ms"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return keyed.join(cut, cond, "left_semi").drop("__b")
