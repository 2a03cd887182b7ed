"""Queries: all reasons to reject an hour, and operators that no other query calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import view
from ..functions.scalar import fixed8, round_ask, round_bid
from ..operators import bars as A
from ..operators import gates as G
from ..operators import integrity as I
from ..operators import streams as S
from ..registry import query
from .streams_q import HOUR, _depth, _events

#: Snapshots every 97th event, of which some cover the next two diffs and some lag behind; every 1013th row can't be decoded.
RECORDS = f"""
rec as (select time_ms // {HOUR} * {HOUR} as hour_ms, seq, case when seq % 97 = 0 then 'snapshot' else 'diff' end as event_type, first_update_id as first_id,
        last_update_id + case when seq % 485 = 0 then -30 when seq % 194 = 0 then 25 when seq % 97 = 0 then 5 else 0 end as last_id, seq % 1013 = 0 as bad from diffs),
trd as (select time_ms // {HOUR} * {HOUR} as hour_ms, seq, agg_trade_id, seq % 499 = 0 as bad from trades),
cal as (select unnest(range(min(hour_ms), max(hour_ms) + 3 * {HOUR}, {HOUR}))::bigint as hour_ms from rec),
hrs as (select hour_ms, hour_ms < max(hour_ms) over () - {HOUR} as eligible, (hour_ms // {HOUR}) % 11 <> 0 as depth_exists, (hour_ms // {HOUR}) % 13 <> 0 as trade_exists from cal),
d0 as (select rec.*, min(case when bad then seq end) over (partition by hour_ms) as bad_seq from rec join hrs using (hour_ms) where depth_exists),
d1 as (select *, sum(case when event_type = 'snapshot' and not bad then 1 else 0 end) over (partition by hour_ms order by seq) as part from d0 where bad_seq is null or seq <= bad_seq),
d2 as (select *, max(case when event_type = 'snapshot' and not bad then last_id end) over (partition by hour_ms, part) as snap, lag(last_id) over (partition by hour_ms, part order by seq) as prev,
       event_type = 'diff' and not bad as diff from d1),
d3 as (select *, min(case when diff and (snap is null or last_id > snap) then seq end) over (partition by hour_ms, part) as head from d2),
dh as (select hour_ms, count_if(not bad)::bigint as depth_rows, count_if(event_type = 'snapshot' and not bad)::bigint as depth_snapshots, count_if(diff)::bigint as depth_diffs, bool_or(bad_seq is not null) as depth_failed,
       arg_min(first_id, seq) filter (diff) as first_id, arg_max(last_id, seq) filter (diff) as last_id,
       count_if(diff and seq = head and snap is not null and not (first_id <= snap + 1 and snap + 1 <= last_id))::bigint as bridge_gaps, count_if(diff and seq > head and first_id <> prev + 1)::bigint as depth_gaps from d3 group by 1),
t0 as (select trd.*, min(case when bad then seq end) over (partition by hour_ms) as bad_seq from trd join hrs using (hour_ms) where trade_exists),
t1 as (select *, agg_trade_id <> lag(agg_trade_id) over (partition by hour_ms order by seq) + 1 as gap from t0 where bad_seq is null or seq <= bad_seq),
th as (select hour_ms, count_if(not bad)::bigint as trade_rows, bool_or(bad_seq is not null) as trade_failed, arg_min(agg_trade_id, seq) filter (not bad) as t_first, arg_max(agg_trade_id, seq) filter (not bad) as t_last,
       count_if(gap and not bad)::bigint as trade_gaps from t1 group by 1),
al as (select hrs.*, coalesce(depth_rows, 0) as depth_rows, coalesce(depth_snapshots, 0) as depth_snapshots, coalesce(depth_diffs, 0) as depth_diffs, coalesce(depth_failed, false) as depth_failed,
       coalesce(bridge_gaps, 0) as bridge_gaps, coalesce(depth_gaps, 0) as depth_gaps, coalesce(trade_rows, 0) as trade_rows, coalesce(trade_failed, false) as trade_failed, coalesce(trade_gaps, 0) as trade_gaps,
       coalesce(first_id <> lag(last_id) over (order by hour_ms) + 1, false) as depth_cross_gap, coalesce(t_first <> lag(t_last) over (order by hour_ms) + 1, false) as trade_cross_gap
       from hrs left join dh using (hour_ms) left join th using (hour_ms)),
rj as (select *, array_to_string(list_filter([case when not eligible then 'at_or_after_cutoff' end, case when not depth_exists then 'missing_depth_file' end, case when not trade_exists then 'missing_trade_file' end,
       case when depth_failed then 'depth_decode_error' end, case when trade_failed then 'trade_decode_error' end, case when depth_exists and not depth_failed and depth_snapshots = 0 then 'no_depth_snapshot' end,
       case when depth_exists and not depth_failed and depth_diffs = 0 then 'no_depth_diffs' end, case when trade_exists and not trade_failed and trade_rows = 0 then 'no_trade_rows' end,
       case when bridge_gaps > 0 then 'depth_snapshot_bridge_gap' end, case when depth_gaps > 0 then 'depth_sequence_gap' end, case when depth_cross_gap then 'depth_cross_hour_gap' end,
       case when trade_gaps > 0 then 'trade_sequence_gap' end, case when trade_cross_gap then 'trade_cross_hour_gap' end], lambda x: x is not null), ',') as reasons from al)"""
COUNTS = ("depth_rows", "depth_snapshots", "depth_diffs", "bridge_gaps", "depth_gaps", "depth_cross_gap", "trade_rows", "trade_gaps", "trade_cross_gap")


def _rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.expr(f"time_ms div {HOUR} * {HOUR}")
    seq, one = F.col("seq"), F.lit(0).alias("stream")
    snap = seq % 97 == 0
    moved = F.when(seq % 485 == 0, -30).when(seq % 194 == 0, 25).when(snap, 5).otherwise(0)
    depth = view(spark, sf_dir, "diffs").select(
        one, hour.alias("hour_ms"), "seq", F.when(snap, "snapshot").otherwise("diff").alias("event_type"), F.col("first_update_id").alias("first_id"),
        (F.col("last_update_id") + moved).alias("last_id"), (seq % 1013 == 0).alias("bad"),
    )
    trades = view(spark, sf_dir, "trades").select(one, hour.alias("hour_ms"), "seq", "agg_trade_id", (seq % 499 == 0).alias("bad"))
    ends = depth.groupBy("stream").agg(F.min("hour_ms").alias("lo"), F.max("hour_ms").alias("hi"))
    hours = ends.select("stream", "hi", F.explode(F.sequence("lo", F.col("hi") + 2 * HOUR, F.lit(HOUR).cast("long"))).alias("hour_ms"))
    no = F.expr(f"hour_ms div {HOUR}")
    hours = hours.select("stream", "hour_ms", (F.col("hour_ms") < F.col("hi") + HOUR).alias("eligible"), (no % 11 != 0).alias("depth_exists"), (no % 13 != 0).alias("trade_exists"))
    has_depth, has_trades = (hours.filter(c).select("stream", "hour_ms") for c in ("depth_exists", "trade_exists"))
    key = ["stream", "hour_ms"]
    return I.rejections(hours, depth.join(has_depth, key, "left_semi"), trades.join(has_trades, key, "left_semi"), ("stream",))


@query(f"with {RECORDS} select hour_ms, {', '.join(COUNTS)}, reasons, reasons = '' as valid from rj")
def b15_b17_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _rejections(spark, sf_dir).withColumn("reasons", F.array_join("rejection_reasons", ","))
    return got.select("hour_ms", *COUNTS, "reasons", "valid")


@query(f"""with {RECORDS}, x as (select unnest(string_split(reasons, ',')) as reason from rj where reasons <> '') select reason, count(*) as n_hours from x group by 1""")
def b17_rejection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rejections(spark, sf_dir).select(F.explode("rejection_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n_hours"))


#: What a study of depth between snapshots may tolerate; the other eight reasons hold.
TOLERATED = ("no_depth_snapshot", "depth_sequence_gap", "no_trade_rows", "trade_sequence_gap", "trade_cross_hour_gap")


@query(f"""with {RECORDS}, ok as (select hour_ms from rj where len(list_filter(string_split(reasons, ','), lambda r: r <> '' and r not in {TOLERATED})) = 0),
c as (select hour_ms, count(*) over (order by hour_ms range between current row and {2 * HOUR} following) as n from ok) select hour_ms from c where n = 3""")
def b19_accepted_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that begin three accepted hours in a row, by all thirteen reasons but the tolerated ones."""
    hours = I.accepted(_rejections(spark, sf_dir), TOLERATED)
    return S.candidate_starts(hours.select("stream", "hour_ms", "valid"), 3, by=("stream",)).select("hour_ms")


@query("""with r as (select seq, seq % 97 = 0 as snap, time_ms as recv_ms, case when seq % 97 = 0 and seq % 2 = 0 then time_ms - 5 end as request_ms, case when seq % 97 <> 0 then time_ms end as time_ms,
        first_update_id - case when seq % 97 = 1 then 10 else 0 end as f, last_update_id + case when seq % 97 = 0 then 20 else 0 end as l from diffs),
g as (select *, sum(snap::int) over (order by seq) as seg from r),
h as (select seg, seq as snap_seq, l as id, recv_ms as cutoff, coalesce(request_ms, recv_ms) as tag, request_ms is null as legacy from g where snap),
d as (select h.*, g.seq, g.recv_ms, g.time_ms, f, l, l > id as kept from g join h using (seg) where not snap),
k as (select *, lag(l) over (partition by seg order by seq) as prev from d where kept),
k2 as (select *, case when prev is null then f <= id + 1 and id + 1 <= l else f = prev + 1 end as linked from k),
e as (select seg, min(seq) filter (not linked) as broke, min(seq) filter (linked and case when legacy then recv_ms > cutoff else recv_ms >= cutoff end) as bound from k2 group by 1),
z as (select h.*, broke is not null and (bound is null or broke < bound) as broken, bound is not null and (broke is null or bound < broke) as done, least(broke, bound) as stop from h left join e using (seg)),
a as (select seg, arg_min(d.recv_ms, d.seq) filter (d.recv_ms > d.tag) as first_recv from d join z using (seg) where z.stop is null or d.seq <= z.stop group by 1),
b as (select seg, arg_min(k2.time_ms, k2.seq) as bms, arg_min(k2.recv_ms, k2.seq) as brecv, count(*) as n, arg_max(k2.time_ms, k2.seq) as pms, arg_max(k2.recv_ms, k2.seq) as precv from k2 join z using (seg) where z.stop is null or k2.seq <= z.stop group by 1)
select snap_seq as seq, legacy as legacy_tag, tag as tag_ms, first_recv - tag as first_delay_ms, bms as bridge_ms, bms - tag as bridge_delay_ms, brecv as bridge_recv_ms, n is not null and not broken as bridge_valid,
case when done then pms end as boundary_ms, case when done then precv end as boundary_recv_ms, case when done then pms - tag end as boundary_delay_ms, done as boundary_valid,
(coalesce(n, 0) - broken::int)::bigint as buffered from z left join a using (seg) left join b using (seg)""")
def b20_snapshot_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.snapshot_timing(_depth(spark, sf_dir))


@query("""with ev as (select session_id, time_ms, seq, 0 as kind, case when seq % 41 = 0 then 'snapshot' when seq % 89 = 0 then 'resync' else 'diff' end as event_type from diffs),
ev2 as (select *, seq % 50 = 0 and event_type = 'diff' as has_gap from ev union all select session_id, time_ms, seq, 1, 'trade', seq % 200 = 0 from trades),
ev3 as (select *, max(case when has_gap and kind = 0 then 1 else 0 end) over (partition by session_id, time_ms) = 1 as censored from ev2),
ev4 as (select *, coalesce(last_value(case when censored then true when event_type = 'resync' then true when event_type = 'snapshot' then false end ignore nulls)
        over (partition by session_id order by time_ms, kind, seq rows unbounded preceding), true) as in_gap from ev3)
select session_id, seq, kind, censored, in_gap from ev4""")
def b13_gap_state_without_trade_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy that ignores gaps of trades: only depth gaps pause a replay."""
    return S.gap_state(_events(spark, sf_dir), trade_gaps_pause=False).select("session_id", "seq", "kind", "censored", "in_gap")


@query("""select seq, floor(bid / 25.0) * 25.0 as bid_25, ceil(ask / 25.0) * 25.0 as ask_25 from quotes""")
def e13_rounded_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = view(spark, sf_dir, "quotes")
    return q.select("seq", round_bid(F.col("bid").cast("double"), 25.0).alias("bid_25"), round_ask(F.col("ask").cast("double"), 25.0).alias("ask_25"))


@query(r"""with x as (select seq, case seq % 4 when 0 then price || '.' || lpad(qty::varchar, 8, '0') when 1 then price || '.' || qty when 2 then '-' || price || '.00000000' else '999999999999' || price || '.00000000' end as t from trades)
select seq, case when regexp_full_match(t, '[0-9]+\.[0-9]{8}') then try_cast(replace(t, '.', '') as bigint) end as scaled from x""")
def c13_fixed8(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q, k = F.col("price").cast("string"), F.col("qty").cast("string"), F.col("seq") % 4
    text = F.when(k == 0, F.concat(p, F.lit("."), F.lpad(q, 8, "0"))).when(k == 1, F.concat(p, F.lit("."), q)).when(k == 2, F.concat(F.lit("-"), p, F.lit(".00000000")))
    return view(spark, sf_dir, "trades").select("seq", fixed8(text.otherwise(F.concat(F.lit("999999999999"), p, F.lit(".00000000")))).alias("scaled"))


@query("""select day, (high + low) / 2 as mid, high - low as bar_range, close > open as is_bullish from bars""")
def e20_bar_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_shape(view(spark, sf_dir, "bars")).select("day", "mid", "bar_range", "is_bullish")


@query("""with r as (select day, close / lag(close) over (order by day) - 1 as ret from bars),
v as (select day, case when count(ret) over w = 168 then stddev_samp(ret) over w * sqrt(8760) * 100 end as vol from r window w as (order by day rows 167 preceding)) select day, round(vol, 4) as vol_pct from v""")
def g13_rolling_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = A.rolling_volatility(view(spark, sf_dir, "bars"), 168, 8760)
    return got.select("day", F.round("vol_pct", 4).alias("vol_pct"))


@query("""with s as (select session_id, count(*) % 2 = 0 as ok, case count(*) % 3 when 0 then 'fail_signal' when 1 then 'inconclusive_power' else 'pass' end as c from fills group by 1),
t as (select session_id, case when not ok or c = 'fail_signal' then 'blocked' when c = 'inconclusive_power' then 'inconclusive' else 'supported' end as status from s)
select session_id, status, (select case when count_if(status = 'blocked') > 0 then 'blocked' when count_if(status = 'inconclusive') > 0 then 'inconclusive' else 'supported' end from t) as worst from t""")
def l17_screen_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = view(spark, sf_dir, "fills").groupBy("session_id").agg(F.count("*").alias("n"))
    conditional = F.when(F.col("n") % 3 == 0, "fail_signal").when(F.col("n") % 3 == 1, "inconclusive_power").otherwise("pass")
    rows = n.select("session_id", G.screen_status(F.col("n") % 2 == 0, conditional).alias("status"))
    worst = G.worst_status(rows, ["blocked", "inconclusive", "supported"]).withColumnRenamed("status", "worst")
    return rows.join(F.broadcast(worst), how="cross")  # one row
