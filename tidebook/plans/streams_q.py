"""Queries: stream validation, integrity and order-book state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import view
from ..operators import book as B
from ..operators import streams as S
from ..registry import query

HOUR = 3_600_000


@query("""select seq, coalesce(agg_trade_id <> lag(agg_trade_id) over (partition by session_id order by seq) + 1, false) as has_gap from trades""")
def b1_trade_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.trade_gaps(view(spark, sf_dir, "trades")).select("seq", "has_gap")


@query("""select d.seq, coalesce(first_update_id <> lag(last_update_id) over (order by seq) + 1, false) as has_gap from diffs d""")
def b2_depth_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.depth_gaps(view(spark, sf_dir, "diffs"), by=()).select("seq", "has_gap")


def _depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded stream: every 97th event is a snapshot that covers the ids up to two events later."""
    snap = F.col("seq") % 97 == 0
    return view(spark, sf_dir, "diffs").select(
        "seq", F.col("time_ms").alias("recv_ms"), F.when(snap & (F.col("seq") % 2 == 0), F.col("time_ms") - 5).alias("request_ms"),
        F.when(snap, "snapshot").otherwise("diff").alias("event_type"), F.when(~snap, F.col("time_ms")).alias("time_ms"),
        F.when(~snap, F.col("first_update_id") - 10 * (F.lit(1) * (F.col("seq") % 97 == 1).cast("int"))).alias("first_update_id"),
        F.when(snap, F.col("last_update_id") + 20).otherwise(F.col("last_update_id")).alias("last_update_id"),
    )


#: The stream of ``_depth`` with each row's snapshot (seg), last kept id of that stretch (prev), and where waiting ends (stop).
BRIDGED = """
r as (select seq, time_ms as recv_ms, case when seq % 97 = 0 and seq % 2 = 0 then time_ms - 5 end as request_ms, seq % 97 = 0 as snap, case when seq % 97 <> 0 then time_ms end as time_ms,
      case when seq % 97 <> 0 then first_update_id - case when seq % 97 = 1 then 10 else 0 end end as f, last_update_id + case when seq % 97 = 0 then 20 else 0 end as l from diffs),
g as (select *, max(case when snap then seq end) over (order by seq) as seg, lag(l) over (order by seq) as before_l from r),
h as (select seq as seg, l as id, recv_ms as cutoff, request_ms is not null as timed from g where snap),
k as (select g.*, h.id, h.cutoff, h.timed, not snap and (h.id is null or l > h.id) as kept from g left join h using (seg)),
p as (select *, last_value(case when kept then l end ignore nulls) over (partition by seg order by seq rows between unbounded preceding and 1 preceding) as prev from k),
q as (select *, case when kept then case when prev is not null then f = prev + 1 when seg is null then true else f <= id + 1 and id + 1 <= l end end as linked,
      kept and case when timed then recv_ms >= cutoff else recv_ms > cutoff end as after from p),
e as (select *, min(case when not linked then seq end) over (partition by seg) as broke, min(case when after then seq end) over (partition by seg) as bound from q),
w as (select *, coalesce(bound is not null and (broke is null or bound < broke), false) as freed from e),
x as (select *, seg is not null and coalesce(seq <= case when freed then bound else broke end, true) as waits, max(case when seq = bound then time_ms end) over (partition by seg) as bound_ms from w)"""


@query(f"""with {BRIDGED}
select seq, recv_ms, request_ms, case when snap then 'snapshot' else 'diff' end as event_type, case when waits and freed then bound_ms else time_ms end as time_ms, f as first_update_id, l as last_update_id,
case when snap then false when seg is not null and not waits then coalesce(f <> before_l + 1, false) else coalesce(not linked, false) end as has_gap,
case when snap then false when waits and freed then seq = bound else true end as dispatch, 1 as sub from x
where case when seg is null then not snap when snap then freed when waits then kept and (freed or coalesce(seq = broke, false)) else true end
union all select seq, recv_ms, request_ms, 'resync', coalesce(request_ms, recv_ms), f, l, false, false, 0 from r where snap""")
def b3_b6_bridged_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bridge_snapshots(_depth(spark, sf_dir), by=())


@query("""with d as (select time_ms, lag(time_ms) over (partition by session_id order by seq) as p, seq from quotes) select seq from d where time_ms < p""")
def b7_monotone_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.monotone_violations(view(spark, sf_dir, "quotes")).select("seq")


MERGED = "mg as (select session_id, time_ms, 0 as kind, seq from quotes union all select session_id, time_ms, 1, seq from trades)"


@query(f"with {MERGED} select session_id, seq, kind, row_number() over (partition by session_id order by time_ms, kind, seq) as event_no from mg")
def b9_merged_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["session_id", "time_ms", "seq"]
    m = S.merge_events(view(spark, sf_dir, "quotes").select(*cols), view(spark, sf_dir, "trades").select(*cols))
    return S.position_in(m).select("session_id", "seq", "kind", F.col("event_no").cast("long").alias("event_no"))


@query(f"with {MERGED} select session_id, time_ms, count(*) as n, sum(kind)::bigint as n_trades from mg group by 1, 2")
def b10_millisecond_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["session_id", "time_ms", "seq"]
    m = S.merge_events(view(spark, sf_dir, "quotes").select(*cols), view(spark, sf_dir, "trades").select(*cols))
    return m.groupBy("session_id", "time_ms").agg(F.count("*").alias("n"), F.sum("kind").alias("n_trades"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs with gaps, snapshots every 41st event, resyncs every 89th, and trades."""
    d = view(spark, sf_dir, "diffs")
    kind = F.when(F.col("seq") % 41 == 0, "snapshot").when(F.col("seq") % 89 == 0, "resync").otherwise("diff")
    d = d.select("session_id", "time_ms", "seq", kind.alias("event_type"), ((F.col("seq") % 50 == 0) & (kind == "diff")).alias("has_gap"))
    t = view(spark, sf_dir, "trades").select("session_id", "time_ms", "seq", F.lit("trade").alias("event_type"), (F.col("seq") % 200 == 0).alias("has_gap"))
    return S.merge_events(d, t)


GAPS = """
ev as (select session_id, time_ms, seq, 0 as kind, case when seq % 41 = 0 then 'snapshot' when seq % 89 = 0 then 'resync' else 'diff' end as event_type from diffs),
ev2 as (select *, seq % 50 = 0 and event_type = 'diff' as has_gap from ev union all select session_id, time_ms, seq, 1, 'trade', seq % 200 = 0 from trades),
ev3 as (select *, max(case when has_gap then 1 else 0 end) over (partition by session_id, time_ms) = 1 as censored from ev2),
ev4 as (select *, coalesce(last_value(case when censored then true when event_type = 'resync' then true when event_type = 'snapshot' then false end ignore nulls)
        over (partition by session_id order by time_ms, kind, seq rows unbounded preceding), true) as in_gap from ev3)"""


@query(f"with {GAPS} select session_id, seq, kind, censored, in_gap from ev4")
def b11_b12_gap_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gap_state(_events(spark, sf_dir)).select("session_id", "seq", "kind", "censored", "in_gap")


@query(f"""with {GAPS} select session_id, count(*) as total_events, count_if(event_type = 'resync')::bigint as snapshot_resyncs, count_if(event_type = 'snapshot')::bigint as snapshots,
count_if(event_type = 'diff')::bigint as depth_diffs, count_if(kind = 1)::bigint as trade_events, count_if(has_gap)::bigint as gaps_detected,
count_if(has_gap and kind = 0)::bigint as depth_gaps_detected, count_if(has_gap and kind = 1)::bigint as trade_gaps_detected,
count_if(censored or (in_gap and event_type in ('diff', 'trade')))::bigint as events_during_gap from ev4 group by 1""")
def b14_replay_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.replay_counters(S.gap_state(_events(spark, sf_dir)))


INTEGRITY = f"""
dg as (select *, time_ms // {HOUR} * {HOUR} as hour_ms, coalesce(first_update_id <> lag(last_update_id) over (order by seq) + 1, false) as has_gap from diffs),
tg as (select *, time_ms // {HOUR} * {HOUR} as hour_ms, coalesce(agg_trade_id <> lag(agg_trade_id) over (order by seq) + 1, false) as has_gap from trades),
cal as (select unnest(range(min(hour_ms), max(hour_ms) + 1, {HOUR}))::bigint as hour_ms from dg),
dh as (select hour_ms, count(*) as n_depth, count_if(has_gap)::bigint as depth_gaps, arg_min(first_update_id, seq) as first_id, arg_max(last_update_id, seq) as last_id from dg group by 1),
th as (select hour_ms, count(*) as n_trades, count_if(has_gap)::bigint as trade_gaps from tg group by 1),
hi as (select hour_ms, coalesce(n_depth, 0) as n_depth, coalesce(depth_gaps, 0) as depth_gaps, coalesce(n_trades, 0) as n_trades, coalesce(trade_gaps, 0) as trade_gaps, first_id, last_id,
       coalesce(first_id <> lag(last_id) over (order by hour_ms) + 1, false) as cross_gap from cal left join dh using (hour_ms) left join th using (hour_ms)),
hv as (select *, array_to_string(list_filter([case when n_depth = 0 then 'no_depth' end, case when n_trades = 0 then 'no_trades' end, case when depth_gaps > 0 then 'depth_gap' end,
       case when trade_gaps > 0 then 'trade_gap' end, case when cross_gap then 'cross_hour_gap' end], lambda x: x is not null), ',') as reasons from hi)"""


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hour_integrity(view(spark, sf_dir, "diffs"), view(spark, sf_dir, "trades"), by=())


@query(f"with {INTEGRITY} select hour_ms, n_depth, depth_gaps, n_trades, trade_gaps, first_id, last_id, cross_gap, reasons from hv")
def b15_b17_hour_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _hours(spark, sf_dir).withColumn("reasons", F.array_join("rejection_reasons", ","))
    return got.select("hour_ms", "n_depth", "depth_gaps", "n_trades", "trade_gaps", "first_id", "last_id", "cross_gap", "reasons")


@query(f"""with {INTEGRITY}, ok as (select hour_ms from hv where n_depth >= 10), c as (select hour_ms, count(*) over (order by hour_ms range between current row and {2 * HOUR} following) as n from ok)
select hour_ms from c where n = 3""")
def b19_candidate_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = _hours(spark, sf_dir).withColumn("valid", F.col("n_depth") >= 10)
    return S.candidate_starts(hours, 3, by=()).select("hour_ms")


@query("""with g as (select session_id, time_ms - lag(time_ms) over (partition by session_id order by time_ms, seq) as gap from quotes)
select session_id, count(gap) as n, min(gap) as min, median(gap)::double as median, round(avg(gap), 3) as mean, round(quantile_cont(gap, 0.9), 3) as p90, round(quantile_cont(gap, 0.95), 3) as p95,
max(gap) as max from g group by 1""")
def b21_timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("time_ms", "seq")
    rows = view(spark, sf_dir, "quotes").withColumn("gap", F.col("time_ms") - F.lag("time_ms").over(w))
    return S.timing_summary(rows, ["session_id"], "gap").withColumns({c: F.round(c, 3) for c in ("mean", "p90", "p95")})


@query("""with sp as (select session_id, time_ms as lo_ms, time_ms + 600000 as hi_ms from diffs where seq % 97 = 0)
select fill_id from fills f where exists (select 1 from sp where sp.session_id = f.session_id and f.time_ms >= lo_ms and f.time_ms < hi_ms)""")
def b22_fill_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = view(spark, sf_dir, "diffs").filter("seq % 97 = 0").select("session_id", F.col("time_ms").alias("lo_ms"), (F.col("time_ms") + 600_000).alias("hi_ms"))
    return S.exposed_to(view(spark, sf_dir, "fills"), spans, "time_ms", 600_000).select("fill_id")


@query("""with d as (select session_id, time_ms // 1000 as time_ms, count(*) as nd from quotes group by 1, 2), t as (select session_id, time_ms // 1000 as time_ms, count(*) as nt from trades group by 1, 2)
select session_id, count_if(nd is not null and nt is not null)::bigint as shared_ms, coalesce(sum(nd) filter (nt is not null), 0)::bigint as depth_in_shared,
coalesce(sum(nt) filter (nd is not null), 0)::bigint as trades_in_shared, count(nd) as depth_ms, count(nt) as trade_ms from d full join t using (session_id, time_ms) group by 1""")
def d10_same_time_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.expr("time_ms div 1000")
    return S.same_ms_overlap(view(spark, sf_dir, "quotes").withColumn("time_ms", second), view(spark, sf_dir, "trades").withColumn("time_ms", second))


LIVES = """
lv0 as (select *, lead(seq) over (partition by session_id, segment_id, side, price order by seq) as to_seq from level_updates),
lv as (select session_id, segment_id, side, price, qty, seq as from_seq, to_seq from lv0 where qty > 0),
bk as (select p.session_id, p.segment_id, p.seq, l.side, l.price, l.qty from level_updates p join lv l on p.session_id = l.session_id and p.segment_id = l.segment_id
       and l.from_seq <= p.seq and (l.to_seq is null or p.seq < l.to_seq))"""


@query(f"with {LIVES} select session_id, segment_id, side, price, qty, from_seq, to_seq from lv")
def c2_level_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.lifetimes(view(spark, sf_dir, "level_updates"))


BBO = f"""with {LIVES} select session_id, segment_id, seq, max(price) filter (side = 'bid') as bid, arg_max(qty, price) filter (side = 'bid') as bid_qty,
min(price) filter (side = 'ask') as ask, arg_min(qty, price) filter (side = 'ask') as ask_qty from bk group by 1, 2, 3"""


@query(BBO)
def c3_best_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.best_quotes(view(spark, sf_dir, "level_updates"))


@query(BBO)
def c3_best_quotes_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.best_quotes_by_kernel(view(spark, sf_dir, "level_updates"))


@query(f"""with {LIVES},
bb as (select session_id, segment_id, seq, max(price) filter (side = 'bid') as bid, arg_max(qty, price) filter (side = 'bid') as bid_qty,
min(price) filter (side = 'ask') as ask, arg_min(qty, price) filter (side = 'ask') as ask_qty from bk group by 1, 2, 3)
select seq, (bid + ask) / 2.0 as mid, ask - bid as spread, round((bid_qty * ask + ask_qty * bid) / (bid_qty + ask_qty)::double, 6) as micro, bid >= ask as crossed from bb where bid is not null and ask is not null""")
def c4_c8_book_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalar import microprice

    q = B.best_quotes(view(spark, sf_dir, "level_updates")).filter("bid is not null and ask is not null")
    micro = microprice(*[F.col(c) for c in ("bid", "bid_qty", "ask", "ask_qty")])
    return q.select(
        "seq", ((F.col("bid") + F.col("ask")) / F.lit(2.0)).alias("mid"), (F.col("ask") - F.col("bid")).alias("spread"), F.round(micro, 6).alias("micro"),
        (F.col("bid") >= F.col("ask")).alias("crossed"),
    )


@query(f"""with {LIVES} select seq, count_if(side = 'bid')::bigint as bid_count, count_if(side = 'ask')::bigint as ask_count from bk group by 1""")
def c6_depth_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = view(spark, sf_dir, "level_updates")
    return B.depth_counts(u.select("session_id", "segment_id", "seq"), u).select("seq", "bid_count", "ask_count")


@query("""with lv0 as (select *, lead(seq) over (partition by session_id, segment_id, side, price order by seq) as to_seq from level_updates)
select p.seq, p.price, coalesce(sum(l.qty), 0)::bigint as book_qty from (select *, seq + 7 as at from level_updates) p left join lv0 l
on p.session_id = l.session_id and p.segment_id = l.segment_id and p.side = l.side and p.price = l.price and l.qty > 0 and l.seq <= p.at and (l.to_seq is null or p.at < l.to_seq) group by 1, 2""")
def c6_qty_at_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = view(spark, sf_dir, "level_updates")
    probes = u.select("session_id", "segment_id", "side", "price", F.col("seq").alias("of"), (F.col("seq") + 7).alias("seq"))
    return B.qty_at(probes, u).select(F.col("of").alias("seq"), "price", "book_qty")


@query(f"""with {LIVES}, r as (select *, row_number() over (partition by seq, side order by case side when 'bid' then -price else price end) as rank from bk)
select seq, side as book_side, rank::int as rank, price, qty from r where rank <= 3""")
def c7_top_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = view(spark, sf_dir, "level_updates")
    return B.top_levels(u.select("session_id", "segment_id", "seq"), u, 3).select("seq", "book_side", "rank", "price", "qty")


@query(f"""with {LIVES}, p as (select session_id, segment_id, seq, row_number() over (partition by session_id, segment_id order by seq) as no from level_updates),
x as (select p.seq, a.side, a.price, a.qty from p join bk a using (session_id, segment_id, seq) where p.no % 20 = 0),
j as (select seq, coalesce(string_agg('["' || price || '","' || qty || '"]', ',' order by price desc) filter (side = 'bid'), '') as b,
      coalesce(string_agg('["' || price || '","' || qty || '"]', ',' order by price) filter (side = 'ask'), '') as a from x group by 1)
select seq, sha256('{{"bids":[' || b || '],"asks":[' || a || '],"last_update_id":' || seq || '}}') as state_hash from j""")
def c9_c10_state_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.checkpoints(view(spark, sf_dir, "level_updates"), 20).select("seq", "state_hash")
