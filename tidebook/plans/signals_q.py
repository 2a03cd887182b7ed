"""Queries: as-of joins, markouts, order-flow and microprice signals, lots and profit and loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import view
from ..operators import pnl as P
from ..operators import signals as S
from ..operators.asof import asof, with_horizons
from ..registry import query

H = (300_000, 1_800_000, 7_200_000)
MIN5, MIN30, HOUR = 300_000, 1_800_000, 3_600_000
HS = ", ".join(map(str, H))
#: SQL: quotes with mids; the last and the first quote of each time.
QL = """
q as (select *, (bid + ask) / 2.0 as mid from quotes),
ql as (select * from q qualify row_number() over (partition by session_id, time_ms order by seq desc) = 1),
qf as (select * from q qualify row_number() over (partition by session_id, time_ms order by seq) = 1)"""
MARKOUTS = f"""
h as (select unnest([{HS}])::bigint as horizon_ms),
fh as (select *, time_ms + horizon_ms as at_ms from fills, h),
m as (select f.*, g.time_ms as sample_ms, g.mid, (case f.side when 'buy' then 1 else -1 end) * (g.mid - f.price) as markout
      from fh f asof join qf g on f.session_id = g.session_id and f.at_ms <= g.time_ms)"""


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in cols})


def signed(name: str) -> Column:
    """``name`` to 6 digits; a zero keeps its sign, as in SQL."""
    return F.when(F.col(name) == 0, F.col(name)).otherwise(F.round(name, 6)).alias(name)


@query(f"""with {QL} select f.fill_id, g.seq as q_seq, g.mid as q_mid from fills f
asof left join ql g on f.session_id = g.session_id and f.time_ms >= g.time_ms""")
def d1_asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof(view(spark, sf_dir, "fills"), S.with_mid(view(spark, sf_dir, "quotes")), S.BY, ["seq", "mid"]).select("fill_id", "q_seq", "q_mid")


@query(f"""with {QL} select f.fill_id, g.seq as q_seq from fills f
asof left join ql g on f.session_id = g.session_id and f.time_ms > g.time_ms""")
def d2_asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof(view(spark, sf_dir, "fills"), view(spark, sf_dir, "quotes"), S.BY, ["seq"], strict=True).select("fill_id", "q_seq")


@query(f"""with {QL}, h as (select unnest([{HS}])::bigint as horizon_ms), fh as (select *, time_ms + horizon_ms as at_ms from fills, h)
select f.fill_id, f.horizon_ms, g.seq as q_seq, g.time_ms as q_time_ms from fh f
asof left join qf g on f.session_id = g.session_id and f.at_ms <= g.time_ms""")
def d3_asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_horizons(view(spark, sf_dir, "fills"), H)
    got = asof(rows, view(spark, sf_dir, "quotes"), S.BY, ["seq", "time_ms"], at=F.col("time_ms") + F.col("horizon_ms"), forward=True)
    return got.select("fill_id", "horizon_ms", "q_seq", "q_time_ms")


@query(f"""with {QL}, j as (select f.fill_id, f.time_ms, g.seq as q_seq, g.time_ms as qt from fills f
asof left join ql g on f.session_id = g.session_id and f.time_ms >= g.time_ms)
select fill_id, case when time_ms - qt <= {MIN5} then q_seq end as q_seq from j""")
def d4_asof_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = asof(view(spark, sf_dir, "fills"), view(spark, sf_dir, "quotes"), S.BY, ["seq"], most_ms=MIN5, bucket_ms=6 * HOUR)
    return got.select("fill_id", "q_seq")


@query(f"""with {QL}, f as (select *, time_ms + {MIN30} as at_ms from fills), j as (select f.fill_id, f.at_ms, g.seq as q_seq, g.time_ms as qt from f
asof left join qf g on f.session_id = g.session_id and f.at_ms <= g.time_ms)
select fill_id, case when qt - at_ms <= {MIN5} then q_seq end as q_seq from j""")
def d5_asof_forward_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, quotes = view(spark, sf_dir, "fills"), view(spark, sf_dir, "quotes")
    return asof(rows, quotes, S.BY, ["seq"], at=F.col("time_ms") + MIN30, forward=True, most_ms=MIN5).select("fill_id", "q_seq")


GRID = f"""
e as (select session_id, min(time_ms) as lo, max(time_ms) as hi from quotes group by 1),
g as (select session_id, unnest(range((lo + {HOUR} - 1) // {HOUR} * {HOUR}, hi + 1, {HOUR}))::bigint as time_ms from e)"""


@query(f"""with {QL}, {GRID} select g.session_id, g.time_ms, q.mid as q_mid from g
asof left join ql q on g.session_id = q.session_id and g.time_ms >= q.time_ms""")
def d6_grid_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.asof import grid

    quotes = S.with_mid(view(spark, sf_dir, "quotes"))
    return asof(grid(quotes, S.BY, HOUR), quotes, S.BY, ["mid"])


@query(f"""with {QL}, {MARKOUTS} select fill_id, horizon_ms, sample_ms, mid, markout, round(markout / price * 10000, 6) as markout_bps from m""")
def l1_markouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = P.markouts(view(spark, sf_dir, "fills"), view(spark, sf_dir, "quotes"), H)
    return got.select("fill_id", "horizon_ms", "sample_ms", "mid", "markout", signed("markout_bps"))


@query(f"""with {QL}, {MARKOUTS}, s as (select horizon_ms, count(*) as n, avg(markout / price * 10000) as mean, list_sort(list(markout / price * 10000)) as v from m group by 1),
p as (select *, [(n + 1) * k // 4 for k in [1, 2, 3]] as js, [((n + 1) * k % 4) / 4.0 for k in [1, 2, 3]] as fr from s)
select horizon_ms, n, round(mean, 4) as mean_bps,
 round(v[js[1]] + (v[js[1] + 1] - v[js[1]]) * fr[1], 4) as q1_bps, round(v[js[2]] + (v[js[2] + 1] - v[js[2]]) * fr[2], 4) as q2_bps,
 round(v[js[3]] + (v[js[3] + 1] - v[js[3]]) * fr[3], 4) as q3_bps from p""")
def f1_markout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.markout_summary(P.markouts(view(spark, sf_dir, "fills"), view(spark, sf_dir, "quotes"), H))


OFI = f"""
v as (select * from q where bid + ask > 0 and bid_qty >= 0 and ask_qty >= 0),
e0 as (select *, lag(seq) over w as ps, lag(bid) over w as pb, lag(bid_qty) over w as pbq, lag(ask) over w as pa, lag(ask_qty) over w as paq, row_number() over w - 1 as at
       from v window w as (partition by session_id order by time_ms, seq)),
e1 as (select *, case when ps is null then 0 else (case when bid >= pb then bid_qty else 0 end) - (case when bid <= pb then pbq else 0 end)
       - (case when ask <= pa then ask_qty else 0 end) + (case when ask >= pa then paq else 0 end) end as inc, bid_qty + ask_qty as depth from e0),
e2 as (select *, sum(inc) over w as ci, sum(case when depth > 0 then depth else 0 end) over w as cd, sum(case when depth > 0 then 1 else 0 end) over w as cn
       from e1 window w as (partition by session_id order by time_ms, seq rows unbounded preceding)),
el as (select * from e2 qualify row_number() over (partition by session_id, time_ms order by seq desc) = 1)"""


@query(f"""with {QL}, {OFI} select seq, session_id, cast(inc as bigint) as increment from e1""")
def g1_ofi_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    got = S.with_ofi_sums(S.valid_samples(view(spark, sf_dir, "quotes")))
    w = Window.partitionBy("session_id").orderBy("time_ms", "seq")
    return got.select("seq", "session_id", (F.col("__ofi") - F.coalesce(F.lag("__ofi").over(w), F.lit(0))).alias("increment"))


OFI_POINTS = f"""
ge as (select session_id, min(time_ms) as lo, max(time_ms) as hi from v group by 1),
gp as (select session_id, unnest(range((lo + {HOUR} + {MIN30} - 1) // {MIN30} * {MIN30}, hi + 1, {MIN30}))::bigint as time_ms from ge),
n0 as (select g.*, n.mid as n_mid, n.ci as nci, n.cd as ncd, n.cn as ncn, n.at as nat, g.time_ms - {HOUR} as s_ms from gp g
       asof join el n on g.session_id = n.session_id and g.time_ms >= n.time_ms where n.at > 0),
n1 as (select n0.*, s.at as sat, s.ci as sci, s.cd as scd, s.cn as scn from n0 asof left join el s on n0.session_id = s.session_id and n0.s_ms >= s.time_ms),
n2 as (select *, case when sat is not null and nat > sat then nci - sci else 0 end as raw,
       case when sat is not null and nat > sat then ncd - scd else 0 end as dsum, case when sat is not null and nat > sat then ncn - scn else 0 end as dn from n1),
n3 as (select session_id, time_ms, n_mid, cast(raw as bigint) as raw_ofi, case when dn > 0 and dsum > 0 then raw / (dsum / dn::double) else 0.0 end as normalized_ofi from n2),
h as (select unnest([{HS}])::bigint as horizon_ms), n4 as (select *, time_ms + horizon_ms as f_ms from n3, h),
s0 as (select a.*, f.time_ms as future_ms, f.mid as future_mid, (f.mid - a.n_mid) / a.n_mid * 10000.0 as drift_bps
       from n4 a asof join (select * from v qualify row_number() over (partition by session_id, time_ms order by seq) = 1) f
       on a.session_id = f.session_id and a.f_ms <= f.time_ms)"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ofi_samples(view(spark, sf_dir, "quotes"), MIN30, HOUR, H)


@query(f"""with {QL}, {OFI}, {OFI_POINTS} select session_id, time_ms, horizon_ms, future_ms, n_mid as mid, future_mid, raw_ofi,
round(normalized_ofi, 6) as normalized_ofi, round(drift_bps, 6) as drift_bps from s0""")
def l7_ofi_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_samples(spark, sf_dir), "normalized_ofi", "drift_bps")


EDGES = (-2.0, -0.5, 0.5, 2.0)
RANGES = """
b as (select * from (values (0, '<-2.0', -1e300::double, -2.0::double), (1, '[-2.0,-0.5)', -2.0, -0.5), (2, '[-0.5,0.5)', -0.5, 0.5),
      (3, '[0.5,2.0)', 0.5, 2.0), (4, '>=2.0', 2.0, 1e300)) t(bucket_no, bucket, lo, hi))"""


@query(f"""with {QL}, {OFI}, {OFI_POINTS}, {RANGES}, k as (select distinct horizon_ms from s0)
select k.horizon_ms, b.bucket_no, b.bucket, count(s.time_ms) as n, round(avg(s.normalized_ofi), 6) as avg_signal, round(avg(s.drift_bps), 6) as avg_value,
round(median(s.drift_bps), 6) as median_value from k cross join b left join s0 s on s.horizon_ms = k.horizon_ms and s.normalized_ofi >= b.lo and s.normalized_ofi < b.hi
group by 1, 2, 3""")
def f6_drift_by_ofi(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.bucketed(_samples(spark, sf_dir), ["horizon_ms"], "normalized_ofi", "drift_bps", EDGES)
    return r6(got, "avg_signal", "avg_value", "median_value")


TOX = f"""
f0 as (select f.*, n.mid as n_mid, n.ci as nci, n.cd as ncd, n.cn as ncn, n.at as nat, f.time_ms - {HOUR} as s_ms from (select * from fills where is_maker) f
       asof join el n on f.session_id = n.session_id and f.time_ms > n.time_ms where n.at > 0),
f1 as (select f0.*, s.at as sat, s.ci as sci, s.cd as scd, s.cn as scn from f0 asof left join el s on f0.session_id = s.session_id and f0.s_ms >= s.time_ms),
f2 as (select *, case when sat is not null and nat > sat then nci - sci else 0 end as raw,
       case when sat is not null and nat > sat then ncd - scd else 0 end as dsum, case when sat is not null and nat > sat then ncn - scn else 0 end as dn from f1),
f3 as (select *, case side when 'buy' then 1 else -1 end as sgn, case when dn > 0 and dsum > 0 then raw / (dsum / dn::double) else 0.0 end as normalized_ofi from f2),
h as (select unnest([{HS}])::bigint as horizon_ms), f4 as (select *, time_ms + horizon_ms as f_ms from f3, h),
t0 as (select a.*, f.mid as future_mid, a.sgn * a.normalized_ofi as side_aligned, a.sgn * (f.mid - a.n_mid) / a.n_mid * 10000.0 as move_bps
       from f4 a asof join (select * from v qualify row_number() over (partition by session_id, time_ms order by seq) = 1) f
       on a.session_id = f.session_id and a.f_ms <= f.time_ms)"""


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ofi_fill_toxicity(view(spark, sf_dir, "fills"), view(spark, sf_dir, "quotes"), HOUR, H)


@query(f"""with {QL}, {OFI}, {TOX} select fill_id, horizon_ms, n_mid as mid_at_fill, future_mid, cast(raw as bigint) as raw_ofi,
round(side_aligned, 6) as side_aligned, round(move_bps, 6) as move_bps from t0""")
def l8_ofi_fill_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _toxicity(spark, sf_dir).select("fill_id", "horizon_ms", "mid_at_fill", "future_mid", "raw_ofi", "side_aligned", "move_bps")
    return r6(got, "side_aligned", "move_bps")


@query(f"""with {QL}, {OFI}, {TOX}, {RANGES}, t1 as (select 'all' as sd, * from t0 union all select side, * from t0), k as (select distinct horizon_ms, sd from t1)
select k.horizon_ms, k.sd as side, b.bucket_no, b.bucket, count(s.fill_id) as n, round(avg(s.side_aligned), 6) as avg_signal, round(avg(s.move_bps), 6) as avg_value,
round(median(s.move_bps), 6) as median_value from k cross join b left join t1 s on s.horizon_ms = k.horizon_ms and s.sd = k.sd and s.side_aligned >= b.lo and s.side_aligned < b.hi
group by 1, 2, 3, 4""")
def f7_toxicity_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.bucketed(S.by_side(_toxicity(spark, sf_dir)), ["horizon_ms", "side"], "side_aligned", "move_bps", EDGES)
    return r6(got, "avg_signal", "avg_value", "median_value")


MICRO = """
mq as (select *, (bid_qty * ask + ask_qty * bid) / (bid_qty + ask_qty)::double as micro from q where bid + ask > 0 and bid_qty >= 0 and ask_qty >= 0 and bid_qty + ask_qty > 0),
ml as (select * from mq qualify row_number() over (partition by session_id, time_ms order by seq desc) = 1),
mf as (select * from mq qualify row_number() over (partition by session_id, time_ms order by seq) = 1)"""


@query(f"""with {QL}, {MICRO}, e as (select session_id, min(time_ms) as lo, max(time_ms) as hi from mq group by 1),
g as (select session_id, unnest(range((lo + {MIN30} - 1) // {MIN30} * {MIN30}, hi + 1, {MIN30}))::bigint as time_ms from e),
n as (select g.*, m.mid, m.micro from g asof join ml m on g.session_id = m.session_id and g.time_ms >= m.time_ms),
h as (select unnest([{HS}])::bigint as horizon_ms), nh as (select *, time_ms + horizon_ms as f_ms from n, h)
select n.session_id, n.time_ms, n.horizon_ms, n.mid, f.mid as future_mid, round((n.micro - n.mid) / n.mid * 10000, 6) as signal_bps,
round((f.mid - n.mid) / n.mid * 10000, 6) as drift_bps from nh n asof join mf f on n.session_id = f.session_id and n.f_ms <= f.time_ms""")
def l9_microprice_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.microprice_samples(view(spark, sf_dir, "quotes"), MIN30, H), "signal_bps", "drift_bps")


@query(f"""with {QL}, {MICRO}, n as (select f.*, m.mid, m.micro, case f.side when 'buy' then 1 else -1 end as sgn from (select * from fills where is_maker) f
asof join ml m on f.session_id = m.session_id and f.time_ms >= m.time_ms),
h as (select unnest([{HS}])::bigint as horizon_ms), nh as (select *, time_ms + horizon_ms as f_ms from n, h)
select n.fill_id, n.horizon_ms, n.mid as mid_at_fill, f.mid as future_mid, round(sgn * (n.micro - n.mid) / n.mid * 10000, 6) as side_aligned,
round(sgn * (n.mid - n.price) / n.mid * 10000, 6) as edge_bps, round(sgn * (f.mid - n.mid) / n.mid * 10000, 6) as move_bps
from nh n asof join mf f on n.session_id = f.session_id and n.f_ms <= f.time_ms""")
def l10_microprice_fill_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.microprice_fill_toxicity(view(spark, sf_dir, "fills"), view(spark, sf_dir, "quotes"), H)
    return r6(got.select("fill_id", "horizon_ms", "mid_at_fill", "future_mid", "side_aligned", "edge_bps", "move_bps"), "side_aligned", "edge_bps", "move_bps")


FEES = "(case when is_maker then 2.0 else 5.0 end) * qty * price / 10000"
PNL = f"""
fm as (select f.*, g.mid, case f.side when 'buy' then 1 else -1 end as sgn, {FEES} as fee from fills f
       asof left join ql g on f.session_id = g.session_id and f.time_ms >= g.time_ms),
lastq as (select session_id, arg_max(mid, {{'t': time_ms, 's': seq}}) as final_mid from q group by 1),
tot as (select session_id, count(*) as n_fills, sum(case when sgn > 0 then qty else 0 end) as bought, sum(case when sgn < 0 then qty else 0 end) as sold,
        sum(sgn * qty) as position, sum(-sgn * qty * price) as cash, sum(coalesce(sgn * (mid - price) * qty, 0)) as spread_capture, sum(fee) as fees from fm group by 1),
pl as (select t.*, final_mid, cash + position * final_mid as gross from tot t left join lastq using (session_id))"""


@query(f"""with {QL}, {PNL} select session_id, n_fills, bought::bigint as bought, sold::bigint as sold, position::bigint as position, cash::bigint as cash, final_mid,
round(spread_capture, 6) as spread_capture, round(gross - spread_capture, 6) as inventory_pnl, round(gross, 6) as gross_pnl, round(fees, 6) as fees, round(gross - fees, 6) as net_pnl from pl""")
def l2_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = P.pnl(view(spark, sf_dir, "fills"), view(spark, sf_dir, "quotes"), 2, 5)
    return r6(got, "spread_capture", "inventory_pnl", "gross_pnl", "fees", "net_pnl")


@query("""select fill_id, cast(sum(case side when 'buy' then qty else -qty end) over w as bigint) as position,
cast(sum(case side when 'buy' then -qty * price else qty * price end) over w as bigint) as cash from fills
window w as (partition by session_id order by time_ms, seq rows unbounded preceding)""")
def g8_running_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.running_inventory(view(spark, sf_dir, "fills")).select("fill_id", "position", "cash")


LOTS = """
li as (select *, sum(qty) over (partition by session_id, side order by time_ms, seq rows unbounded preceding) as hi from fm),
lb as (select *, hi - qty as lo from li where side = 'buy'), ls as (select *, hi - qty as lo from li where side = 'sell'),
lo0 as (select b.session_id, least(b.hi, s.hi) - greatest(b.lo, s.lo) as q, (b.time_ms, b.seq) < (s.time_ms, s.seq) as isl, b.fill_id as bf, s.fill_id as sf, b.time_ms as bt,
        s.time_ms as st, b.price as bp, s.price as sp, b.mid as bm, s.mid as sm, b.fee / b.qty as bfe, s.fee / s.qty as sfe
        from lb b join ls s on b.session_id = s.session_id and b.lo < s.hi and s.lo < b.hi),
lots as (select session_id, case when isl then bf else sf end as open_fill_id, case when isl then sf else bf end as close_fill_id, abs(st - bt) as hold_ms, q as qty,
         (sp - bp) * q as realized_pnl, case when isl then (bm - bp) * q else (sp - sm) * q end as open_spread, case when isl then (sp - sm) * q else (bm - bp) * q end as close_spread,
         (bfe + sfe) * q as fees from lo0)"""


def _lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fifo_lots(view(spark, sf_dir, "fills"), view(spark, sf_dir, "quotes"), 2, 5)


@query(f"""with {QL}, {PNL}, {LOTS} select session_id, open_fill_id, close_fill_id, hold_ms, qty::bigint as qty, realized_pnl::bigint as realized_pnl,
round(realized_pnl - open_spread - close_spread, 6) as inventory_pnl, round(fees, 6) as total_fees, round(realized_pnl - fees, 6) as net_pnl from lots""")
def l3_fifo_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _lots(spark, sf_dir).select("session_id", "open_fill_id", "close_fill_id", "hold_ms", "qty", "realized_pnl", "inventory_pnl", "total_fees", "net_pnl")
    return r6(got, "inventory_pnl", "total_fees", "net_pnl")


@query(f"""with {QL}, {PNL}, {LOTS}, c as (select *, sum(qty) over (partition by session_id order by hold_ms range unbounded preceding) as run, sum(qty) over (partition by session_id) as total from lots)
select session_id, count(*) as n_lots, sum(qty)::bigint as matched_qty, sum(realized_pnl)::bigint as realized_pnl, round(sum(fees), 4) as fees,
round(case when count(open_spread) = count(*) and count(close_spread) = count(*) then sum(realized_pnl - open_spread - close_spread) end, 4) as inventory_pnl,
round(sum(hold_ms * qty) / sum(qty)::double, 4) as avg_hold_ms, max(hold_ms) as max_hold_ms, min(hold_ms) filter (run >= total * 0.25) as p25_hold_ms,
min(hold_ms) filter (run >= total * 0.5) as p50_hold_ms, min(hold_ms) filter (run >= total * 0.75) as p75_hold_ms, min(hold_ms) filter (run >= total * 0.9) as p90_hold_ms from c group by 1""")
def f4_lot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = P.lot_summary(_lots(spark, sf_dir)).drop("net_pnl")
    return got.withColumns({c: F.round(c, 4) for c in ("fees", "inventory_pnl", "avg_hold_ms")})


@query("""with i as (select *, sum(qty) over (partition by session_id, side order by time_ms, seq rows unbounded preceding) as hi from fills),
t as (select session_id, least(sum(qty) filter (side = 'buy'), sum(qty) filter (side = 'sell')) as m from fills group by 1)
select i.session_id, fill_id, side, (hi - greatest(hi - qty, m))::bigint as open_qty from i join t using (session_id) where hi - greatest(hi - qty, m) > 0""")
def l3_open_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.open_lots(view(spark, sf_dir, "fills")).select("session_id", "fill_id", "side", "open_qty")


@query(f"""with {QL}, {PNL}, {LOTS}, {MARKOUTS},
cost as (select session_id, horizon_ms, -sum(markout * qty) as adv from m group by 1, 2),
px as (select l.session_id, m.horizon_ms, sum(l.qty) as covered, sum(m.markout * l.qty - l.open_spread) as proxy from lots l join m on l.session_id = m.session_id and l.open_fill_id = m.fill_id
       where l.open_spread is not null group by 1, 2)
select c.session_id, c.horizon_ms, coalesce(covered, 0)::bigint as covered_qty, round(coalesce(proxy, 0), 4) as proxy_inventory_pnl,
round(spread_capture + coalesce(proxy, 0) - fees, 4) as proxy_net_pnl, round(spread_capture + coalesce(proxy, 0) - gross, 4) as net_error, round(adv, 4) as adverse_selection
from cost c left join px using (session_id, horizon_ms) join pl using (session_id)""")
def l4_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills, quotes = view(spark, sf_dir, "fills"), view(spark, sf_dir, "quotes")
    got = P.reconciliation(_lots(spark, sf_dir), P.markouts(fills, quotes, H), P.pnl(fills, quotes, 2, 5))
    return got.withColumns({c: F.round(c, 4) for c in ("proxy_inventory_pnl", "proxy_net_pnl", "net_error", "adverse_selection")})


@query(f"""with {QL}, f as (select *, time_ms - {MIN30} as placed_ms from fills),
p as (select f.*, g.mid as pm from f asof left join ql g on f.session_id = g.session_id and f.placed_ms >= g.time_ms),
x as (select p.*, g.mid as fm, g.bid, g.ask, case side when 'buy' then 1 else -1 end as sgn from p asof left join ql g on p.session_id = g.session_id and p.time_ms >= g.time_ms),
vol as (select f.fill_id, case when count(q.mid) >= 2 then round(round(stddev_samp(q.mid) / avg(q.mid) * 10000, 6), 3) end as vol_bps from f left join q on f.session_id = q.session_id
        and q.time_ms between f.time_ms - {HOUR} and f.time_ms group by 1)
select x.fill_id, pm as mid_at_placed, fm as mid_at_fill, round(sgn * (pm - price) / pm * 10000, 6) as distance_bps, round(sgn * (fm - price) / fm * 10000, 6) as edge_bps,
round(sgn * (fm - pm) / pm * 10000, 6) as move_bps, vol_bps, case when bid is null then 'unknown' when side = 'buy' then
case when price >= ask then 'crossed' when price > bid then 'inside_spread' when price = bid then 'at_best' else 'behind_best' end
else case when price <= bid then 'crossed' when price < ask then 'inside_spread' when price = ask then 'at_best' else 'behind_best' end end as position
from x join vol using (fill_id)""")
def l5_pre_fill_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = view(spark, sf_dir, "fills").withColumn("order_id", F.col("fill_id"))
    placed = fills.select("session_id", "order_id", (F.col("time_ms") - MIN30).alias("placed_ms"))
    got = P.pre_fill_drift(fills, placed, view(spark, sf_dir, "quotes"), HOUR)
    got = got.select("fill_id", "mid_at_placed", "mid_at_fill", "distance_bps", "edge_bps", "move_bps", "vol_bps", "position")
    return r6(got, "distance_bps", "edge_bps", "move_bps").withColumn("vol_bps", F.round("vol_bps", 3))
