"""Queries: regressions, tails, clusters, fee break-even, gates, windows and bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import view
from ..operators import bars as A
from ..operators import gates as G
from ..operators import pnl as P
from ..operators import signals as S
from ..operators import stats as T
from ..operators import windows as W
from ..operators.asof import asof, grid
from ..registry import query
from .signals_q import EDGES, LOTS, MARKOUTS, OFI, OFI_POINTS, PNL, QL, HOUR, MIN30, H, _lots, _samples, _toxicity, r6, signed

COMMON = ("n", "x_mean", "y_mean", "alpha", "beta", "r2")


@query(f"""with {QL}, {OFI}, {OFI_POINTS} select session_id, horizon_ms, count(*) as n, round(regr_slope(drift_bps, normalized_ofi), 4) as beta,
round(regr_intercept(drift_bps, normalized_ofi), 2) as alpha, round(regr_r2(drift_bps, normalized_ofi), 6) as r2 from s0 group by 1, 2""")
def l11_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = T.ols(_samples(spark, sf_dir), "normalized_ofi", "drift_bps", ["session_id", "horizon_ms"])
    return got.select("session_id", "horizon_ms", "n", F.round("beta", 4).alias("beta"), F.round("alpha", 2).alias("alpha"), F.round("r2", 6).alias("r2"))


@query(f"""with {QL}, {OFI}, {OFI_POINTS}, z as (select session_id, normalized_ofi as x, drift_bps as y, row_number() over (partition by session_id order by time_ms) as t from s0 where horizon_ms = {MIN30}),
f as (select session_id, count(*) as n, avg(x) as mx, regr_slope(y, x) as b, regr_intercept(y, x) as a, regr_sxx(y, x) as sxx from z group by 1),
l as (select *, least(n - 1, greatest(1, 1, floor(4 * pow(n / 100.0, 2.0 / 9)))) as lags from f),
u as (select z.session_id, t, (y - a - b * x) * (x - mx) as s, lags from z join l using (session_id)),
nw as (select p.session_id, sum(p.s * q.s * (1 - (p.t - q.t) / (p.lags + 1)) * case when p.t = q.t then 1 else 2 end) as meat from u p join u q on p.session_id = q.session_id and p.t - q.t between 0 and p.lags group by 1)
select session_id, n, lags::bigint as lags, round(b / (sqrt(meat) / sxx), 4) as t_stat from l join nw using (session_id)""")
def l12_newey_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).filter(F.col("horizon_ms") == MIN30)
    got = T.ols_hac(rows, "normalized_ofi", "drift_bps", ["session_id", "horizon_ms"], ["time_ms"], MIN30)
    return got.select("session_id", "n", "lags", F.round("t_stat", 4).alias("t_stat"))


@query(f"""with {QL}, {OFI}, {OFI_POINTS}, z as (select session_id::varchar as win, horizon_ms, normalized_ofi as x, drift_bps as y, row_number() over (partition by session_id, horizon_ms order by time_ms) as t from s0
union all select 'pooled', horizon_ms, normalized_ofi, drift_bps, row_number() over (partition by horizon_ms order by session_id, time_ms) from s0),
f as (select win, horizon_ms, count(*) as n, avg(x) as mx, regr_slope(y, x) as b, regr_intercept(y, x) as a, regr_r2(y, x) as r2, regr_sxx(y, x) as sxx from z group by 1, 2),
l as (select *, least(n - 1, greatest(1, ceil(horizon_ms / {MIN30}::double), floor(4 * pow(n / 100.0, 2.0 / 9)))) as lags from f),
u as (select z.win, z.horizon_ms, t, (y - a - b * x) * (x - mx) as s, lags from z join l using (win, horizon_ms)),
nw as (select p.win, p.horizon_ms, sum(p.s * q.s * (1 - (p.t - q.t) / (p.lags + 1)) * case when p.t = q.t then 1 else 2 end) as meat from u p join u q on p.win = q.win and p.horizon_ms = q.horizon_ms and p.t - q.t between 0 and p.lags group by 1, 2)
select win as "window", horizon_ms, n, round(b, 4) as beta, round(a, 2) as alpha, round(r2, 6) as r2, lags::bigint as lags, round(b / (sqrt(meat) / sxx), 4) as t_stat, round(b * sqrt(sxx / (n - 1)), 4) as drift_1std
from l join nw using (win, horizon_ms)""")
def l13_pooled_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window and pooled; the pooled one runs on across windows in their order."""
    rows = _samples(spark, sf_dir).withColumn("window", F.col("session_id").cast("string"))
    both = rows.unionByName(rows.withColumn("window", F.lit("pooled")))
    got = T.ols_hac(both, "normalized_ofi", "drift_bps", ["window", "horizon_ms"], ["session_id", "time_ms"], MIN30)
    rounded = {"beta": 4, "alpha": 2, "r2": 6, "t_stat": 4, "drift_1std": 4}
    return got.select("window", "horizon_ms", "n", "lags", *[F.round(c, d).alias(c) for c, d in rounded.items()])


@query()
def l14_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = P.markouts(view(spark, sf_dir, "fills").filter("price <> 0"), view(spark, sf_dir, "quotes"), H)
    per = marks.groupBy("session_id", "horizon_ms").agg(F.avg("markout_bps").alias("m"))
    return T.bootstrap_mean(per, "m", ["horizon_ms"], ["session_id"])


@query()
def l15_cluster_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _toxicity(spark, sf_dir).filter(F.col("horizon_ms") == MIN30).withColumn("g", F.when(F.col("side_aligned") < 0, "low").otherwise("high"))
    return T.cluster_contrast(rows, "session_id", "g", "move_bps", "low", "high")


@query()
def l16_ofi_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).filter(F.col("horizon_ms") == MIN30).withColumn("all", F.lit(0))
    windows = T.ols(rows, "normalized_ofi", "drift_bps", ["session_id"])
    pooled = T.ols_hac(rows, "normalized_ofi", "drift_bps", ["all", "horizon_ms"], ["session_id", "time_ms"], MIN30)
    buckets = S.bucketed(S.by_side(_toxicity(spark, sf_dir)), ["horizon_ms", "side"], "side_aligned", "move_bps", EDGES)
    return G.ofi_gate(windows, pooled, G.conditional_separation(buckets, MIN30))


MK = f"with {QL}, {MARKOUTS}, mk as (select *, round(markout / price * 10000, 6) as mbps from m where horizon_ms = {MIN30})"


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = P.markouts(view(spark, sf_dir, "fills"), view(spark, sf_dir, "quotes"), [MIN30])
    return r6(got, "markout_bps")


@query(f"""{MK} select session_id, count(mbps) as n, round(avg(mbps), 4) as mean, round(median(mbps), 4) as median, round(quantile_cont(mbps, 0.05), 4) as p05, round(quantile_cont(mbps, 0.99), 4) as p99,
round(sum(mbps), 3) as metric_sum, round(coalesce(sum(mbps) filter (mbps < 0), 0), 3) as negative_sum from mk group by 1""")
def f13_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.distribution(_marks(spark, sf_dir), "markout_bps", ["session_id"])
    return d.select("session_id", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "p05", "p99")], *[F.round(c, 3).alias(c) for c in ("metric_sum", "negative_sum")])


@query(f"""{MK}, r as (select fill_id, row_number() over (order by mbps, fill_id) as pooled_tail_rank, count(*) over () as n from mk)
select fill_id, pooled_tail_rank, pooled_tail_rank <= greatest(1, round(n * 0.01::decimal(9,6))) as is_pooled_tail_1pct, pooled_tail_rank <= greatest(1, round(n * 0.05::decimal(9,6))) as is_pooled_tail_5pct from r""")
def g5_tail_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = T.tail_flags(_marks(spark, sf_dir), "markout_bps", ["fill_id"])
    return got.select("fill_id", "pooled_tail_rank", "is_pooled_tail_1pct", "is_pooled_tail_5pct")


@query(f"""{MK}, r as (select session_id, fill_id, row_number() over (partition by session_id order by mbps, fill_id) as rk, count(*) over (partition by session_id) as n from mk)
select fill_id, rk as window_tail_rank, rk <= greatest(1, round(n * 0.05::decimal(9,6))) as is_window_tail_5pct from r""")
def g5_tail_flags_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = T.tail_flags(_marks(spark, sf_dir), "markout_bps", ["fill_id"], ["session_id"], ["0.05"], "window")
    return got.select("fill_id", "window_tail_rank", "is_window_tail_5pct")


@query(f"""{MK}, r as (select mbps, row_number() over (order by mbps, fill_id) as rk, count(*) over () as n, sum(mbps) over () as tot, sum(case when mbps < 0 then mbps else 0 end) over () as neg from mk),
k as (select * from (values ('1pct', 0.01::decimal(9,6)), ('5pct', 0.05::decimal(9,6))) t(tail_label, f))
select tail_label, count(*) as tail_n, round(sum(mbps), 3) as tail_sum, round(sum(mbps) / any_value(tot), 6) as share_of_total, round(sum(mbps) / any_value(neg), 6) as share_of_negative
from r, k where rk <= greatest(1, round(n * f)) group by 1""")
def f14_tail_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = T.tail_shares(_marks(spark, sf_dir), "markout_bps", ["fill_id"])
    return got.select("tail_label", "tail_n", F.round("tail_sum", 3).alias("tail_sum"), signed("share_of_total"), signed("share_of_negative"))


CLUSTERS = f"""{MK}, c0 as (select *, coalesce(time_ms - lag(time_ms) over (partition by session_id order by time_ms, fill_id) > {HOUR}, true) as apart from mk where mbps < 0),
c1 as (select *, sum(case when apart then 1 else 0 end) over (partition by session_id order by time_ms, fill_id rows unbounded preceding) as cluster_no from c0),
cl as (select session_id, cluster_no::bigint as cluster_no, count(*) as "rows", min(time_ms) as start_ms, max(time_ms) as end_ms, sum(mbps) as ms, min(mbps) as min_metric,
       arg_min(fill_id, fill_id) as first_row_id, max(fill_id) as last_row_id from c1 group by 1, 2)"""


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.clusters(_marks(spark, sf_dir).filter("markout_bps < 0"), "markout_bps", HOUR, ["session_id"])


@query(f"""{CLUSTERS}, bo as (select * from (values (0, 'Tokyo', 0), (1, 'Singapore/Hong Kong', 60), (2, 'London', 420), (3, 'US cash open', 810), (4, 'US cash close', 1200)) t(ord, name, mins)),
d as (select unnest([-1, 0, 1]) as shift), x as (select cl.*, ord, name, start_ms - (start_ms // 86400000 * 86400000 + shift * 86400000 + mins * 60000) as delta from cl, bo, d)
select session_id, cluster_no, "rows", start_ms, end_ms, round(ms, 4) as metric_sum, min_metric, first_row_id, last_row_id, name as boundary, delta as boundary_delta_ms, abs(delta) <= 1800000 as near_boundary from x
qualify row_number() over (partition by session_id, cluster_no order by abs(delta), case when delta >= 0 then 0 else 1 end, ord) = 1""")
def g7_e10_tail_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _clusters(spark, sf_dir).withColumn("metric_sum", F.round("metric_sum", 4))
    return got.select("session_id", "cluster_no", "rows", "start_ms", "end_ms", "metric_sum", "min_metric", "first_row_id", "last_row_id", "boundary", "boundary_delta_ms", "near_boundary")


@query(f"""{CLUSTERS} select session_id, count(*) as n_clusters, sum("rows")::bigint as n_rows, max("rows") as largest_rows, arg_min(cluster_no, ("rows" * -1000000 + cluster_no)) as largest_cluster from cl group by 1""")
def l23_cluster_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cluster_rollup(_clusters(spark, sf_dir), ["session_id"]).select("session_id", "n_clusters", "n_rows", "largest_rows", "largest_cluster")


FE = "(0.0, 0.5, 2.0, 5.0)"


@query(f"""{MK}, c as (select f.fill_id, f.qty::double as v, f.fill_id % 3 <> 0 as filled, mk.mbps from fills f left join mk on mk.fill_id = f.fill_id),
b as (select * from (values (0, '[0,2)u', 0.0, 2.0), (1, '[2,4)u', 2.0, 4.0), (2, '[4,8)u', 4.0, 8.0), (3, '[8,20)u', 8.0, 20.0), (4, '[20,inf)u', 20.0, 1e300)) t(bin, label, lo, hi))
select bin, label, count(c.fill_id) as n_orders, count(c.fill_id) filter (filled) as n_filled, coalesce(round(count(c.fill_id) filter (filled) / nullif(count(c.fill_id), 0)::double, 6), 0) as fill_rate,
round(avg(mbps) filter (filled), 4) as avg_markout_bps, round(median(mbps) filter (filled), 4) as median_markout_bps from b left join c on c.v >= lo and c.v < hi group by 1, 2""")
def f8_fill_rate_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = view(spark, sf_dir, "fills").select("fill_id", F.col("qty").cast("double").alias("v"), (F.col("fill_id") % 3 != 0).alias("filled"))
    contexts = fills.join(_marks(spark, sf_dir).select("fill_id", "markout_bps"), "fill_id", "left")
    got = T.fill_rate_bins(contexts, "v", [0, 2, 4, 8, 20], "u")
    return got.select("bin", "label", "n_orders", "n_filled", F.round("fill_rate", 6).alias("fill_rate"), F.round("avg_markout_bps", 4).alias("avg_markout_bps"), F.round("median_markout_bps", 4).alias("median_markout_bps"))


@query("""with g as (select case when grouping(session_id) = 1 then 'pooled' else cast(session_id as varchar) end as "window", count(*) as n, sum(qty)::bigint as qty, count(distinct case when side = 'buy' then fill_id end) as n_buy,
count_if(is_maker)::bigint as n_maker from fills group by grouping sets ((session_id), ())) select * from g""")
def f12_pooled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = view(spark, sf_dir, "fills").withColumnRenamed("session_id", "window")
    aggs = [F.count("*").alias("n"), F.sum("qty").alias("qty"), F.countDistinct(F.when(F.col("side") == "buy", F.col("fill_id"))).alias("n_buy"), F.count_if("is_maker").alias("n_maker")]
    return T.pooled_and_each(fills, "window", aggs)


@query(f"""with {QL}, {PNL}, {LOTS}, lx as (select l.*, l.realized_pnl - fees as net, c.time_ms as close_ms from lots l join fills c on c.fill_id = l.close_fill_id),
o as (select *, row_number() over (partition by session_id order by net / qty::double, close_ms, open_fill_id, close_fill_id) as rk, count(*) over (partition by session_id) as n from lx),
p as (select *, greatest(1, round(n * 0.05::decimal(9,6))) as k from o),
t as (select 'full_matched_lots' as row_type, * from p union all select 'ex_worst_5pct', * from p where rk > k union all select 'body_only', * from p where rk > k and rk <= n - k)
select session_id, row_type, count(*) as lot_count, sum(qty)::bigint as quantity, round(sum(net), 3) as net_pnl, sum(realized_pnl)::bigint as gross, round(sum(realized_pnl) / (sum(fees) / 0.0002) * 10000, 6) as break_even_bps,
round(greatest(0, -sum(realized_pnl) / (sum(fees) / 0.0002) * 10000), 6) as required_rebate_bps from t group by 1, 2""")
def l22_fee_break_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = T.fee_break_even(_lots(spark, sf_dir), ["session_id"], 2)
    return got.select("session_id", "row_type", "lot_count", "quantity", F.round("net_pnl", 3).alias("net_pnl"), "gross", F.round("break_even_bps", 6).alias("break_even_bps"), F.round("required_rebate_bps", 6).alias("required_rebate_bps"))


@query("""with s as (select count(open) as n, avg(close) as mean, stddev_samp(close) as std, skewness(close) as skew, kurtosis(close) as kurt from bars)
select n, round(mean, 2) as mean, round(std, 2) as std, round(skew, 5) as skew, round(kurt, 5) as kurtosis from s""")
def f26_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = T.moments(view(spark, sf_dir, "bars"), "close")
    return got.select("n", F.round("mean", 2).alias("mean"), F.round("std", 2).alias("std"), F.round("skew", 5).alias("skew"), F.round("kurtosis", 5).alias("kurtosis"))


DAY = 86_400_000
MIDS = f"""with {QL}, {{g}}""".replace("{g}", f"""
ge as (select session_id, min(time_ms) as lo, max(time_ms) as hi from quotes group by 1),
gp as (select session_id, unnest(range((lo + {HOUR} - 1) // {HOUR} * {HOUR}, hi + 1, {HOUR}))::bigint as time_ms from ge),
mids as (select gp.session_id, gp.time_ms, q.mid from gp asof join ql q on gp.session_id = q.session_id and gp.time_ms >= q.time_ms)""").replace("{", "").replace("}", "")
DESC = """dd as (select session_id, time_ms // 86400000 * 86400000 as start_ms, time_ms, mid from mids),
dr as (select *, (mid - lag(mid, 1) over w) / lag(mid, 1) over w * 10000 as r1, (mid - lag(mid, 6) over w) / lag(mid, 6) over w * 10000 as r6 from dd window w as (partition by session_id, start_ms order by time_ms)),
de as (select session_id, start_ms, count(*) as n, (arg_max(mid, time_ms) - arg_min(mid, time_ms)) / arg_min(mid, time_ms) * 10000 as drift, sqrt(avg(r1 * r1)) as v1, coalesce(sqrt(avg(r6 * r6)), 0) as v6,
       count_if(abs(r1) > 20000)::bigint as jumps from dr group by 1, 2 having count(*) >= 2)"""


def _mids(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = S.with_mid(view(spark, sf_dir, "quotes"))
    return asof(grid(quotes, S.BY, HOUR), quotes, S.BY, ["mid"], prefix="").filter("mid is not null")


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    mids = _mids(spark, sf_dir).withColumn("start_ms", (F.floor(F.col("time_ms") / DAY) * DAY).cast("long"))
    return W.describe(mids, ["session_id", "start_ms"], (1, 6), 20_000)


@query(f"""{MIDS}, {DESC} select session_id, start_ms, n, round(drift, 4) as drift_bps, round(abs(drift), 4) as abs_drift_bps, round(v1, 4) as vol_1_bps, round(v6, 4) as vol_6_bps, jumps as jump_count from de""")
def f22_window_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).withColumns({c: F.round(c, 4) for c in ("drift_bps", "abs_drift_bps", "vol_1_bps", "vol_6_bps")})


@query(f"""{MIDS}, r as (select (mid - lag(mid) over w) / lag(mid) over w * 10000 as r from mids window w as (partition by session_id order by time_ms)) select round(quantile_cont(abs(r), 0.99), 4) as threshold_bps from r""")
def f23_jump_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.jump_threshold(W.lag_returns(_mids(spark, sf_dir), 1, ["session_id"])).select(F.round("threshold_bps", 4).alias("threshold_bps"))


@query(f"""{MIDS}, {DESC} select session_id, start_ms, case ntile(3) over (partition by session_id order by round(v1, 6), start_ms) when 1 then 'low' when 2 then 'mid' else 'high' end as tercile from de""")
def g6_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir).withColumn("vol_1_bps", F.round("vol_1_bps", 6))
    return W.terciles(days, by=S.BY).select("session_id", "start_ms", "tercile")


@query(f"""{MIDS}, {DESC}, v as (select session_id, unnest([{{'d': 'drift_bps', 'v': drift}}, {{'d': 'vol_1_bps', 'v': v1}}]) as x from de),
s as (select x.d as descriptor, quantile_cont(x.v, 0.1) filter (session_id < 2) as p10, quantile_cont(x.v, 0.9) filter (session_id < 2) as p90, median(x.v) filter (session_id >= 2) as hm,
avg(x.v) filter (session_id < 2) as md, avg(x.v) filter (session_id >= 2) as mh, var_pop(x.v) filter (session_id < 2) as vd, var_pop(x.v) filter (session_id >= 2) as vh from v group by 1)
select descriptor, round(p10, 4) as p10, round(p90, 4) as p90, round(hm, 4) as holdout_median, round((mh - md) / sqrt((vd + vh) / 2), 6) as smd, p10 <= hm and hm <= p90 as in_band, abs((mh - md) / sqrt((vd + vh) / 2)) <= 0.5 as smd_within from s""")
def f24_regime_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _days(spark, sf_dir)
    got = W.compare_regimes(d.filter("session_id < 2"), d.filter("session_id >= 2"), ["drift_bps", "vol_1_bps"])
    return got.select("descriptor", *[F.round(c, 4).alias(c) for c in ("p10", "p90", "holdout_median")], F.round("smd", 6).alias("smd"), "in_band", "smd_within")


@query()
def h5_balanced_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = W.with_start_bucket(W.terciles(_days(spark, sf_dir), by=S.BY))
    d = d.withColumn("end_ms", F.col("start_ms") + 5 * HOUR)
    return W.select_balanced(d, [], 8, S.BY)


@query(f"""{MIDS}, {DESC}, m as (select session_id, min(start_ms) as lo from de group by 1) select session_id, count(distinct (start_ms - lo) // {3 * DAY}) as capacity from de join m using (session_id) group by 1""")
def g14_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _days(spark, sf_dir).withColumn("end_ms", F.col("start_ms") + 3 * DAY)
    return W.capacity(d, by=S.BY)


@query(f"""with {QL}, {PNL} select session_id, case when gross - fees >= 0 then 'not_loss_window' when gross - spread_capture < 0 and spread_capture < 0 then 'matched_and_residual_loss' when gross - spread_capture < 0 then 'residual_inventory_loss'
when spread_capture < 0 then 'matched_loss' else 'other_loss' end as loss_source from pl""")
def e11_loss_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalar import loss_source

    got = P.pnl(view(spark, sf_dir, "fills"), view(spark, sf_dir, "quotes"), 2, 5)
    return got.select("session_id", loss_source(F.col("net_pnl"), F.col("spread_capture"), F.col("inventory_pnl")).alias("loss_source"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills, quotes = view(spark, sf_dir, "fills"), view(spark, sf_dir, "quotes")

    def side(even: int) -> DataFrame:
        f = fills.filter(F.col("fill_id") % 2 == even)
        p = P.pnl(f, quotes, 2, 5).select(F.col("session_id").alias("window"), "n_fills", "net_pnl", F.col("position").alias("residual"))
        m = f.groupBy(F.col("session_id").alias("window")).agg(F.count_if("is_maker").alias("maker_fills"))
        lots = P.fifo_lots(f, None, 2, 5).groupBy(F.col("session_id").alias("window")).agg(F.sum("qty").alias("matched_qty"), F.sum("net_pnl").alias("matched_net"))
        return p.join(m, "window").join(lots, "window").withColumnRenamed("n_fills", "fills")

    return G.paired_windows(side(0), side(1))


@query()
def l18_strategy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    delta = pairs.select(F.lit(0).alias("one"), "window", (F.col("matched_net_c") / F.col("matched_qty_c") - F.col("matched_net_b") / F.col("matched_qty_b")).alias("delta"))
    ci = T.bootstrap_mean(delta, "delta", ["one"], ["window"]).first()
    return G.strategy_gate(pairs, ci["ci_low"])


# --- bars ---

RUNS = [A.Run("momentum", 24, 0.02), A.Run("mean_reversion", 24, 0.02), A.Run("sma", 12, 48), A.Run("bollinger", 24, 2.0)]


@query("""select count(*) as n_bars, min(day) as first, max(day) as last, min(low) as min_low, max(high) as max_high, cast(sum(volume) as bigint) as volume from bars where day between date '1995-01-01' and date '1996-06-30'""")
def a4_a7_bar_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = view(spark, sf_dir, "bars").filter(F.col("day").between("1995-01-01", "1996-06-30"))
    return A.summary(bars)


SIG = """
b as (select day, close, row_number() over w as no, (close - lag(close, 23) over w) / lag(close, 23) over w as ret, avg(close) over (order by day rows 23 preceding) as m24, stddev_samp(close) over (order by day rows 23 preceding) as s24,
      avg(close) over (order by day rows 11 preceding) as m12, avg(close) over (order by day rows 47 preceding) as m48 from bars window w as (order by day)),
b2 as (select *, m12 - m48 as gap, lag(case when no >= 48 then m12 - m48 end) over (order by day) as pgap from b),
sg as (select day, 'momentum(24,0.02)' as run, case when no >= 24 and ret > 0.02 then 1 when no >= 24 and ret < -0.02 then -1 else 0 end as side from b2
 union all select day, 'mean_reversion(24,0.02)', case when no >= 24 and (close - m24) / m24 < -0.02 then 1 when no >= 24 and (close - m24) / m24 > 0.02 then -1 else 0 end from b2
 union all select day, 'sma(12,48)', case when no >= 48 and pgap <= 0 and gap > 0 then 1 when no >= 48 and pgap >= 0 and gap < 0 then -1 else 0 end from b2
 union all select day, 'bollinger(24,2)', case when no >= 24 and close < m24 - 2 * s24 then 1 when no >= 24 and close > m24 + 2 * s24 then -1 else 0 end from b2)"""


@query(f"with {SIG} select day, run, side from sg")
def g9_g11_bar_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.signals(view(spark, sf_dir, "bars"), RUNS).select("day", "run", "side")


@query(f"""with recursive {SIG}, r as (select sg.*, b.close, row_number() over (partition by sg.run order by sg.day) as i from sg join b using (day)),
p(run, i, day, position) as (select run, 0::bigint, null::date, 0.0::double from (select distinct run from sg)
 union all select p.run, r.i, r.day, case when r.side = 1 and p.position < 1 then p.position + 0.5 when r.side = -1 and p.position > 0 then 0.0 else p.position end from p join r on r.run = p.run and r.i = p.i + 1)
select run, day, position from p where i > 0""")
def m1_backtest_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.backtest(A.signals(view(spark, sf_dir, "bars"), RUNS)).select("run", "day", "position")


@query()
def m5_backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.metrics(A.backtest(A.signals(view(spark, sf_dir, "bars"), RUNS)))


@query("""with d as (select day, close, max(close) over (order by day rows unbounded preceding) as peak from bars) select day, peak, round((close - peak) / peak, 6) as drawdown from d""")
def g12_drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = view(spark, sf_dir, "bars").withColumn("run", F.lit("x"))
    return A.drawdowns(bars, value="close").select("day", "peak", F.round("drawdown", 6).alias("drawdown"))


@query()
def m6_parameter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = [A.Run("sma", f, s) for f in (12, 24, 48) for s in (48, 72, 96, 120) if f < s] + [A.Run("bollinger", p, w) for p in (12, 24, 36, 48) for w in (1.0, 1.5, 2.0, 2.5, 3.0)]
    return A.metrics(A.backtest(A.signals(view(spark, sf_dir, "bars"), runs)))


@query()
def m7_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = [("1992-01-01", f"{y}-12-31", f"{y + 1}-01-01", f"{y + 1}-12-31") for y in (1994, 1995, 1996)]
    tests, _ = A.walk_forward(view(spark, sf_dir, "bars"), RUNS, windows)
    return tests


@query(f"""with {QL}, f as (select *, time_ms - {MIN30} as placed_ms from fills),
p as (select f.*, g.mid as pm from f asof left join ql g on f.session_id = g.session_id and f.placed_ms >= g.time_ms),
x as (select p.*, g.mid as fm, g.bid, g.ask, case side when 'buy' then 1 else -1 end as sgn from p asof left join ql g on p.session_id = g.session_id and p.time_ms >= g.time_ms)
select session_id, count(*) as fills, round(avg(sgn * (pm - price) / pm * 10000), 4) as avg_distance_bps, round(avg(sgn * (fm - price) / fm * 10000), 4) as avg_edge_bps,
round(avg(sgn * (fm - pm) / pm * 10000), 4) as avg_move_bps, round(avg(ask - bid), 4) as avg_spread, round(avg((ask - bid) / fm * 10000), 4) as avg_spread_bps from x group by 1""")
def f17_pre_fill_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = view(spark, sf_dir, "fills").withColumn("order_id", F.col("fill_id"))
    placed = fills.select("session_id", "order_id", (F.col("time_ms") - MIN30).alias("placed_ms"))
    got = P.pre_fill_means(P.pre_fill_drift(fills, placed, view(spark, sf_dir, "quotes"), HOUR))
    return got.withColumns({c: F.round(c, 4) for c in got.columns if c.startswith("avg_")})


@query(f"""with {QL}, {PNL}, {LOTS} select session_id, open_fill_id, close_fill_id, round(realized_pnl - fees, 6) as net_pnl, realized_pnl::bigint as gross_pnl, round(fees, 6) as fees, hold_ms,
round((realized_pnl - fees) / qty, 6) as net_per_unit from lots""")
def f27_lot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(P.lot_records(_lots(spark, sf_dir)), "net_pnl", "fees", "net_per_unit")
