"""Queries: report tables, audits, verdicts and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import view
from ..operators import gates as G
from ..operators import pnl as P
from ..operators import reports as R
from ..operators import streams as S
from ..operators import windows as W
from ..registry import query
from .signals_q import HOUR, LOTS, PNL, QL, _lots
from .stats_q import DESC, MIDS, _days, _mids
from .streams_q import GAPS, INTEGRITY, _events, _hours


@query("""select session_id, is_maker, count(*) as n_rows, sum(qty)::bigint as qty, round(sum(price * qty) / sum(qty)::double, 6) as mean_price from fills group by 1, 2""")
def f5_f10_run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = R.run_table(view(spark, sf_dir, "fills"), ["session_id", "is_maker"], ["qty"], [("price", "qty")])
    return got.withColumn("mean_price", F.round("mean_price", 6))


@query(f"""with {QL}, {PNL}, {LOTS} select session_id, case when count(open_spread) = count(*) then round(sum(open_spread), 4) end as open_spread, round(sum(realized_pnl)::double, 4) as realized_pnl from lots group by 1""")
def f11_strict_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = R.strict_totals(_lots(spark, sf_dir), ["session_id"], ["open_spread", "realized_pnl"])
    return got.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("open_spread", "realized_pnl")})


@query("""select is_maker, count(distinct case when side = 'buy' then (session_id, order_id) end) as n_buy, count(distinct case when side = 'sell' then (session_id, order_id) end) as n_sell from fills group by 1""")
def f18_side_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.side_counts(view(spark, sf_dir, "fills"), ["is_maker"], ["session_id", "order_id"])


@query("select session_id, fill_id, qty, price from fills")
def f19_unique_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = view(spark, sf_dir, "fills")
    return R.unique_fills(P.fifo_lots(fills, None, 2, 5), P.open_lots(fills), ["session_id"]).select("session_id", "fill_id", "qty", "price")


@query("""with f as (select fill_id, session_id, time_ms // 60000 as m, side, price // 20000 as p from fills),
t as (select session_id, time_ms // 60000 as m, case when is_buyer_maker then 'buy' else 'sell' end as side, price // 20000 as p, sum(qty) as q from trades group by 1, 2, 3, 4),
j as (select f.*, coalesce(q, 0) as q from f left join t on f.session_id = t.session_id and f.m = t.m and f.side = t.side and f.p = t.p)
select session_id, count(*) as n_fills, count_if(q > 0)::bigint as n_shared, round(count_if(q > 0) * 100.0 / count(*), 6) as pct_shared from j group by 1""")
def d11_f20_same_time_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = {"time_ms": F.expr("time_ms div 60000"), "price": F.expr("price div 20000")}
    rows = R.same_time_trades(view(spark, sf_dir, "fills").withColumns(coarse), view(spark, sf_dir, "trades").withColumns(coarse), ["session_id"])
    return R.audit_rollup(rows, ["session_id"]).withColumn("pct_shared", F.round("pct_shared", 6))


@query("""select session_id, (coalesce(sum(qty) filter (not is_maker), 0) - coalesce(sum(qty) filter (is_maker), 0))::bigint as qty_delta, coalesce(sum(qty) filter (not is_maker), 0) = coalesce(sum(qty) filter (is_maker), 0) as exact_zero from fills group by 1""")
def f21_policy_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fills").withColumn("policy", F.when(F.col("is_maker"), "old").otherwise("new"))
    return R.policy_delta(rows, "session_id", "policy", "old", "new", ["qty"])


@query("""select session_id, round(sum(qty) filter (side = 'sell') / sum(qty) filter (side = 'buy')::double, 6) as qty_ratio from fills group by 1""")
def d13_mode_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = R.mode_ratios(view(spark, sf_dir, "fills"), "session_id", "side", "buy", "sell", ["qty"])
    return got.withColumn("qty_ratio", F.round("qty_ratio", 6))


@query(f"""with {QL}, {PNL}, s as (select session_id, count(*) as n_quotes from quotes group by 1), t as (select session_id, sum(qty)::bigint as traded from trades group by 1)
select session_id, n_fills, n_quotes, traded from pl left join s using (session_id) left join t using (session_id)""")
def d14_regime_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = P.pnl(view(spark, sf_dir, "fills"), view(spark, sf_dir, "quotes"), 2, 5).select("session_id", "n_fills")
    n = view(spark, sf_dir, "quotes").groupBy("session_id").agg(F.count("*").alias("n_quotes"))
    t = view(spark, sf_dir, "trades").groupBy("session_id").agg(F.sum("qty").alias("traded"))
    return R.wide(base, "session_id", n, t)


@query(f"""with {INTEGRITY}, w as (select hour_ms as start_ms, hour_ms + {5 * HOUR} as end_ms from hv where (hour_ms // {HOUR}) % 3 = 0), t as (select hour_ms as lo, hour_ms + {2 * HOUR} as hi from hv where (hour_ms // {HOUR}) % 24 = 7)
select start_ms, end_ms from w where not exists (select 1 from t where w.start_ms < t.hi and t.lo < w.end_ms)""")
def d16_windows_without_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hours(spark, sf_dir).withColumn("no", F.expr(f"hour_ms div {HOUR}"))
    w = h.filter("no % 3 = 0").select(F.col("hour_ms").alias("start_ms"), (F.col("hour_ms") + 5 * HOUR).alias("end_ms"))
    t = h.filter("no % 24 = 7").select(F.col("hour_ms").alias("start_ms"), (F.col("hour_ms") + 2 * HOUR).alias("end_ms"))
    return R.without_overlap(w, t, 6 * HOUR)


@query("select session_id, count(*) as n from quotes where session_id in (0, 2) group by 1")
def d17_allowed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "quotes").groupBy("session_id").agg(F.count("*").alias("n"))
    return R.one_to_one(rows, spark.createDataFrame([(0,), (2,)], "session_id long"), "session_id")


@query("select order_id, count(*) as n from fills group by 1 having count(*) > 1")
def i4_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicates(view(spark, sf_dir, "fills"), ["order_id"])


@query("""with b as (select distinct order_id from fills where side = 'buy'), s as (select distinct order_id from fills where side = 'sell')
select order_id, 'left' as only_in from b where order_id not in (select order_id from s) union all select order_id, 'right' from s where order_id not in (select order_id from b)""")
def i3_key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "fills")
    return R.key_difference(f.filter("side = 'buy'"), f.filter("side = 'sell'"), "order_id")


@query("""select session_id, time_ms // 1000 as s from quotes intersect select session_id, time_ms // 1000 from trades""")
def i2_shared_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    def secs(n: str) -> DataFrame:
        return view(spark, sf_dir, n).select("session_id", F.expr("time_ms div 1000").alias("s"))

    return secs("quotes").intersect(secs("trades"))


@query(f"""with {INTEGRITY}, v as (select hour_ms, hour_ms - row_number() over (order by hour_ms) * {HOUR} as g from hv where n_depth >= 12), r as (select min(hour_ms) as first_ms, max(hour_ms) as last_ms, count(*) as n_hours from v group by g)
select count(*) as n_ranges, sum(n_hours)::bigint as n_hours, max(n_hours) as longest, min(first_ms) as first_ms, max(last_ms) as last_ms from r having count(*) > 0""")
def f25_range_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = _hours(spark, sf_dir).withColumn("valid", F.col("n_depth") >= 12)
    return R.range_summary(R.valid_ranges(hours, []), []).filter("n_ranges > 0")


@query(f"""with {GAPS} select session_id, seq from ev4 where kind = 0 and not censored and (event_type = 'snapshot' or (event_type = 'diff' and not in_gap))""")
def p2_book_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.book_mutations(S.gap_state(_events(spark, sf_dir))).select("session_id", "seq")


@query(f"""with {QL}, {PNL}, x as (select session_id, gross - fees as m, gross - fees - 1000 as lo, gross - fees + (session_id - 1) * 2000 as hi, (session_id - 2) * 500.0 as old from pl)
select session_id, case when lo > 0 then 'Overturns V1' when hi < 0 then 'Strengthens V1' when m - old >= abs(old) * 0.25 then 'Weakens V1' else 'Confirms V1' end as verdict,
case when lo > 0 then 'above_zero' when hi < 0 then 'below_zero' else 'contains_zero' end as relation, case when m <= 0 then 'fail' when m >= old and session_id > 0 then 'pass' else 'mixed' end as status from x""")
def l19_l21_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = P.pnl(view(spark, sf_dir, "fills"), view(spark, sf_dir, "quotes"), 2, 5).select(
        "session_id", F.col("net_pnl").alias("m"), (F.col("net_pnl") - 1000).alias("lo"), (F.col("net_pnl") + (F.col("session_id") - 1) * 2000).alias("hi"), ((F.col("session_id") - 2) * 500.0).alias("old")
    )
    lo, hi, m, old = (F.col(c) for c in ("lo", "hi", "m", "old"))
    return x.select("session_id", G.verdict_ladder(m, lo, hi, old).alias("verdict"), G.ci_relation(lo, hi).alias("relation"), G.holdout_status(m, old, F.col("session_id") > 0).alias("status"))


@query("""with s as (select session_id, count_if(qty = 0)::bigint as z, sum(qty) filter (side = 'sell') / sum(qty) filter (side = 'buy')::double as r, count(*) / count(distinct order_id)::double as o from fills group by 1)
select session_id, r < 0.5 as far_fewer_fills, o > 1.5 as worse_orders_per_fill, r - 1 < 0 as stable_negative from s""")
def l24_queue_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "fills")
    s = R.mode_ratios(f, "session_id", "side", "buy", "sell", ["qty"]).join(f.groupBy("session_id").agg((F.count("*") / F.countDistinct("order_id")).alias("o")), "session_id")
    return s.select("session_id", *G.queue_flags(F.col("qty_ratio"), F.col("o"), F.col("qty_ratio") - 1))


@query(f"""{MIDS}, st as (select distinct session_id, time_ms // 86400000 * 86400000 as start_ms from mids), w as (select st.session_id, st.start_ms, m.time_ms, m.mid from st join mids m on m.session_id = st.session_id
and m.time_ms >= st.start_ms and m.time_ms < st.start_ms + {36 * HOUR}), r as (select *, (mid - lag(mid) over x) / lag(mid) over x * 10000 as r1 from w window x as (partition by session_id, start_ms order by time_ms))
select session_id, start_ms, count(*) as n, round((arg_max(mid, time_ms) - arg_min(mid, time_ms)) / arg_min(mid, time_ms) * 10000, 4) as drift_bps, round(sqrt(avg(r1 * r1)), 4) as vol_1_bps from r group by 1, 2 having count(*) >= 2""")
def l25_overlapping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    mids = _mids(spark, sf_dir)
    starts = mids.select("session_id", (F.floor(F.col("time_ms") / (24 * HOUR)) * 24 * HOUR).cast("long").alias("hour_ms")).distinct()
    got = W.describe(W.window_mids(mids, starts, 36, ["session_id"]), ["session_id", "start_ms"], (1,))
    return got.select("session_id", "start_ms", "n", F.round("drift_bps", 4).alias("drift_bps"), F.round("vol_1_bps", 4).alias("vol_1_bps"))


@query(f"""{MIDS}, {DESC}, h as (select (start_ms // {HOUR}) % 24 as hr, jumps from de) select case when hr < 7 then '00-06' when hr < 13 then '07-12' when hr < 17 then '13-16' else '17-23' end as utc_bucket, count(*) as n, sum(jumps)::bigint as jumps from h group by 1""")
def p10_utc_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = W.with_start_bucket(_days(spark, sf_dir))
    return d.groupBy("utc_bucket").agg(F.count("*").alias("n"), F.sum("jump_count").alias("jumps"))
