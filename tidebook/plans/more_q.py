"""Queries: records for gates and intervals, sources and sinks, guards and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import view
from ..functions.scalar import hour_label
from ..operators import pnl as P
from ..operators import records as R
from ..operators import stats as T
from ..operators import streams as S
from ..registry import query
from ..shared import new_folder
from ..sources import captures as C
from .signals_q import HOUR, LOTS, MARKOUTS, MIN30, PNL, QL, H, _lots, r6

RECORDS = f"""with {QL}, {PNL}, {LOTS},
mt as (select session_id, sum(realized_pnl - fees) as mn, sum(realized_pnl)::double as mg, sum(fees) as mf, case when count(open_spread + close_spread) = count(*) then sum(realized_pnl - open_spread - close_spread) end as mi, sum(qty) as mq from lots group by 1),
od as (select session_id, count(distinct order_id) as orders, count_if(is_maker) as maker from fills group by 1),
sr as (select pl.session_id, n_fills, gross - fees as net, case when mq is null then 0 else mn end as mn, case when mq is null then 0 else mg end as mg, case when mq is null then 0 else mf end as mf, coalesce(mq, 0) as mq,
       gross - spread_capture - case when mq is null then 0 else mi end as ri, abs(position) as res, orders, maker from pl left join mt using (session_id) left join od using (session_id))"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = view(spark, sf_dir, "fills")
    return R.session_records(P.pnl(fills, view(spark, sf_dir, "quotes"), 2, 5), _lots(spark, sf_dir), fills)


@query(f"""{RECORDS} select session_id, n_fills as fills, round(net, 4) as net_pnl, round(mn, 4) as matched_net_pnl, round(mg, 4) as matched_gross_pnl, round(mf, 4) as matched_fees,
round(ri, 4) as residual_inventory_pnl, res::bigint as abs_residual_inventory, round(orders / n_fills, 6) as orders_per_fill from sr""")
def f27_session_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _sessions(spark, sf_dir).withColumn("orders_per_fill", F.round("orders_per_fill", 6))
    money = [F.round(c, 4).alias(c) for c in ("net_pnl", "matched_net_pnl", "matched_gross_pnl", "matched_fees", "residual_inventory_pnl")]
    return got.select("session_id", "fills", *money, "abs_residual_inventory", "orders_per_fill")


@query(f"""{RECORDS} select session_id % 2 as panel, round(sum(net), 4) as net_pnl, round(sum(mn), 4) as matched_net_pnl, case when count(ri) = count(*) then round(sum(ri), 4) end as residual_inventory_pnl,
round(avg(res), 4) as abs_residual_inventory, round(sum(orders) / sum(n_fills), 6) as orders_per_fill, sum(n_fills)::bigint as fills from sr group by 1""")
def f27_window_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = R.window_records(_sessions(spark, sf_dir).withColumn("panel", F.col("session_id") % 2), ["panel"])
    rounded = [F.round(c, 4).alias(c) for c in ("net_pnl", "matched_net_pnl", "residual_inventory_pnl", "abs_residual_inventory")]
    return got.select("panel", *rounded, F.round("orders_per_fill", 6).alias("orders_per_fill"), "fills")


@query(f"""{RECORDS} select session_id as "window", 'depth-first' as equal_timestamp_policy, '0' as latency_seed, null::varchar as post_only, n_fills as fills, maker::bigint as maker_fills, mq::bigint as matched_quantity,
round(mn, 4) as matched_net_pnl, round(net, 4) as full_strategy_net_pnl, round(res, 4)::double as average_abs_residual_inventory from sr""")
def p8_gate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = R.window_records(_sessions(spark, sf_dir), ["session_id"])
    got = R.gate_rows(windows, "session_id", {"equal_timestamp_policy": "depth-first", "latency_seed": 0, "post_only": None})
    return got.withColumns({c: F.round(c, 4) for c in ("matched_net_pnl", "full_strategy_net_pnl", "average_abs_residual_inventory")})


@query(f"""with {QL}, {PNL}, {LOTS}, {MARKOUTS},
px as (select l.session_id, m.horizon_ms, sum(m.markout * l.qty - l.open_spread) as proxy from lots l join m on l.session_id = m.session_id and l.open_fill_id = m.fill_id where l.open_spread is not null group by 1, 2),
er as (select m.session_id, m.horizon_ms, any_value(spread_capture + coalesce(proxy, 0) - gross) as e from m left join px using (session_id, horizon_ms) join pl using (session_id) group by 1, 2)
select session_id, arg_min(horizon_ms, {{'e': round(abs(e), 6), 'h': horizon_ms}}) as best_horizon_ms from er group by 1""")
def h3_best_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills, quotes = view(spark, sf_dir, "fills"), view(spark, sf_dir, "quotes")
    got = P.reconciliation(_lots(spark, sf_dir), P.markouts(fills, quotes, H), P.pnl(fills, quotes, 2, 5))
    return P.best_horizon(got.withColumn("net_error", F.round("net_error", 6)))


EDGES = (0.0, 400.0, 800.0, 1600.0)


@query(f"""with {QL}, x as (select f.*, g.mid as fm, g.bid, g.ask from fills f asof left join ql g on f.session_id = g.session_id and f.time_ms >= g.time_ms),
vol as (select f.fill_id, case when count(q.mid) >= 2 then round(stddev_samp(q.mid) / avg(q.mid) * 10000, 6) end as v from fills f left join q on f.session_id = q.session_id and q.time_ms between f.time_ms - {HOUR} and f.time_ms group by 1),
b as (select ask - bid as spread, case when v < 400 then 0 when v < 800 then 1 when v < 1600 then 2 else 3 end as bin, case when bid is null then 'unknown' when side = 'buy' then
 case when price >= ask then 'crossed' when price > bid then 'inside_spread' when price = bid then 'at_best' else 'behind_best' end
 else case when price <= bid then 'crossed' when price < ask then 'inside_spread' when price = ask then 'at_best' else 'behind_best' end end as position from x join vol using (fill_id) where v is not null)
select n.bin, count(spread) filter (b.bin is not null) as n_spreads, round(avg(spread), 4) as avg_spread, median(spread)::double as median_spread, count(*) filter (position = 'crossed') as crossed, count(*) filter (position = 'at_best') as at_best
from (select unnest(range(4))::int as bin) n left join b using (bin) group by 1""")
def f15_spread_by_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = view(spark, sf_dir, "fills").withColumn("order_id", F.col("fill_id"))
    placed = fills.select("session_id", "order_id", (F.col("time_ms") - MIN30).alias("placed_ms"))
    got = T.spread_by_volatility(P.pre_fill_drift(fills, placed, view(spark, sf_dir, "quotes"), HOUR), EDGES)
    return got.select("bin", (F.col("n_fills") - F.col("unknown")).alias("n_spreads"), F.round("avg_spread", 4).alias("avg_spread"), F.col("median_spread").cast("double").alias("median_spread"), "crossed", "at_best")


@query("""select session_id, seq from trades""")
def b8_guarded_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trades in their time order, through the guard that fails at the first time that goes back."""
    return S.require_monotone(view(spark, sf_dir, "trades"), order=("time_ms", "seq")).select("session_id", "seq")


@query(f"""with h as (select time_ms // {HOUR} * {HOUR} as hour_ms, count(*) as n from diffs group by 1)
select sha256('[' || string_agg('{{"hour_ms":' || hour_ms || ',"n":' || n || '}}', ',' order by hour_ms) || ']') as manifest_hash from h""")
def b18_manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of a manifest of hours, which is small."""
    hours = view(spark, sf_dir, "diffs").groupBy(F.expr(f"time_ms div {HOUR} * {HOUR}").alias("hour_ms")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([(C.manifest_hash([r.asDict() for r in hours.orderBy("hour_ms").collect()]),)], "manifest_hash string")


@query(f"""select strftime(make_timestamp(time_ms // {HOUR} * {HOUR} * 1000), '%Y-%m-%d %H:00') as hour, count(*) as n from diffs group by 1""")
def e16_hour_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "diffs").groupBy(hour_label(F.col("time_ms")).alias("hour")).agg(F.count("*").alias("n"))


@query("""select day, open, high, low, close, volume::bigint as volume from bars where day between date '1994-03-01' and date '1996-06-30'""")
def a4_read_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as Parquet and read back for a range that includes both ends."""
    path = new_folder(spark, "bars")
    view(spark, sf_dir, "bars").write.parquet(path)
    return C.read_bars(spark, path, "1994-03-01", "1996-06-30").select("day", "open", "high", "low", "close", "volume")


@query("""select session_id::varchar as session_id, is_maker::varchar as is_maker, count(*)::varchar as n, sum(qty)::varchar as qty, printf('%.2f', sum(price * qty) / 100.0) as notional from fills group by session_id, is_maker""")
def a11_csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run table written as CSV, decimals in plain notation, and read back as text."""
    path = new_folder(spark, "csv")
    notional = (F.sum(F.col("price") * F.col("qty")) / F.lit(100)).cast("decimal(28,2)").alias("notional")
    C.write_csv(view(spark, sf_dir, "fills").groupBy("session_id", "is_maker").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), notional), path)
    return spark.read.csv(path, header=True, schema="session_id string, is_maker string, n string, qty string, notional string")


@query("""select session_id, side, count(*) as n, sum(qty)::bigint as qty, 'symmetric' as strategy from fills group by 1, 2""")
def a12_a13_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's table and provenance written, read back, and checked before use."""
    root, about = new_folder(spark, "results"), {"strategy": "symmetric", "execution_model_version": 2}
    C.write_results({"sides": view(spark, sf_dir, "fills").groupBy("session_id", "side").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))}, root, about)
    found, told = C.read_results(spark, root, ["sides"], require={"execution_model_version": 2})
    return found["sides"].withColumn("strategy", F.lit(told["strategy"]))
