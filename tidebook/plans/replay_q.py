"""Queries over closed-loop replays; their sessions are synthetic books built from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..adapters import view
from ..operators import orders as O
from ..operators import pnl as P
from ..operators import stats as T
from ..registry import query
from ..sim import MicropriceMaker, OfiGatedMaker, Settings, SymmetricMaker, book_samples, fills, order_events, replay, replay_stats

SESSION = ("block",)
GRID = [Settings(latency_ms=10, queue_credit=c) for c in ("0", "0.5", "1")]
BY = ("block", "config_no")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 500 events: a snapshot first, then a two-sided book around the quotes, trades at its best prices."""
    dec = "decimal(28,10)"
    q = view(spark, sf_dir, "quotes").withColumn("block", F.expr("seq div 500"))
    base = F.lit(10_000) + (F.col("bid") % 7)

    def level(p, n):
        return F.struct(p.cast(dec).alias("price"), n.cast(dec).alias("qty"))

    bids = F.array(level(base, F.col("bid_qty")), level(base - 1, F.col("bid_qty") + 3), level(base + 1, F.lit(0)), level(base + 2, F.lit(0)))
    asks = F.array(level(base + 3, F.col("ask_qty")), level(base + 4, F.col("ask_qty") + 3), level(base + 2, F.lit(0)), level(base + 1, F.lit(0)))
    first = F.min("seq").over(Window.partitionBy("block"))
    null = {"price": F.lit(None).cast(dec), "qty": F.lit(None).cast(dec), "is_buyer_maker": F.lit(None).cast("boolean")}
    d = q.withColumns({"bids": bids, "asks": asks, "event_type": F.when(F.col("seq") == first, "snapshot").otherwise("diff"), "kind": F.lit(0), **null})
    d = d.withColumns({"has_gap": F.lit(False), "dispatch": F.lit(True)})
    t = view(spark, sf_dir, "trades").withColumn("block", F.expr("seq div 500"))
    empty = F.array().cast(f"array<struct<price: {dec}, qty: {dec}>>")
    t = t.withColumns(
        {
            "bids": empty, "asks": empty, "event_type": F.lit("trade"), "kind": F.lit(1), "price": (F.lit(10_000) + F.col("price") % 11).cast(dec), "qty": F.col("qty").cast(dec),
            "has_gap": F.lit(False), "dispatch": F.lit(True),
        }
    )
    cols = ["block", "time_ms", "kind", "seq", "event_type", "bids", "asks", "price", "qty", "is_buyer_maker", "has_gap", "dispatch"]
    return d.select(*cols).unionByName(t.select(*cols))


def _maker():
    return SymmetricMaker("2", "1", "5", tick="1")


def _out(spark: SparkSession, sf_dir: str, maker=_maker, grid=GRID) -> DataFrame:
    return replay(events(spark, sf_dir), maker, grid, SESSION)


@query()
def j12_replay_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fills(_out(spark, sf_dir))


@query()
def j14_order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_events(_out(spark, sf_dir)).withColumn("detail", F.to_json("detail"))


@query()
def b14_j12_replay_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_stats(_out(spark, sf_dir)).groupBy("config_no", "stat").agg(F.sum("value").alias("value"))


@query()
def c11_book_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book_samples(_out(spark, sf_dir, grid=GRID[:1]))


@query()
def k4_microprice_maker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fills(_out(spark, sf_dir, lambda: MicropriceMaker("1", "1", "5", tick="1"), GRID[2:]))


@query()
def k5_ofi_gated_maker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fills(_out(spark, sf_dir, lambda: OfiGatedMaker("1", "1", "5", tick="1", ofi_ms=3_600_000), GRID[2:]))


@query()
def o2_stress_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits at one latency, and both ends of the credit at all latencies: one job."""
    grid = [Settings(latency_ms=10, queue_credit=c) for c in ("0", "0.25", "0.5", "0.75", "1")]
    grid += [Settings(latency_ms=ms, queue_credit=c) for c in ("0", "1") for ms in (0, 50)]
    got = fills(replay(events(spark, sf_dir), _maker, grid, SESSION, samples=False))
    return got.groupBy("config_no").agg(F.count("*").alias("n_fills"), F.count_if("is_maker").alias("n_maker"), F.sum("qty").cast("double").alias("qty"))


def _quotes(out: DataFrame) -> DataFrame:
    return book_samples(out).withColumns({c: F.col(c).cast("double") for c in ("bid", "ask", "bid_qty", "ask_qty")})


def _fills(out: DataFrame) -> DataFrame:
    return fills(out).withColumns({c: F.col(c).cast("double") for c in ("price", "qty")})


@query()
def l6_f8_order_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _out(spark, sf_dir).persist()
    marks = P.markouts(_fills(out), _quotes(out), [1_800_000], BY)
    got = O.order_contexts(order_events(out), fills(out), _quotes(out), marks, 3_600_000, BY)
    return T.fill_rate_bins(got, "distance_bps", [0.0, 1.0, 2.0, 5.0], "bps")


@query()
def f16_queue_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.queue_diagnostics(order_events(_out(spark, sf_dir)), BY)


@query()
def p6_activation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.activation_summary(order_events(_out(spark, sf_dir)), ("config_no",))


@query("""with o as (select fill_id as order_id, session_id, side, price // 2000 as price, qty, time_ms as arrival_ms, 3 as queue from fills),
t as (select session_id, case when is_buyer_maker then 'buy' else 'sell' end as side, price // 2000 as price, time_ms as t_ms, seq as t_seq, qty as t_qty from trades),
j as (select o.*, t.*, sum(t_qty) over (partition by order_id order by t_ms, t_seq rows unbounded preceding) as hi from o join t on o.session_id = t.session_id and o.side = t.side and o.price = t.price and t.t_ms > o.arrival_ms)
select order_id, t_ms as time_ms, cast(least(hi, queue + qty) - greatest(hi - t_qty, queue) as bigint) as fill_qty from j where least(hi, queue + qty) - greatest(hi - t_qty, queue) > 0""")
def j7_open_loop_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.expr("price div 2000")
    o = view(spark, sf_dir, "fills").select(F.col("fill_id").alias("order_id"), "session_id", "side", price.alias("price"), "qty", F.col("time_ms").alias("arrival_ms"), F.lit(3).alias("queue"))
    t = view(spark, sf_dir, "trades").withColumn("price", price)
    return O.open_loop_fills(o, t).select("order_id", "time_ms", "fill_qty")
