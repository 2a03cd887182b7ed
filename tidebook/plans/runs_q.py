"""Queries: digests, resumable steps, caches, captures and table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import view
from ..functions import tables
from ..operators import book as B
from ..operators import caches, digests, steps
from ..registry import query
from ..shared import new_folder
from ..sources import capture_source as C
from .signals_q import HOUR, LOTS, MIN30, OFI, OFI_POINTS, PNL, QL, H, r6
from .streams_q import LIVES

SHAPE = digests.Shape()


def tree_sql(source: str, columns: list[str], by: str) -> str:
    """The digests' tree over ``source`` (with ``by`` and seq), level by level, as common table expressions t0 to t4."""
    text = " || ".join(f"coalesce(length({c}::varchar) || ':' || {c}::varchar, '-')" for c in columns)
    sql = f"""t_rows as (select {by}, seq, sha256({text}) as d from {source}),
    t_seqs as (select {by}, seq, count(*) as n, sha256(string_agg(d, '' order by d)) as d from t_rows group by all),
    t0 as (select {by}, seq // {SHAPE.chunk} as node, sum(n)::bigint as n, sha256(string_agg(d, '' order by seq)) as d from t_seqs group by all)"""
    for i in range(SHAPE.height):
        sql += f""",
    t{i + 1} as (select {by}, node // {SHAPE.fan} as node, sum(n)::bigint as n, sha256(string_agg(node || ':' || d, '' order by node)) as d from t{i} group by all)"""
    return sql


TRADE = ["seq", "time_ms", "price", "qty", "is_buyer_maker", "agg_trade_id"]


@query(f"with {tree_sql('trades', TRADE, 'session_id')} select session_id, n as n_rows, d as digest from t{SHAPE.height}")
def c14_stream_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order-sensitive digest for each session's trades."""
    return digests.digests(view(spark, sf_dir, "trades"), TRADE, ["session_id"])


@query(f"with {tree_sql('trades', TRADE, 'session_id')} select session_id, node, n, d as digest from t0")
def e19_chunk_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.leaves(view(spark, sf_dir, "trades"), TRADE, ["session_id"])


@query(f"""with {LIVES}, p as (select session_id, segment_id, seq, row_number() over (partition by session_id, segment_id order by seq) as no from level_updates),
x as (select p.session_id, p.seq, a.side, a.price, a.qty from p join bk a using (session_id, segment_id, seq) where p.no % 20 = 0),
j as (select session_id, seq, coalesce(string_agg('["' || price || '","' || qty || '"]', ',' order by price desc) filter (side = 'bid'), '') as b,
      coalesce(string_agg('["' || price || '","' || qty || '"]', ',' order by price) filter (side = 'ask'), '') as a from x group by 1, 2),
states as (select session_id, seq, sha256('{{"bids":[' || b || '],"asks":[' || a || '],"last_update_id":' || seq || '}}') as state_hash from j),
{tree_sql('states', ['seq', 'state_hash'], 'session_id')} select session_id, n as n_rows, d as digest from t{SHAPE.height}""")
def p4_state_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest over each session's captured book states."""
    return digests.digests(B.checkpoints(view(spark, sf_dir, "level_updates"), 20), ["seq", "state_hash"], ["session_id"])


@query("""select session_id, min(seq) as seq from trades where seq % 977 = 500 or seq % 1511 = 9 group by 1""")
def o4_first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a run with some rows changed and some missing departs from the recorded one."""
    a = view(spark, sf_dir, "trades")
    b = a.filter("seq % 1511 <> 9").withColumn("qty", F.when(F.col("seq") % 977 == 500, F.col("qty") + 1).otherwise(F.col("qty")))
    return digests.first_difference(a, b, TRADE, ["session_id"])


@query("""with s as (select session_id, count(*) as n, sum(qty)::bigint as qty from fills group by 1), t as (select sum(qty) as total from s)
select session_id, n, qty, round(qty / total, 6) as share, 0 as ran_again from s, t""")
def o1_resumed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps, called twice: the second call finds all results in the manifest."""
    chain = [
        steps.Step("maker", lambda _, t: t["fills"].select("session_id", "qty"), ("fills",)),
        steps.Step("sums", lambda _, t: t["maker"].groupBy("session_id").agg(F.count("*").alias("n"), F.sum("qty").alias("qty")), ("maker",)),
        steps.Step("shares", lambda _, t: t["sums"].join(F.broadcast(t["sums"].agg(F.sum("qty").alias("total"))), F.lit(True)), ("sums",)),  # one row
    ]
    root, sources = new_folder(spark, "steps"), {"fills": view(spark, sf_dir, "fills")}
    steps.run_steps(spark, root, sources, chain)
    again = steps.run_steps(spark, root, sources, chain)
    share = F.round(F.col("qty") / F.col("total"), 6).alias("share")
    return again.tables["shares"].select("session_id", "n", "qty", share, F.lit(len(again.ran)).alias("ran_again"))


@query("""select session_id, time_ms // 1000 * 1000 as second_ms, arg_max((bid + ask) / 2.0, (time_ms, seq)) as mid from quotes group by 1, 2""")
def p9_second_mids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after a first fill that lacks every hour's second half, and a refresh with all rows."""
    quotes, path = view(spark, sf_dir, "quotes"), new_folder(spark, "mids")
    caches.refresh(quotes.filter(f"time_ms % {HOUR} < {HOUR // 2}"), path)
    caches.refresh(quotes, path)
    return caches.read(spark, path)


@query(f"""select time_ms // {HOUR} * {HOUR} as hour_ms, count(*) as n_rows, count_if(seq % 97 = 0)::bigint as snapshots, min(case when seq % 97 <> 0 then first_update_id end) as first_id,
max(last_update_id) as last_id, 0::bigint as bad from diffs group by 1""")
def a1_captured_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth rows written as hourly captures and read back through the data source."""
    iso = F.concat(F.date_format(F.timestamp_millis("time_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00"))
    none = F.array().cast("array<array<string>>")
    snap = F.struct(iso.alias("recv_time"), F.lit("depth").alias("type"), F.struct(F.col("last_update_id").alias("lastUpdateId"), none.alias("bids"), none.alias("asks")).alias("data"))
    diff = F.struct(iso.alias("recv_time"), F.struct(F.col("time_ms").alias("E"), F.col("first_update_id").alias("U"), F.col("last_update_id").alias("u"), none.alias("b"), none.alias("a")).alias("data"))
    lines = view(spark, sf_dir, "diffs").select("seq", "time_ms", F.when(F.col("seq") % 97 == 0, F.to_json(snap)).otherwise(F.to_json(diff)).alias("line"))
    root = new_folder(spark, "captures")
    C.write_captures(lines, root, "depth", "btcusdt").write.format("noop").mode("overwrite").save()
    return C.read_captures(spark, root, "depth").groupBy("hour_ms").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("event_type") == "snapshot").alias("snapshots"), F.min("first_update_id").alias("first_id"),
        F.max("last_update_id").alias("last_id"), F.count_if("bad").alias("bad"),
    )


@query(f"""with {QL}, {PNL}, {LOTS} select session_id, open_fill_id, close_fill_id, hold_ms, qty::bigint as qty, round(realized_pnl::double, 4) as realized_pnl, round(fees::double, 4) as fees from lots""")
def k8_lots_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    got = spark.sql("select * from fifo_lots(table(select * from {fills}), 2, 5)", fills=view(spark, sf_dir, "fills"))
    hold = (F.col("close_ms") - F.col("open_ms")).alias("hold_ms")
    return got.select("session_id", "open_fill_id", "close_fill_id", hold, "qty", F.round("realized_pnl", 4).alias("realized_pnl"), F.round("total_fees", 4).alias("fees"))


@query(f"""with {QL}, {OFI}, {OFI_POINTS} select session_id, time_ms, horizon_ms, future_ms, n_mid as mid, future_mid, raw_ofi,
round(normalized_ofi, 6) as normalized_ofi, round(drift_bps, 6) as drift_bps from s0""")
def k8_samples_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    call = f"select * from ofi_samples(table(select * from {{q}}), {MIN30}, {HOUR}, array({', '.join(map(str, H))}))"
    return r6(spark.sql(call, q=view(spark, sf_dir, "quotes")), "normalized_ofi", "drift_bps")
