"""Hand-checked cases that the generated tables rarely reach."""

import gzip
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidebook.functions import scalar as X
from tidebook.operators import bars as A
from tidebook.operators import book as B
from tidebook.operators import orders as O
from tidebook.operators import pnl as P
from tidebook.operators import reports as R
from tidebook.operators import signals as S
from tidebook.operators import stats as T
from tidebook.operators import streams as G
from tidebook.operators import windows as W
from tidebook.operators.asof import asof
from tidebook.sources import captures as C

QUOTE = "session_id long, seq long, time_ms long, bid long, ask long, bid_qty long, ask_qty long"
FILL = "session_id long, seq long, fill_id long, order_id long, time_ms long, side string, price double, qty double, is_maker boolean"


def fills(spark, *rows):
    return spark.createDataFrame([(0, i, i, i, t, side, float(p), float(q), True) for i, (t, side, p, q) in enumerate(rows)], FILL)


def quotes(spark, *rows):
    return spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], QUOTE)


@pytest.mark.parametrize("bucket", [None, 5, 1000])
@pytest.mark.parametrize("forward, strict, expected", [(False, False, [None, 2, 2, 3]), (False, True, [None, 0, 2, 2]), (True, False, [0, 0, 3, 3]), (True, True, [0, 3, 3, None])])
def test_asof_ties(spark, forward, strict, expected, bucket):
    q = quotes(spark, *[(t, 1, 2, 1, 1) for t in (10, 20, 20, 30)])
    q = q.filter("seq <> 1").union(q.filter("seq = 1").withColumn("seq", F.lit(1).cast("long")))
    p = spark.createDataFrame([(0, 5), (0, 20), (0, 25), (0, 30)], "session_id long, time_ms long")
    if expected[1] == 0 and not forward:
        expected = [None, 0, 2, 2]
    if forward and not strict:
        expected = [0, 1, 3, 3]
    got = asof(p, q, ["session_id"], ["seq"], forward=forward, strict=strict, bucket_ms=bucket).orderBy("time_ms").collect()
    assert [r["q_seq"] for r in got] == expected


def test_markout_takes_the_first_mid_at_the_horizon(spark):
    q = quotes(spark, (1999, 100, 102, 1, 1), (2000, 101, 103, 1, 1), (2500, 102, 104, 1, 1))
    r = P.markouts(fills(spark, (1000, "buy", 100, 1)), q, [1000]).first()
    assert (r["sample_ms"], r["markout"]) == (2000, 2.0)


@pytest.mark.parametrize("values, expected", [([1, 2, 4, 8, 16], [1.5, 4.0, 12.0]), ([1, 2, 3], [None] * 3), ([1, 2, 3, 4], [1.25, 2.5, 3.75])])
def test_exclusive_quartiles(spark, values, expected):
    df = spark.createDataFrame([(1, float(v)) for v in values], "horizon_ms long, markout_bps double")
    r = P.markout_summary(df).first()
    assert [r[f"q{k}_bps"] for k in (1, 2, 3)] == expected


def test_lots(spark):
    lots = P.fifo_lots(fills(spark, (0, "buy", 100, 2), (1000, "sell", 101, 0.5), (2000, "sell", 103, 1.5)), None, 2, 5)
    assert sorted((r["qty"], r["realized_pnl"]) for r in lots.collect()) == [(0.5, 0.5), (1.5, 4.5)]
    r = P.fifo_lots(fills(spark, (0, "sell", 105, 1), (5, "buy", 100, 1)), None, 2, 5).first()
    assert (r["open_side"], r["realized_pnl"], r["hold_ms"]) == ("sell", 5.0, 5)
    assert P.open_lots(fills(spark, (0, "buy", 100, 2), (9, "sell", 101, 0.5))).first()["open_qty"] == 1.5


def test_lots_and_profit_identities(spark):
    rng = random.Random(4)
    rows = [(i * 10, rng.choice(["buy", "sell"]), rng.randrange(95, 105), rng.randrange(1, 9)) for i in range(120)]
    f = fills(spark, *rows)
    q = quotes(spark, *[(i * 7, 99, 101, 1, 2) for i in range(250)])
    lots, rest = P.fifo_lots(f, q, 2, 5, bucket_qty=7), P.open_lots(f)
    matched = lots.agg(F.sum("qty")).first()[0]
    assert 2 * matched + rest.agg(F.sum("open_qty")).first()[0] == sum(r[3] for r in rows)
    p = P.pnl(f, q, 2, 5).first()
    assert p["net_pnl"] == pytest.approx(p["spread_capture"] + p["inventory_pnl"] - p["fees"])


def test_average_cost_flips(spark):
    r = P.average_cost(fills(spark, (0, "buy", 100, 2), (1, "buy", 106, 1), (2, "sell", 110, 5))).first()
    assert (r["position"], r["avg_cost"]) == (-2.0, 110.0)


def test_ofi_of_one_interval(spark):
    q = quotes(spark, (0, 200, 202, 5, 3), (1000, 201, 202, 4, 3), (2000, 202, 204, 4, 3))
    q = q.union(quotes(spark, (2000, 202, 204, 4, 3)).withColumn("seq", F.lit(9).cast("long")).filter("false"))
    got = S.ofi_samples(q, 1000, 1000, [1000], 0, 0).collect()
    assert [(r["time_ms"], r["raw_ofi"]) for r in got] == [(1000, 4)]
    assert got[0]["normalized_ofi"] == pytest.approx(4 / 7)


@pytest.mark.parametrize("n, f, k", [(921, "0.01", 9), (696, "0.01", 7), (696, "0.05", 35), (0, "0.01", 0), (3, "0.01", 1)])
def test_tail_count(spark, n, f, k):
    assert spark.range(1).select(X.tail_count(F.lit(n), f)).first()[0] == k


def test_clusters_include_the_gap(spark):
    rows = spark.createDataFrame([(t, -1.0, i) for i, t in enumerate((0, 50, 101))], "time_ms long, m double, fill_id long")
    got = T.clusters(rows.withColumn("g", F.lit(0)), "m", 50, ["g"])
    assert sorted(r["rows"] for r in got.collect()) == [1, 2]


@pytest.mark.parametrize("hhmm, name, delta", [((0, 30), "Tokyo", 30), ((23, 40), "Tokyo", -20), ((3, 0), "Singapore/Hong Kong", 120)])
def test_nearest_boundary(spark, hhmm, name, delta):
    t = int(datetime(2024, 1, 2, *hhmm).timestamp() * 1000)
    day = t - t % 86_400_000
    r = spark.range(1).select(X.nearest_boundary(F.lit(day + (hhmm[0] * 60 + hhmm[1]) * 60_000)).alias("b")).first()["b"]
    assert (r["name"], r["delta"]) == (name, delta * 60_000)


def test_capacity(spark):
    hour = 3_600_000
    w = spark.createDataFrame([(i * hour, (i + 5) * hour) for i in range(10)], "start_ms long, end_ms long")
    assert W.capacity(w).first()[0] == 2


def test_random_walk_has_no_signal(spark):
    rng = random.Random(7)
    x, rows = 100_000, []
    for t in range(1500):
        x += rng.choice((-1, 1))
        rows.append((t * 1000, x, x + 2, rng.randrange(1, 9), rng.randrange(1, 9)))
    got = S.microprice_samples(quotes(spark, *rows), 1000, [1000])
    fit = T.ols_hac(got, "signal_bps", "drift_bps", ["session_id", "horizon_ms"], ["time_ms"], 1000).first()
    assert abs(fit["t_stat"]) < 4 and fit["lags"] == 7


def test_bootstrap_is_seeded_and_degenerate_at_one(spark):
    df = spark.createDataFrame([(0, i, float(i % 5)) for i in range(20)] + [(1, 0, 3.0)], "k int, o int, v double")
    a, b = (sorted(map(tuple, T.bootstrap_mean(df, "v", ["k"], ["o"], 300).collect())) for _ in range(2))
    assert a == b and a[1] == (1, 1, 3.0, 3.0, 3.0) and a[0][3] < 2.0 < a[0][4]


def test_fee_break_even(spark):
    lots = spark.createDataFrame([(0, 5, 1, 2, 1.0, -1.0, 1.0, 2.0)], "session_id long, close_ms long, open_fill_id long, close_fill_id long, qty double, net_pnl double, realized_pnl double, total_fees double")
    r = T.fee_break_even(lots, ["session_id"], 2).filter("row_type = 'full_matched_lots'").first()
    assert (r["break_even_bps"], r["required_rebate_bps"], r["net_per_unit"]) == (1.0, 0.0, -1.0)


# --- streams ---

DEPTH = "session_id long, seq long, recv_ms long, request_ms long, event_type string, time_ms long, first_update_id long, last_update_id long"


def bridged(spark, *rows):
    got = G.bridge_snapshots(spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], DEPTH)).orderBy("seq", "sub").collect()
    return [(r["event_type"], r["seq"], r["time_ms"], r["has_gap"], r["dispatch"]) for r in got]


def test_bridge_waits_for_the_response(spark):
    got = bridged(
        spark,
        (100, None, "snapshot", None, None, 50), (99, None, "diff", 90, 40, 50), (99, None, "diff", 95, 51, 60), (100, None, "diff", 96, 61, 70),
        (101, None, "diff", 97, 71, 80), (102, None, "diff", 98, 81, 90), (103, None, "diff", 99, 95, 99),
    )
    assert got == [
        ("resync", 0, 100, False, False), ("snapshot", 0, 97, False, False), ("diff", 2, 97, False, False), ("diff", 3, 97, False, False),
        ("diff", 4, 97, False, True), ("diff", 5, 98, False, True), ("diff", 6, 99, True, True),
    ]


def test_failed_bridge_leaves_a_gap(spark):
    got = bridged(spark, (100, 90, "snapshot", None, None, 50), (100, None, "diff", 95, 60, 70), (101, None, "diff", 96, 71, 80))
    assert got == [("resync", 0, 90, False, False), ("diff", 1, 95, True, True), ("diff", 2, 96, False, True)]


def test_known_request_time_releases_at_once(spark):
    got = bridged(spark, (100, 90, "snapshot", None, None, 50), (100, None, "diff", 95, 51, 70))
    assert got == [("resync", 0, 90, False, False), ("snapshot", 0, 95, False, False), ("diff", 1, 95, False, True)]


def test_monotone_guard_fails(spark):
    rows = spark.createDataFrame([(0, 0, 5), (0, 1, 4)], "session_id long, seq long, time_ms long")
    with pytest.raises(Exception, match="not monotone"):
        G.require_monotone(rows).collect()


# --- book ---

UPDATE = "session_id long, segment_id long, seq long, pos int, side string, price long, qty long"


def test_later_duplicate_in_a_message_wins_and_crossed_books_stay(spark):
    rows = [(0, 0, 0, 0, "bid", 100, 5), (0, 0, 0, 1, "bid", 100, 7), (0, 0, 0, 2, "ask", 99, 2), (0, 0, 1, 0, "bid", 100, 0)]
    u = spark.createDataFrame(rows, UPDATE)
    got = {r["seq"]: tuple(r)[3:] for r in B.best_quotes(u).collect()}
    assert got == {0: (100, 7, 99, 2), 1: (None, None, 99, 2)}
    kernel = {r["seq"]: tuple(r)[3:] for r in B.best_quotes_by_kernel(u).collect()}
    assert kernel == got


# --- bars ---


def test_backtest_against_a_plain_loop(spark):
    rng = random.Random(5)
    price, rows = 100.0, []
    for i in range(160):
        price *= 1 + rng.uniform(-0.03, 0.03)
        rows.append((datetime(2024, 1, 1).toordinal() + i, price))
    bars = spark.createDataFrame([(datetime.fromordinal(d).date(), p) for d, p in rows], "day date, close double")
    run = A.Run("momentum", 12, 0.02)
    got = [tuple(r) for r in A.backtest(A.signals(bars, [run])).orderBy("day").select("position", "equity").collect()]
    cash, pos, out = 100_000.0, 0.0, []
    for i, (_, p) in enumerate(rows):
        if i >= 11:
            ret = p / rows[i - 11][1] - 1
            if ret > 0.02 and pos < 1:
                cash -= 0.5 * p * (1 + 15 / 10_000)
                pos += 0.5
            elif ret < -0.02 and pos > 0:
                cash += pos * p * (1 - 15 / 10_000)
                pos = 0.0
        out.append((pos, cash + pos * p))
    assert all(a[0] == b[0] and a[1] == pytest.approx(b[1]) for a, b in zip(got, out))
    m = A.metrics(A.backtest(A.signals(bars, [run]))).first()
    assert m["total_return"] == pytest.approx(out[-1][1] / 100_000 - 1) and m["num_trades"] > 0


# --- sources ---


def test_captures_to_replay(spark, tmp_path):
    depth = [
        {"recv_time": "2024-01-01T00:00:01", "type": "snapshot", "data": {"lastUpdateId": 5, "bids": [["100.0", "2"]], "asks": [["101.0", "3"]]}},
        {"recv_time": "2024-01-01T00:00:02", "data": {"E": 1704067202000, "U": 5, "u": 7, "b": [["100.5", "1"]], "a": []}},
        {"recv_time": "2024-01-01T00:00:03", "data": {"E": 1704067203000, "U": 8, "u": 9, "b": [["100.5", "0"]], "a": []}},
    ]
    trades = [{"recv_time": "2024-01-01T00:00:03", "data": {"a": 1, "T": 1704067203000, "p": "100.0", "q": "1", "m": True}}]
    for name, lines in (("d", depth), ("t", trades)):
        with gzip.open(tmp_path / f"{name}.jsonl.gz", "wt") as f:
            f.write("\n\n".join(json.dumps(x) for x in lines) + "\n")
    ev = C.events_for_replay(C.read_depth(spark, f"{tmp_path}/d.jsonl.gz"), C.read_trades(spark, f"{tmp_path}/t.jsonl.gz"))
    from tidebook.sim import Settings, SymmetricMaker, book_samples, order_events, replay, replay_stats

    out = replay(ev, lambda: SymmetricMaker("1", "1", "2", tick="0.5"), [Settings(latency_ms=0)]).persist()
    assert [(float(r["bid"]), float(r["ask"])) for r in book_samples(out).orderBy("seq").collect()] == [(100.5, 101.0), (100.0, 101.0)]
    stats = {r["stat"]: r["value"] for r in replay_stats(out).collect()}
    assert (stats["snapshots"], stats["depth_diffs"], stats["trade_events"], stats["snapshot_resyncs"]) == (1, 2, 1, 1)
    assert order_events(out).filter("event_type = 'placed'").count() >= 2


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string").withColumn("d", F.lit("1.50").cast("decimal(10,2)"))
    C.write_results({"rows": df}, f"{tmp_path}/run", {"b": 1, "a": "x"})
    back, about = C.read_results(spark, f"{tmp_path}/run", ["rows"])
    assert sorted(map(tuple, back["rows"].collect())) == sorted(map(tuple, df.collect())) and about == {"a": "x", "b": 1}
    C.write_csv(df, f"{tmp_path}/csv")
    assert {r["d"] for r in spark.read.csv(f"{tmp_path}/csv", header=True).collect()} == {"1.50"}
    with pytest.raises(ValueError):
        C.safe_component("../x")
    assert C.file_hashes(spark, f"{tmp_path}/run/rows/*.parquet").count() >= 1
    with pytest.raises(FileNotFoundError):
        C.require_files(spark, [f"{tmp_path}/none"])
    assert C.hourly_paths("r", "btcusdt", "depth", datetime(2024, 1, 1, 23), 2) == ["r/btcusdt_depth_20240101_2300.jsonl.gz", "r/btcusdt_depth_20240102_0000.jsonl.gz"]


# --- streams at rest ---


def test_stateful_book_across_batches(spark, tmp_path):
    from tidebook.streaming import live

    rows = [(0, 0, "bid", 100, 5), (0, 1, "ask", 102, 3), (0, 2, "bid", 101, 1), (0, 3, "bid", 101, 0)]
    schema = "session_id long, seq long, side string, price long, qty long"
    for i in (0, 1):
        spark.createDataFrame(rows[2 * i : 2 * i + 2], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = live.best_quotes(stream).writeStream.format("memory").queryName("bbo").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["seq"]: (r["bid"], r["bid_qty"], r["ask"], r["ask_qty"]) for r in spark.sql("select * from bbo").collect()}
    assert got == {0: (100, 5, None, None), 1: (100, 5, 102, 3), 2: (101, 1, 102, 3), 3: (100, 5, 102, 3)}


@pytest.mark.parametrize("name, operator", [("l14_bootstrap", "bootstrap_mean"), ("l15_cluster_contrast", "cluster_contrast"), ("l18_strategy_gate", "bootstrap_mean")])
def test_queries_draw_as_often_as_the_reference(spark, monkeypatch, name, operator):
    import inspect

    from tidebook.operators import stats
    from tidebook.plans import stats_q

    real, drawn = getattr(stats, operator), []

    def spy(*args, **more):
        bound = inspect.signature(real).bind(*args, **more)
        bound.apply_defaults()
        drawn.append(bound.arguments["iterations"])
        raise StopIteration

    monkeypatch.setattr(stats, operator, spy)
    with pytest.raises(StopIteration):
        getattr(stats_q, name)(spark, "/root/testdata/sf0.001")
    assert drawn == [10_000]


def test_snapshot_timing(spark):
    from tidebook.operators.integrity import snapshot_timing

    rows = [
        (1, 1, 100, 90, "snapshot", None, None, 10),
        (1, 2, 95, None, "diff", 94, 8, 10),  # covered, but the first that was received after the request
        (1, 3, 97, None, "diff", 96, 9, 12),  # bridges
        (1, 4, 100, None, "diff", 99, 13, 14),  # received with the response: the boundary
        (1, 5, 200, None, "diff", 199, 99, 99),  # not looked at any more
        (1, 6, 300, None, "snapshot", None, None, 50),
        (1, 7, 300, None, "diff", 299, 51, 52),  # not after the receipt
        (1, 8, 301, None, "diff", 301, 54, 55),  # breaks
        (1, 9, 400, None, "snapshot", None, None, 60),
        (2, 1, 10, None, "diff", 9, 1, 2),
    ]
    schema = "k int, seq int, recv_ms int, request_ms int, event_type string, time_ms int, first_update_id int, last_update_id int"
    got = [tuple(r) for r in snapshot_timing(spark.createDataFrame(rows, schema), ("k",)).orderBy("seq").collect()]
    assert got == [
        (1, 1, False, 90, 5, 96, 6, 97, True, 99, 100, 9, True, 2),
        (1, 6, True, 300, 1, 299, -1, 300, False, None, None, None, False, 1),
        (1, 9, True, 400, None, None, None, None, False, None, None, None, False, 0),
    ]
    assert snapshot_timing(spark.createDataFrame([], schema), ("k",)).count() == 0


def test_range_of_more_hours_than_an_int_has_milliseconds(spark):
    hour, n = 3_600_000, 700
    hours = spark.range(n).select((F.col("id") * hour).alias("hour_ms"), F.lit(True).alias("valid"))
    got = R.range_summary(R.valid_ranges(hours, []), []).first()
    assert (got["n_ranges"], got["longest"], got["first_ms"], got["last_ms"]) == (1, n, 0, (n - 1) * hour)


def found_text(rows):
    return sorted(str(tuple(v + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)  # without the sign of zero


def test_markouts_at_a_price_of_zero(spark, tmp_path):
    """Infinite or no number, as the SQL has them: bought and sold at zero, and at a mid of zero."""
    import duckdb

    from tidebook.registry import ORACLES, QUERIES

    rows = [("purchase", k, 0.0 if k < 6 else 1.0 + k) for k in range(60)] + [("view", k, 5.0 + k % 7) for k in range(300)]
    con = duckdb.connect()
    con.execute("create table given (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    # ids fall with time, so that the first row of a cluster isn't the one with the least id
    start = datetime(2024, 1, 1)
    given = [(1000 - i, start + timedelta(seconds=(i * 977) % 86400), i % 8, kind, value, f'{{"k": {k}}}') for i, (kind, k, value) in enumerate(rows)]
    con.executemany("insert into given values (?, ?, ?, ?, ?, ?)", given)
    con.execute(f"copy given to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    names = "f13_distribution f14_tail_shares f1_markout_summary f8_fill_rate_bins g5_tail_flags g5_tail_flags_by_window g7_e10_tail_clusters l1_markouts l23_cluster_rollup".split()
    for name in names:
        got = QUERIES[name](spark, str(tmp_path))
        cols = ", ".join(sorted(f'"{c}"' for c in got.columns))
        found, expected = [tuple(r[c.strip('"')] for c in cols.split(", ")) for r in got.collect()], con.execute(f"select {cols} from ({ORACLES[name]})").fetchall()
        assert len(found) > 1 and found_text(found) == found_text(expected), name


def test_open_loop_fills_meet_only_the_trades_around_them(spark):
    n = 2000
    orders = spark.range(n).select(F.col("id").alias("order_id"), F.lit(0).alias("session_id"), F.lit("buy").alias("side"), F.lit(1).alias("price"), (F.col("id") % 4 * 300 + 1).alias("qty"), F.col("id").alias("arrival_ms"), (F.col("id") % 3 * 7).alias("queue"))
    trades = spark.range(n).select(F.lit(0).alias("session_id"), F.lit(1).alias("price"), (F.col("id") / 2).cast("long").alias("time_ms"), F.col("id").alias("seq"), (F.col("id") % 5).alias("qty"), F.lit(True).alias("is_buyer_maker"))
    got = O.open_loop_fills(orders, trades)
    expected = []
    for o in orders.collect():
        lo, hi, at = o["queue"], o["queue"] + o["qty"], 0
        for t in range(n):
            if t // 2 > o["arrival_ms"]:
                fill = min(at + t % 5, hi) - max(at, lo)
                at += t % 5
                if fill > 0:
                    expected.append((o["order_id"], t // 2, fill))
    assert sorted((r["order_id"], r["time_ms"], r["fill_qty"]) for r in got.collect()) == sorted(expected)


def test_open_loop_fills_join_by_bucket(spark):
    """All orders with all later trades at the price would be 200 million rows here, of which each window holds thousands."""
    n = 20_000
    line = (F.lit(0).alias("session_id"), F.lit(1).alias("price"))
    orders = spark.range(n).select(F.col("id").alias("order_id"), *line, F.lit("buy").alias("side"), F.lit(2).alias("qty"), F.col("id").alias("arrival_ms"), F.lit(3).alias("queue"))
    trades = spark.range(n).select(*line, F.col("id").alias("time_ms"), F.col("id").alias("seq"), F.lit(50).alias("qty"), F.lit(True).alias("is_buyer_maker"))
    got = O.open_loop_fills(orders, trades)
    assert "__bucket" in got._jdf.queryExecution().executedPlan().toString()
    assert got.agg(F.count("*"), F.sum("fill_qty"), F.max(F.col("time_ms") - F.col("order_id"))).first() == (n - 1, 2 * (n - 1), 1)
