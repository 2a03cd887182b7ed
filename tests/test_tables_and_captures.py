"""Table functions in SQL against the DataFrame forms, and hourly captures as a data source."""

import gzip
import hashlib
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidebook.adapters import view
from tidebook.functions import tables
from tidebook.operators import integrity as I
from tidebook.operators import pnl as P
from tidebook.operators import signals as G
from tidebook.sources import capture_source as C

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000


def close(a, b):
    key = lambda r: tuple(str(x) for x in r if not isinstance(x, float))
    a, b = sorted(map(tuple, a.collect()), key=key), sorted(map(tuple, b.collect()), key=key)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert key(x) == key(y)
        assert [v for v in x if isinstance(v, float)] == pytest.approx([v for v in y if isinstance(v, float)], rel=1e-9, abs=1e-9)


def test_lots_in_sql(spark):
    tables.register(spark)
    fills = view(spark, SF, "fills")
    got = spark.sql("select * from fifo_lots(table(select * from {fills}), 2, 5)", fills=fills)
    close(got, P.fifo_lots(fills, None, 2, 5).select(*got.columns[:7], F.col("realized_pnl").cast("double").alias("r"), "total_fees"))


def test_samples_in_sql(spark):
    tables.register(spark)
    quotes, horizons = view(spark, SF, "quotes"), [0, 600_000, 2 * HOUR]
    got = spark.sql("select * from ofi_samples(table(select * from {q}), 1800000, 3600000, array(0, 600000, 7200000))", q=quotes)
    close(got, G.ofi_samples(quotes, 1_800_000, HOUR, horizons).select(*got.columns))
    with pytest.raises(Exception, match="lacks"):
        spark.sql("select * from ofi_samples(table(select session_id from {q}), 1, 1, array(0))", q=quotes).collect()


def iso(ms):
    return datetime.fromtimestamp(ms / 1000, timezone.utc).isoformat()


def depth_line(seq, ms):
    if seq == 0:
        return {"recv_time": iso(ms), "request_time": iso(ms - 5), "type": "snapshot", "data": {"lastUpdateId": 9, "bids": [], "asks": []}}
    return {"recv_time": iso(ms), "data": {"E": ms, "U": seq * 10, "u": seq * 10 + 9, "b": [], "a": []}}


def test_hours_round_trip_prune_and_break_off(spark, tmp_path):
    root, start = str(tmp_path / "c"), 1_704_067_200_000
    lines = [(s, start + s * 400_000, json.dumps(depth_line(s, start + s * 400_000))) for s in range(40)]
    made = C.write_captures(spark.createDataFrame(lines, "seq long, time_ms long, line string"), root, "depth", "btcusdt").collect()
    assert len(made) == 5 and sum(r["lines"] for r in made) == 40
    rows = C.read_captures(spark, root, "depth")
    assert rows.rdd.getNumPartitions() == 5 and rows.filter("bad").count() == 0
    got = rows.orderBy("hour_ms", "seq").select("event_type", "recv_ms", "request_ms", "time_ms", "first_update_id", "last_update_id").collect()
    assert tuple(got[0]) == ("snapshot", start, start - 5, None, None, 9) and tuple(got[7]) == ("diff", start + 2_800_000, None, start + 2_800_000, 70, 79)
    by_file = {r["file"]: r["sha256"] for r in rows.select("file", "sha256").distinct().collect()}
    assert by_file == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / "c").iterdir()} == {r["file"]: r["sha256"] for r in made}
    some = rows.filter((F.col("hour_ms") >= start + HOUR) & (F.col("hour_ms") < start + 3 * HOUR))
    assert some.rdd.getNumPartitions() == 2 and some.count() == 18

    third = tmp_path / "c" / "btcusdt_depth_20240101_0200.jsonl.gz"
    third.write_bytes(third.read_bytes()[:-40])  # breaks off
    second = tmp_path / "c" / "btcusdt_depth_20240101_0100.jsonl.gz"
    second.write_bytes(gzip.compress(b"\n".join([json.dumps(depth_line(9, start)).encode(), b"", b"{not json", b"{}"])))
    trades = [(s, start + s * 900_000, json.dumps({"recv_time": iso(start), "data": {"T": start + s * 900_000, "a": s, "p": "1.5", "q": "2", "m": True}})) for s in range(20)]
    C.write_captures(spark.createDataFrame(trades, "seq long, time_ms long, line string"), root, "trade", "btcusdt").collect()
    depth = C.read_captures(spark, root, "depth")
    assert {r["hour_ms"] - start for r in depth.filter("bad").collect()} == {HOUR, 2 * HOUR}
    hours = spark.range(6).select((F.lit(start) + F.col("id") * HOUR).alias("hour_ms"), F.lit(True).alias("eligible"))
    for name, kind in (("depth_exists", "depth"), ("trade_exists", "trade")):
        there = C.read_captures(spark, root, kind).select("hour_ms").distinct().withColumn(name, F.lit(True))
        hours = hours.join(there, "hour_ms", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    d = depth.select("hour_ms", "seq", "event_type", F.col("first_update_id").alias("first_id"), F.col("last_update_id").alias("last_id"), "bad")
    t = C.read_captures(spark, root, "trade").select("hour_ms", "seq", "agg_trade_id", "bad")
    why = {(r["hour_ms"] - start) // HOUR: r["rejection_reasons"] for r in I.rejections(hours, d, t).collect()}
    assert why[0] == [] and why[1][0] == why[2][0] == "depth_decode_error" and why[5] == ["missing_depth_file", "missing_trade_file"]
