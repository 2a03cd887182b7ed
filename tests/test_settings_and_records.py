"""Credits, provenance checks, guards and means of queues."""

from decimal import Decimal

import pytest

from tidebook.functions import credit
from tidebook.operators import records as R
from tidebook.operators import streams as S
from tidebook.sources import captures as C


def test_credit_names_and_suffixes():
    assert [credit.parse_credit(x) for x in ("0.00", 1, "0.25", -0.0)] == [0, 1, Decimal("0.25"), 0]
    assert str(credit.parse_credit("0.000")) == "0"
    assert (credit.from_legacy("none"), credit.from_legacy("proportional")) == (0, 1)
    assert [credit.to_legacy(x) for x in (0, "1.0", "0.5")] == ["none", "proportional", None]
    assert [credit.suffix(x) for x in (1, "1.00", 0, "0.50")] == ["", "", "_qc0", "_qc0.5"]
    for bad in ("x", "1.01", -1, "NaN", None):
        with pytest.raises(ValueError):
            credit.parse_credit(bad)
    with pytest.raises(ValueError):
        credit.from_legacy("half")


def test_provenance_is_checked_before_use(spark, tmp_path):
    root = f"{tmp_path}/run"
    C.write_results({"t": spark.range(3)}, root, {"model": 2, "gap": "pause", "seed": 5})
    assert C.read_results(spark, root, ["t"], {"model": 2, "seed": lambda s: s >= 0})[0]["t"].count() == 3
    with pytest.raises(ValueError, match="model is 2; policy is missing"):
        C.read_results(spark, root, ["t"], {"model": 3, "gap": "pause", "policy": "x"})


def test_symbols_are_listed_and_bars_filtered(spark, tmp_path):
    bars = spark.sql("select timestamp '2024-01-01' + make_interval(0, 0, 0, id) as open_time, 1D open, 2D high, 0D low, 1D close, 5D volume from range(6)")
    for name in ("btcusdt_1h", "ethusdt_1h"):
        bars.toPandas().to_csv(tmp_path / f"{name}.csv", index=False)
    assert C.list_symbols(spark, str(tmp_path), "*_1h.csv") == ["btcusdt_1h.csv", "ethusdt_1h.csv"]
    assert C.list_symbols(spark, str(tmp_path), "none*") == []
    got = C.read_bars(spark, f"{tmp_path}/btcusdt_1h.csv", "2024-01-02", "2024-01-04")
    assert [str(r["day"])[:10] for r in got.orderBy("day").collect()] == ["2024-01-02", "2024-01-03", "2024-01-04"]


def test_guard_across_chunks(spark):
    rows = spark.range(100).selectExpr("0 as session_id", "id as seq", "if(id = 60, 58, id) as time_ms")
    with pytest.raises(Exception, match="not monotone"):
        S.require_monotone(rows, chunk=20).collect()
    assert S.require_monotone(rows.filter("seq <> 60"), chunk=20).count() == 99


def test_queue_means(spark):
    schema = "order_id string, queue_at_arrival double, first_fill_ms long, drained_by_trade double, drained_by_cancellation double, drained_by_own_order_cancel double"
    rows = [("a", 4.0, 5, 3.0, 1.0, 0.0), ("b", 8.0, None, 2.0, 0.0, 1.0), ("c", 6.0, 9, 6.0, 0.5, 0.0), ("d", None, 7, 0.0, 0.0, 0.0)]
    got = R.queue_means(spark.createDataFrame(rows, schema)).first()
    assert tuple(got) == (4, 3, 5.0, 11.0, 1.5)


def test_records_without_lots_and_with_unknown_mids(spark):
    pnl = spark.createDataFrame([(1, 2, 5.0, 3.0, -4), (2, 1, -1.0, 0.5, 1)], "session_id int, n_fills int, net_pnl double, inventory_pnl double, position int")
    lots = spark.createDataFrame([(1, 2.0, 3, 1.0, None, 6)], "session_id int, net_pnl double, realized_pnl int, total_fees double, inventory_pnl double, qty int")
    fills = spark.createDataFrame([(1, 7, True), (1, 8, False), (2, 9, True)], "session_id int, order_id int, is_maker boolean")
    got = {r["session_id"]: r for r in R.session_records(pnl, lots, fills).collect()}
    assert got[1]["residual_inventory_pnl"] is None and got[1]["orders_per_fill"] == 1.0 and got[1]["abs_residual_inventory"] == 4
    assert got[2]["residual_inventory_pnl"] == 0.5 and got[2]["matched_net_pnl"] == 0 and got[2]["maker_fills"] == 1
