"""The same semantics on streams: watermarked bars, gap marks and a stateful book."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(trades: DataFrame, every: str = "1 hour", late: str = "0 seconds", by: str = "session_id") -> DataFrame:
    """Open, high, low, close and volume of each tumbling window; ``trades`` has a timestamp ``ts``."""
    w = F.window("ts", every)
    got = trades.withWatermark("ts", late).groupBy(by, w).agg(
        F.min_by("price", F.struct("ts", "seq")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", F.struct("ts", "seq")).alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("n"),
    )
    return got.select(by, F.col("window.start").alias("start"), "open", "high", "low", "close", "volume", "n")


def tail_sessions(rows: DataFrame, gap: str, late: str = "0 seconds", by: str = "session_id") -> DataFrame:
    """Clusters of rows no more than ``gap`` apart."""
    got = rows.withWatermark("ts", late).groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("metric").alias("metric_sum"))
    return got.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "metric_sum")


def best_quotes(updates: DataFrame) -> DataFrame:
    """Best quotes after each update; the book of a session is its state. Updates of a batch are applied in the order of ``seq``.

    State is one JSON text per session: side -> price -> quantity.
    """

    def step(key, batches, state):
        import pandas as pd

        book = json.loads(state.get[0]) if state.exists else {"bid": {}, "ask": {}}
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, side, price, qty in zip(rows["seq"], rows["side"], rows["price"], rows["qty"]):
            if qty > 0:
                book[side][str(price)] = int(qty)
            else:
                book[side].pop(str(price), None)
            bid = max(map(int, book["bid"]), default=None)
            ask = min(map(int, book["ask"]), default=None)
            out.append((key[0], seq, bid, book["bid"].get(str(bid)), ask, book["ask"].get(str(ask))))
        state.update((json.dumps(book),))
        yield pd.DataFrame(out, columns=["session_id", "seq", "bid", "bid_qty", "ask", "ask_qty"]).astype("Int64")

    return updates.groupBy("session_id").applyInPandasWithState(
        step, "session_id long, seq long, bid long, bid_qty long, ask long, ask_qty long", "book string", "append", "NoTimeout"
    )


def trade_gaps(trades: DataFrame) -> DataFrame:
    """Gap marks of trade ids across batches; the last id of a session is its state."""

    def step(key, batches, state):
        import pandas as pd

        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        ids = rows["agg_trade_id"].tolist()
        gaps = [last is not None and ids[0] != last + 1] + [b != a + 1 for a, b in zip(ids, ids[1:])]
        state.update((int(ids[-1]),))
        yield pd.DataFrame({"session_id": key[0], "seq": rows["seq"], "has_gap": gaps})

    return trades.groupBy("session_id").applyInPandasWithState(step, "session_id long, seq long, has_gap boolean", "last long", "append", "NoTimeout")
