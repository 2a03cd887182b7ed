"""The replay loop and its Spark form.

Order within a millisecond: private arrivals due before it, all market data, the credit
for cancelled depth, then arrivals due at it. A millisecond that a gap taints is left out as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from decimal import Decimal
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import NAMES, Exchange, Settings
from .strategies import Noop

LEVELS = "array<struct<price: decimal(28,10), qty: decimal(28,10)>>"
#: Columns of an event stream, besides the session.
EVENT = f"time_ms long, kind int, seq long, event_type string, bids {LEVELS}, asks {LEVELS}, price decimal(28,10), qty decimal(28,10), is_buyer_maker boolean, has_gap boolean, dispatch boolean"
OUT = "what string, no long, time_ms long, id string, order_id string, side string, price string, qty string, fee string, is_maker boolean, detail map<string,string>"
FIELDS = [x.split()[0] for x in OUT.split(", ")]


class Replay:
    def __init__(self, settings: Settings, strategy: Noop, samples: bool = True):
        self.ex, self.strategy, self.samples = Exchange(settings), strategy, [] if samples else None
        self.in_gap = True
        self.stats: dict[str, int] = dict.fromkeys(
            "total_events snapshot_resyncs snapshots depth_diffs trade_events gaps_detected depth_gaps_detected trade_gaps_detected events_during_gap orders_submitted "
            "cancel_requests gap_invalidations replay_end_invalidations pending_actions_at_end pending_cancels_at_end fills".split(),
            0,
        )

    def _count(self, *names: str) -> None:
        for n in names:
            self.stats[n] += 1

    def _act(self, actions: Iterable, now: int) -> None:
        for a in actions:
            if a[0] == "cancel":
                self.stats["cancel_requests"] += self.ex.cancel(a[1], now)
            else:
                self._count("orders_submitted")
                self.strategy.on_placed(self.ex.submit(a[1], a[2], a[3], now))

    def _tell(self, fills: Iterable) -> None:
        for f in fills:
            self._count("fills")
            self._act(self.strategy.on_fill(f), f.time_ms)

    def _arrivals(self, until: int, inclusive: bool) -> None:
        while (made := self.ex.next_arrival(until, inclusive)) is not None:
            self._tell(made)

    def _enter_gap(self, now: int) -> None:
        if not self.in_gap:
            self.in_gap = True
            self.stats["gap_invalidations"] += self.ex.drop_all(now, "data_gap")

    def _tally(self, e: dict) -> None:
        kind = e["event_type"]
        self._count("total_events", {"resync": "snapshot_resyncs", "snapshot": "snapshots", "diff": "depth_diffs", "trade": "trade_events"}[kind])
        if e["has_gap"]:
            self._count("trade_gaps_detected" if kind == "trade" else "depth_gaps_detected")
            if kind != "trade" or self.ex.settings.trade_gaps_pause:
                self._count("gaps_detected")

    def run(self, events: Iterable[dict]) -> None:
        """``events`` in the order of (time_ms, kind, seq)."""
        now = None
        for now, group in groupby(events, key=lambda e: e["time_ms"]):
            batch = list(group)
            if any(e["has_gap"] and (e["kind"] == 0 or self.ex.settings.trade_gaps_pause) for e in batch):
                self._enter_gap(now)
                for e in batch:
                    self._tally(e)
                    self._count("events_during_gap")
                self._arrivals(now, True)
                continue
            self._arrivals(now, False)
            depth = False
            for e in batch:
                self._tally(e)
                if e["kind"] == 0:
                    depth |= self._depth(e, now)
                else:
                    self._trade(e, now)
            if depth:
                self.ex.settle_depth(now)
            self._arrivals(now, True)
        if now is not None:
            self.stats["pending_actions_at_end"], self.stats["pending_cancels_at_end"] = self.ex.pending()
            self.stats["replay_end_invalidations"] = self.ex.drop_all(now, "replay_end")

    def _depth(self, e: dict, now: int) -> bool:
        if e["event_type"] == "resync":
            self._enter_gap(now)
            return False
        if e["event_type"] == "snapshot":
            self.ex.book.replace(e["bids"], e["asks"])
            if self.in_gap:
                self.in_gap = False
                self.stats["gap_invalidations"] += self.ex.drop_all(now, "data_gap")
        elif self.in_gap:
            self._count("events_during_gap")
            return False
        else:
            self.ex.book.update(e["bids"], e["asks"])
        if not e["dispatch"]:
            return False
        top = self.ex.book.top
        if self.samples is not None and top is not None:
            self.samples.append((now, *top))
        self._act(self.strategy.on_book(self.ex.book, now), now)
        return True

    def _trade(self, e: dict, now: int) -> None:
        if self.in_gap:
            self._count("events_during_gap")
            return
        self._tell(self.ex.trade(e["price"], e["qty"], e["is_buyer_maker"], now))
        self._act(self.strategy.on_trade(e["price"], e["qty"], e["is_buyer_maker"], self.ex.book, now), now)

    def rows(self) -> Iterator[tuple]:
        ex = self.ex
        for i, f in enumerate(ex.fills):
            yield "fill", i, f.time_ms, f.id, f.order_id, NAMES[f.side], str(f.price), str(f.qty), str(f.fee), f.is_maker, None
        for i, (order, t, what, detail) in enumerate(ex.log):
            yield "event", i, t, what, order, None, None, None, None, None, detail
        for i, (t, b, bq, a, aq) in enumerate(self.samples or ()):
            yield "sample", i, t, None, None, None, None, None, None, None, {"bid": str(b), "bid_qty": str(bq), "ask": str(a), "ask_qty": str(aq)}
        for k, v in (self.stats | {k: ex.counts[k] for k in ("order_arrivals", "orders_cancelled", "cancels_too_late")}).items():
            yield "stat", v, None, k, None, None, None, None, None, None, None


def _levels(v) -> list[tuple[Decimal, Decimal]]:
    return [] if v is None else [(x["price"].normalize(), x["qty"]) if isinstance(x, dict) else (x[0].normalize(), x[1]) for x in v]


def events_of(pdf) -> list[dict]:
    """Plain events from a session's rows (pandas), in replay order."""
    rows = pdf.sort_values(["time_ms", "kind", "seq"], kind="stable").to_dict("records")
    for e in rows:
        if e["kind"] == 0:
            e["bids"], e["asks"] = _levels(e["bids"]), _levels(e["asks"])
        else:
            e["price"] = e["price"].normalize()
    return rows


def replay(
    events: DataFrame, strategy: Callable[[], Noop], settings: Sequence[Settings], by: Sequence[str] = ("session_id",), samples: bool = True
) -> DataFrame:
    """All outputs of every (session, configuration), told apart by ``what``; config_no indexes ``settings``.

    Sessions are independent and bounded in time (an hour, say), so each is one group; a grid of
    settings multiplies the groups, not the work of any.
    """
    grid = list(settings)

    def run(pdf):
        import pandas as pd

        no = int(pdf["config_no"].iloc[0])
        r = Replay(grid[no], strategy(), samples)
        r.run(events_of(pdf))
        got = pd.DataFrame(list(r.rows()), columns=FIELDS)
        for i, k in enumerate((*by, "config_no")):
            got.insert(i, k, pdf[k].iloc[0])
        return got

    keyed = events.withColumn("config_no", F.explode(F.array(*[F.lit(i) for i in range(len(grid))])))
    keys = "".join(f"{k} {events.schema[k].dataType.simpleString()}, " for k in by)
    return keyed.groupBy(*by, "config_no").applyInPandas(run, f"{keys}config_no int, {OUT}")


def _keys(out: DataFrame) -> list[str]:
    return out.columns[: out.columns.index("what")]


def fills(out: DataFrame) -> DataFrame:
    num = [F.col(c).cast("decimal(38,12)").alias(c) for c in ("price", "qty", "fee")]
    return out.filter("what = 'fill'").select(*_keys(out), F.col("no").alias("seq"), F.col("id").alias("fill_id"), "order_id", "side", *num, "is_maker", "time_ms")


def order_events(out: DataFrame) -> DataFrame:
    return out.filter("what = 'event'").select(*_keys(out), F.col("no").alias("seq"), "order_id", "time_ms", F.col("id").alias("event_type"), "detail")


def book_samples(out: DataFrame) -> DataFrame:
    cols = [F.col("detail")[c].cast("decimal(38,12)").alias(c) for c in ("bid", "bid_qty", "ask", "ask_qty")]
    return out.filter("what = 'sample'").select(*_keys(out), F.col("no").alias("seq"), "time_ms", *cols)


def replay_stats(out: DataFrame) -> DataFrame:
    return out.filter("what = 'stat'").select(*_keys(out), F.col("id").alias("stat"), F.col("no").alias("value"))
