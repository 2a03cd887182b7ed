"""Table functions for SQL: matched lots and imbalance samples of a stream.

A function says itself how its table is partitioned and ordered, so ``select * from fifo_lots(table(fills), 2, 5)``
is all that a caller writes. A session is read as a stream: state is its open lots, or the quotes of the last
interval and the samples whose horizon is still open.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

KINDS = {"long": LongType(), "double": DoubleType(), "string": StringType()}
BY, ORDER = [PartitioningColumn("session_id")], [OrderingColumn("time_ms"), OrderingColumn("seq")]


def _table(arg: AnalyzeArgument, needs: tuple[str, ...], out: str) -> AnalyzeResult:
    if not arg.isTable:
        raise ValueError("the first argument must be a table")
    if missing := [c for c in ("session_id", "time_ms", "seq", *needs) if c not in arg.dataType.names]:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    fields = [StructField(name, KINDS[kind]) for name, kind in (c.split() for c in out.split(","))]  # workers can't parse DDL
    return AnalyzeResult(schema=StructType(fields), partitionBy=BY, orderBy=ORDER)


class FifoLots:
    """fifo_lots(table(fills), maker_bps, taker_bps): session_id, open_fill_id, close_fill_id, open_side, open_ms, close_ms, qty, realized_pnl, total_fees."""

    def __init__(self) -> None:
        self.open: deque[list] = deque()

    @staticmethod
    def analyze(fills: AnalyzeArgument, maker_bps: AnalyzeArgument, taker_bps: AnalyzeArgument) -> AnalyzeResult:
        out = "session_id long, open_fill_id long, close_fill_id long, open_side string, open_ms long, close_ms long, qty long, realized_pnl double, total_fees double"
        return _table(fills, ("fill_id", "side", "price", "qty", "is_maker"), out)

    def eval(self, fill: Row, maker_bps: float, taker_bps: float) -> Iterator[tuple]:
        price, left, side = fill["price"], fill["qty"], fill["side"]
        per_unit = float(price) * float(maker_bps if fill["is_maker"] else taker_bps) / 10_000
        while left and self.open and self.open[0][0] != side:
            first = self.open[0]
            qty = min(left, first[1])
            gain = (price - first[2]) * (1 if first[0] == "buy" else -1) * qty
            yield fill["session_id"], first[3], fill["fill_id"], first[0], first[4], fill["time_ms"], qty, float(gain), (first[5] + per_unit) * qty
            left -= qty
            first[1] -= qty
            if not first[1]:
                self.open.popleft()
        if left:
            self.open.append([side, left, price, fill["fill_id"], fill["time_ms"], per_unit])


class OfiSamples:
    """ofi_samples(table(quotes), step_ms, ofi_ms, array(horizons)): the rows of ``operators.signals.ofi_samples``."""

    def __init__(self) -> None:
        self.quotes: deque[tuple] = deque()  # time, flow, depth, deep: running sums after each quote of the last interval
        self.last: tuple | None = None
        self.mid = 0.0
        self.at = -1
        self.points: deque[list] = deque()  # time, what is known at it, later mids by horizon
        self.next: int | None = None

    @staticmethod
    def analyze(quotes: AnalyzeArgument, step_ms: AnalyzeArgument, ofi_ms: AnalyzeArgument, horizons: AnalyzeArgument) -> AnalyzeResult:
        out = "session_id long, time_ms long, horizon_ms long, future_ms long, mid double, future_mid double, raw_ofi long, normalized_ofi double, drift_bps double"
        return _table(quotes, ("bid", "ask", "bid_qty", "ask_qty"), out)

    def _close(self, upto: int, ofi_ms: int) -> None:
        """What is known at the points before ``upto``: the imbalance of their interval and the mid."""
        for p in self.points:
            if p[0] >= upto or p[1] is not None:
                continue
            while len(self.quotes) > 1 and self.quotes[1][0] <= p[0] - ofi_ms:
                self.quotes.popleft()
            start = self.quotes[0] if self.quotes and self.quotes[0][0] <= p[0] - ofi_ms else None
            flow, depth, deep = (n - s for n, s in zip(self.quotes[-1][1:], start[1:])) if start else (0, 0, 0)
            p[1] = (self.mid, flow, flow / (depth / deep) if deep and depth else 0.0, self.at > 0)

    def _done(self, session: int) -> Iterator[tuple]:
        for p in self.points:
            if p[1] is not None:
                mid, flow, ratio, known = p[1]
                for h in [h for h, f in p[2].items() if f is not None]:
                    ms, later = p[2].pop(h)
                    if known:
                        yield session, p[0], h, ms, mid, later, flow, ratio, (later - mid) / mid * 10_000
        while self.points and self.points[0][1] is not None and not self.points[0][2]:
            self.points.popleft()

    def eval(self, quote: Row, step_ms: int, ofi_ms: int, horizons: list[int]) -> Iterator[tuple]:
        b, bq, a, aq, t = (quote[c] for c in ("bid", "bid_qty", "ask", "ask_qty", "time_ms"))
        if not (a + b > 0 and bq >= 0 and aq >= 0):
            return
        if self.next is None:
            self.next = -(-(t + ofi_ms) // step_ms) * step_ms
        while self.next <= t:
            self.points.append([self.next, None, dict.fromkeys(horizons)])
            self.next += step_ms
        self._close(t, ofi_ms)
        for p in self.points:
            for h, f in p[2].items():
                if f is None and p[0] + h <= t:
                    p[2][h] = (t, (a + b) / 2)
        yield from self._done(quote["session_id"])
        flow = 0
        if self.last is not None:
            ob, obq, oa, oaq = self.last
            flow = (bq if b >= ob else 0) - (obq if b <= ob else 0) - (aq if a <= oa else 0) + (oaq if a >= oa else 0)
        before = self.quotes[-1][1:] if self.quotes else (0, 0, 0)
        self.quotes.append((t, before[0] + flow, before[1] + bq + aq, before[2] + (bq + aq > 0)))
        self.last, self.mid, self.at, self.session = (b, bq, a, aq), (a + b) / 2, self.at + 1, quote["session_id"]
        self.ofi_ms = ofi_ms

    def terminate(self) -> Iterator[tuple]:
        if self.last is not None:
            self._close(self.quotes[-1][0] + 1, self.ofi_ms)
            yield from self._done(self.session)


def register(spark: SparkSession) -> None:
    """Make both functions known to the session's SQL."""
    for name, function in (("fifo_lots", FifoLots), ("ofi_samples", OfiSamples)):
        spark.udtf.register(name, udtf(function))
