"""Passive execution of one session: latency, queues, fills and the order log.

Sides are +1 (buy) and -1 (sell). Resting orders are kept per (side, price) in the order
of their arrival, so a market event touches only the orders at its own price.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass, field
from decimal import Decimal
from random import Random

from ..functions.credit import parse_credit

ZERO = Decimal(0)
BUY, SELL = 1, -1
NAMES = {BUY: "buy", SELL: "sell"}
#: Fixed value: sets the cancel generator apart from the entry generator.
CANCEL_SEED = 0xC0FFEE
#: Round-off that decimal division of queues may leave, as a share of their size.
TOLERANCE = Decimal("1e-24")


@dataclass(frozen=True)
class Settings:
    """Execution model of a run. Cancels have the entry latency unless told otherwise."""

    latency_ms: int = 10
    jitter_ms: int = 0
    maker_bps: int = 2
    taker_bps: int = 5
    seed: int = 42
    post_only: bool = True
    queue_credit: str = "1"
    cancel_latency_ms: int | None = None
    cancel_jitter_ms: int | None = None
    trade_gaps_pause: bool = True

    def __post_init__(self) -> None:
        if self.cancel_latency_ms is None:
            object.__setattr__(self, "cancel_latency_ms", self.latency_ms)
        if self.cancel_jitter_ms is None:
            object.__setattr__(self, "cancel_jitter_ms", self.jitter_ms)
        for n in ("latency_ms", "jitter_ms", "cancel_latency_ms", "cancel_jitter_ms", "seed"):
            if type(getattr(self, n)) is not int or getattr(self, n) < 0:
                raise ValueError(f"{n} must be a non-negative integer")
        if self.jitter_ms > self.latency_ms or self.cancel_jitter_ms > self.cancel_latency_ms:
            raise ValueError("jitter can't exceed its latency")
        parse_credit(self.queue_credit)


class Book:
    """Two sides of price -> quantity with their best prices on lazily cleaned heaps."""

    def __init__(self) -> None:
        self.sides: dict[int, dict[Decimal, Decimal]] = {BUY: {}, SELL: {}}
        self.heaps: dict[int, list[Decimal]] = {BUY: [], SELL: []}

    def replace(self, bids, asks) -> None:
        for side, levels in ((BUY, bids), (SELL, asks)):
            self.sides[side] = {p: q for p, q in levels if q > 0}
            self.heaps[side] = [-side * p for p in self.sides[side]]
            heapq.heapify(self.heaps[side])

    def update(self, bids, asks) -> None:
        for side, levels in ((BUY, bids), (SELL, asks)):
            own, heap = self.sides[side], self.heaps[side]
            for p, q in levels:
                if q > 0:
                    if p not in own:
                        heapq.heappush(heap, -side * p)
                    own[p] = q
                else:
                    own.pop(p, None)

    def best(self, side: int) -> Decimal | None:
        own, heap = self.sides[side], self.heaps[side]
        while heap and -side * heap[0] not in own:
            heapq.heappop(heap)
        return -side * heap[0] if heap else None

    def qty(self, side: int, price: Decimal) -> Decimal:
        return self.sides[side].get(price, ZERO)

    def levels(self, side: int) -> list[tuple[Decimal, Decimal]]:
        return sorted(self.sides[side].items(), key=lambda x: -side * x[0])

    @property
    def top(self) -> tuple[Decimal, Decimal, Decimal, Decimal] | None:
        """(bid, bid quantity, ask, ask quantity) if both sides are there."""
        b, a = self.best(BUY), self.best(SELL)
        return None if b is None or a is None else (b, self.sides[BUY][b], a, self.sides[SELL][a])


@dataclass
class Order:
    id: str
    side: int
    price: Decimal | None  # None: market order
    qty: Decimal
    placed_ms: int
    arrival_ms: int
    status: str = "pending"  # pending, resting, then filled, cancelled, invalidated or expired
    filled: Decimal = ZERO
    external: Decimal = ZERO
    own: Decimal = ZERO
    rank: int | None = None
    cancel_ms: int | None = None
    asked_ms: int | None = None

    @property
    def left(self) -> Decimal:
        return self.qty - self.filled

    @property
    def ahead(self) -> Decimal:
        return self.external + self.own

    @property
    def done(self) -> bool:
        return self.status not in ("pending", "resting")


@dataclass
class Fill:
    id: str
    order_id: str
    side: int
    price: Decimal
    qty: Decimal
    is_maker: bool
    time_ms: int
    fee: Decimal


@dataclass
class Exchange:
    settings: Settings
    book: Book = field(default_factory=Book)

    def __post_init__(self) -> None:
        s = self.settings
        self.credit = parse_credit(s.queue_credit)
        self.rate = {True: Decimal(s.maker_bps) / 10_000, False: Decimal(s.taker_bps) / 10_000}
        self.entry_rng, self.cancel_rng = Random(s.seed), Random(s.seed ^ CANCEL_SEED)
        self.orders: dict[str, Order] = {}
        self.open: dict[str, Order] = {}
        self.resting: dict[tuple[int, Decimal], list[Order]] = {}
        self.agenda: list[tuple[int, int, str, str]] = []
        self.displayed: dict[tuple[int, Decimal], Decimal] = {}
        self.traded: dict[tuple[int, Decimal], Decimal] = defaultdict(Decimal)
        self.consumed: dict[tuple[int, Decimal], Decimal] = defaultdict(Decimal)
        self.fills: list[Fill] = []
        self.log: list[tuple[str, int, str, dict[str, str]]] = []
        self.counts: dict[str, int] = defaultdict(int)
        self.ranks = 0

    def note(self, what: str, order: Order, now: int, **detail) -> None:
        self.log.append((order.id, now, what, {k: str(v) for k, v in detail.items()}))

    # --- requests ---

    def submit(self, side: int, qty: Decimal, price: Decimal | None, now: int) -> Order:
        if side not in NAMES or not qty.is_finite() or qty <= 0 or (price is not None and (not price.is_finite() or price <= 0)):
            raise ValueError("an order needs a side, a positive quantity and a positive price or none")
        s = self.settings
        arrival = now + s.latency_ms + self.entry_rng.randint(-s.jitter_ms, s.jitter_ms)
        order = Order(f"ord-{len(self.orders) + 1:06d}", side, price, qty, now, arrival)
        self.orders[order.id] = self.open[order.id] = order
        self.note("placed", order, now, side=NAMES[side], type="market" if price is None else "limit", price=price, qty=qty, arrival_ms=arrival)
        self._plan(arrival, "enter", order)
        return order

    def cancel(self, order_id: str, now: int) -> bool:
        """Ask for a cancel; False if there is nothing to ask for. The order can fill until the request arrives."""
        order = self.orders.get(order_id)
        if order is None or order.done or order.cancel_ms is not None:
            return False
        s = self.settings
        at = now + s.cancel_latency_ms + self.cancel_rng.randint(-s.cancel_jitter_ms, s.cancel_jitter_ms)
        order.cancel_ms, order.asked_ms = max(at, order.arrival_ms), now
        self.note("cancel_requested", order, now, arrival_ms=order.cancel_ms)
        self._plan(order.cancel_ms, "cancel", order)
        return True

    def _plan(self, at: int, what: str, order: Order) -> None:
        heapq.heappush(self.agenda, (at, self.counts["planned"], what, order.id))
        self.counts["planned"] += 1

    def pending(self) -> tuple[int, int]:
        """(actions, cancels) still on their way."""
        live = [w for t, _, w, i in self.agenda if (self.orders[i].status == "pending" if w == "enter" else self.orders[i].cancel_ms == t)]
        return len(live), live.count("cancel")

    # --- arrivals ---

    def next_arrival(self, until: int, inclusive: bool) -> list[Fill] | None:
        """Process one arrival due before ``until`` (or at it); None if there is none."""
        if not self.agenda or self.agenda[0][0] > until or (self.agenda[0][0] == until and not inclusive):
            return None
        now, _, what, order_id = heapq.heappop(self.agenda)
        order = self.orders[order_id]
        if what == "enter":
            return self._enter(order, now) if order.status == "pending" else []
        if order.cancel_ms != now:  # invalidated meanwhile
            return []
        order.cancel_ms = None
        if order.done:
            self.counts["cancels_too_late"] += 1
            self.note("cancel_too_late", order, now, status=order.status)
            return []
        self._release(order, now)
        self._close(order, "cancelled")
        self.counts["orders_cancelled"] += 1
        self.note("cancelled", order, now, requested_ms=order.asked_ms)
        return []

    def _enter(self, order: Order, now: int) -> list[Fill]:
        self.counts["order_arrivals"] += 1
        self.note("arrived", order, now)
        across = self.book.best(-order.side)
        if order.price is None:
            return self._take(order, now)
        if across is not None and order.side * (order.price - across) >= 0:
            if not self.settings.post_only:
                return self._take(order, now)
            self._close(order, "cancelled")
            self.counts["post_only_rejects"] += 1
            self.note("cancelled", order, now, reason="post_only_would_cross", price=order.price, best_bid=self.book.best(BUY), best_ask=self.book.best(SELL))
            return []
        key = (order.side, order.price)
        line = self.resting.setdefault(key, [])
        visible = self.displayed[key] = self.book.qty(*key)
        order.own = sum((o.left for o in line), ZERO)
        # it stands behind all that is shown and ours, and never before the end of an earlier own order's stretch
        order.external = max([visible + order.own, *(o.ahead + o.left for o in line)]) - order.own
        self.ranks += 1
        order.rank, order.status = self.ranks, "resting"
        line.append(order)
        self.note(
            "queued", order, now, price=order.price, queue_ahead=order.ahead, external_queue_ahead=order.external, own_queue_ahead=order.own,
            visible_queue_at_arrival=visible, fifo_floor_adjustment=order.external - visible,
        )
        return []

    def _take(self, order: Order, now: int) -> list[Fill]:
        made = []
        for price, shown in self.book.levels(-order.side):
            if not order.left or (order.price is not None and order.side * (price - order.price) > 0):
                break
            qty = min(order.left, shown - self.consumed[-order.side, price])
            if qty > 0:
                made.append(self._fill(order, price, qty, False, now))
                self.consumed[-order.side, price] += qty
        if order.left:
            self._close(order, "cancelled")
            self.note("cancelled", order, now, reason="insufficient_liquidity", filled_qty=order.filled)
        else:
            self._close(order, "filled")
            self.note("filled", order, now, fills=len(made))
        return made

    def _fill(self, order: Order, price: Decimal, qty: Decimal, maker: bool, now: int) -> Fill:
        f = Fill(f"fill-{len(self.fills) + 1:06d}", order.id, order.side, price, qty, maker, now, qty * price * self.rate[maker])
        self.fills.append(f)
        order.filled += qty
        return f

    # --- market data ---

    def trade(self, price: Decimal, qty: Decimal, buyer_is_maker: bool, now: int) -> list[Fill]:
        """A recorded trade takes the first ``qty`` units of the line at exactly its price.

        An order of ours is a stretch of that line, from ``ahead`` on; what the taken units overlap of it is filled. What is
        left before it is as much shorter, and ours in it by what earlier own orders were filled.
        """
        key = (BUY if buyer_is_maker else SELL, price)
        self.traded[key] += qty
        made, ours = [], ZERO
        for order in [*self.resting.get(key, ())]:
            stood, external, own = order.ahead, order.external, order.own
            overlap = max(ZERO, min(order.left, qty - max(stood, ours)))
            before = max(ZERO, stood - qty)
            order.own = min(before, max(ZERO, own - ours))
            order.external = before - order.own
            if before < stood:
                self.note(
                    "queue_drain", order, now, reason="trade", price=price, trade_qty=qty, drained_qty=stood - before, external_drained_qty=external - order.external,
                    own_drained_qty=own - order.own, queue_before=stood, queue_after=before,
                )
            if overlap:
                made.append(self._fill(order, price, overlap, True, now))
                ours += overlap
                more = {"fill_qty": overlap, "fill_price": price, "trade_qty": qty, "queue_ahead_before_trade": stood, "queue_ahead_before_fill": before}
                if order.left:
                    self.note("partial_fill", order, now, filled=order.filled, remaining=order.left, **more)
                else:
                    self._close(order, "filled")
                    self.note("filled", order, now, **more)
        self._check_queue(key)
        return made

    def _check_queue(self, key) -> None:
        queue = self.resting.get(key, ())
        for a, b in zip(queue, queue[1:]):
            slack = TOLERANCE * max(Decimal(1), a.ahead, a.left, b.ahead)
            if b.ahead + slack < a.ahead + a.left:
                raise RuntimeError(f"{b.id} would stand before the end of {a.id}")

    def settle_depth(self, now: int) -> None:
        """After all events of a millisecond with depth: what left a level without a trade moves our orders up by the credit."""
        for key in list(self.resting):
            shown = self.book.qty(*key)
            before = self.displayed.get(key, shown)
            self.displayed[key] = shown
            if not self.credit or shown >= before or before <= 0:
                continue
            share = max(ZERO, before - shown - self.traded.get(key, ZERO)) / before * self.credit
            for order in self.resting[key] if share > 0 else ():
                if order.external <= 0:
                    continue
                ahead = order.ahead
                order.external = max(ZERO, order.external * (1 - share))
                if ahead > order.ahead:
                    self.note(
                        "queue_drain", order, now, reason="cancellation", price=key[1], prev_book_qty=before, new_book_qty=shown, cancel_frac=share,
                        drained_qty=ahead - order.ahead, queue_before=ahead, queue_after=order.ahead,
                    )
        self.displayed = {k: v for k, v in self.displayed.items() if k in self.resting}
        self.traded.clear()
        self.consumed.clear()

    def drop_all(self, now: int, reason: str) -> int:
        """Invalidate every open order at a gap, or expire it at the end; what is on its way becomes void."""
        status = "expired" if reason == "replay_end" else "invalidated"
        gone = list(self.open.values())
        for order in gone:
            self._release(order, now)
            self._close(order, status)
            order.cancel_ms = None
            self.note(status, order, now, reason=reason)
        self.displayed.clear()
        self.traded.clear()
        self.consumed.clear()
        return len(gone)

    # --- queues ---

    def _release(self, order: Order, now: int) -> None:
        """Later own orders at the price move up by what this one leaves."""
        if order.status != "resting" or not order.left:
            return
        for later in self.resting[order.side, order.price]:
            if later.rank > order.rank and (freed := min(order.left, later.own)) > 0:
                ahead = later.ahead
                later.own -= freed
                self.note(
                    "queue_drain", later, now, reason="own_order_cancel", ahead_order_id=order.id, drained_qty=freed, queue_before=ahead, queue_after=later.ahead
                )

    def _close(self, order: Order, status: str) -> None:
        key = (order.side, order.price)
        if order.status == "resting":
            queue = self.resting[key]
            queue.remove(order)
            if not queue:
                del self.resting[key]
                self.displayed.pop(key, None)
        self.open.pop(order.id, None)
        order.status = status
