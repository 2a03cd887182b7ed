"""Strategies: callbacks that answer market data and fills with actions.

An action is ("cancel", order id) or ("submit", side, quantity, price or None).
"""

from __future__ import annotations

from collections import deque
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

from .exchange import BUY, SELL, ZERO, Book, Fill, Order


class Noop:
    """Watches only: for book studies."""

    def on_book(self, book: Book, now: int) -> list:
        return []

    def on_trade(self, price: Decimal, qty: Decimal, buyer_is_maker: bool, book: Book, now: int) -> list:
        return []

    def on_fill(self, fill: Fill) -> list:
        return []

    def on_placed(self, order: Order) -> None:
        pass


class Maker(Noop):
    """Quotes both sides; subclasses say where in ``quotes``.

    A quote is replaced when its price changes, at most every ``requote_ms`` unless a side is
    missing or must go. Even if every working order filled, the position stays within
    ``max_position``.
    """

    def __init__(self, order_qty, max_position, tick="0.01", requote_ms: int = 0):
        self.qty, self.limit, self.tick = Decimal(str(order_qty)), Decimal(str(max_position)), Decimal(str(tick))
        if self.qty <= 0 or self.limit < 0 or self.tick <= 0 or requote_ms < 0:
            raise ValueError("quantities and tick must be positive, limits not negative")
        self.requote_ms = requote_ms
        self.quote: dict[int, Order | None] = {BUY: None, SELL: None}
        self.working: dict[str, Order] = {}
        self.position = self.fees = ZERO
        self.suppressed = 0
        self.last_ms: int | None = None

    def quotes(self, book: Book, now: int) -> tuple[Decimal | None, Decimal | None]:
        raise NotImplementedError

    def on_book(self, book: Book, now: int) -> list:
        top = book.top
        if top is None:
            return []
        wanted = dict(zip((BUY, SELL), self.quotes(book, now)))
        across = {BUY: top[2], SELL: top[0]}
        live = {side: o.price if o is not None and not o.done else None for side, o in self.quote.items()}
        for side in (BUY, SELL):
            p = wanted[side]
            if p is not None:
                p = (p / self.tick).to_integral_value(ROUND_FLOOR if side == BUY else ROUND_CEILING) * self.tick
                if side * (p - across[side]) >= 0:
                    self.suppressed += 1
                    p = None
            wanted[side] = self._within_limit(side, p, live[side])
        if self._holds(wanted, live, now):
            return []
        actions: list = []
        for side in (BUY, SELL):
            if wanted[side] == live[side]:
                continue
            old = self.quote[side]
            if old is not None and not old.done:
                if old.cancel_ms is None:
                    actions.append(("cancel", old.id))
                self.quote[side] = None
            if wanted[side] is not None:
                actions.append(("submit", side, self.qty, wanted[side]))
        if actions:
            self.last_ms = now
        return actions

    def on_placed(self, order: Order) -> None:
        self.working[order.id] = order
        self.quote[order.side] = order

    def on_fill(self, fill: Fill) -> list:
        self.position += fill.side * fill.qty
        self.fees += fill.fee
        if abs(self.position) > self.limit:
            raise RuntimeError("a fill went beyond the position limit")
        out = []
        for side in (BUY, SELL):
            if side * self.position + self._left(side) > self.limit:
                out += [("cancel", o.id) for o in self.working.values() if o.side == side and not o.done and o.cancel_ms is None]
        return out

    def _left(self, side: int) -> Decimal:
        self.working = {i: o for i, o in self.working.items() if not o.done}
        return sum((o.left for o in self.working.values() if o.side == side), ZERO)

    def _within_limit(self, side: int, price: Decimal | None, live: Decimal | None) -> Decimal | None:
        if price is None:
            return None
        worst = side * self.position + self._left(side)
        if worst > self.limit:
            return None
        return price if worst + (self.qty if price != live else ZERO) <= self.limit else None

    def _holds(self, wanted: dict, live: dict, now: int) -> bool:
        """Only a change of prices may wait; a missing side or one that must go may not."""
        if not self.requote_ms or self.last_ms is None or now - self.last_ms >= self.requote_ms:
            return False
        return all((wanted[s] is None) == (live[s] is None) for s in (BUY, SELL))


class SymmetricMaker(Maker):
    """Mid plus and minus half a spread."""

    def __init__(self, half_spread, order_qty, max_position, **more):
        super().__init__(order_qty, max_position, **more)
        self.half = Decimal(str(half_spread))

    def quotes(self, book: Book, now: int):
        b, _, a, _ = book.top
        mid = (b + a) / 2
        return mid - self.half, mid + self.half


class MicropriceMaker(SymmetricMaker):
    """Microprice plus and minus half a spread."""

    def quotes(self, book: Book, now: int):
        b, bq, a, aq = book.top
        if not bq + aq:
            return None, None
        fair = (bq * a + aq * b) / (bq + aq)
        return fair - self.half, fair + self.half


class OfiGatedMaker(MicropriceMaker):
    """Leaves out the side that recent order flow speaks against."""

    def __init__(self, half_spread, order_qty, max_position, ofi_ms: int = 1000, threshold="0.25", **more):
        super().__init__(half_spread, order_qty, max_position, **more)
        self.ofi_ms, self.threshold = ofi_ms, Decimal(str(threshold))
        if ofi_ms <= 0 or self.threshold <= 0:
            raise ValueError("the interval and the threshold must be positive")
        self.before: tuple | None = None
        self.steps: deque[tuple[int, Decimal, Decimal]] = deque()

    def quotes(self, book: Book, now: int):
        ofi = self._ofi(book.top, now)
        bid, ask = super().quotes(book, now)
        return (None if ofi <= -self.threshold else bid), (None if ofi >= self.threshold else ask)

    def _ofi(self, top, now: int) -> Decimal:
        b, bq, a, aq = top
        if self.before is not None and bq + aq > 0:
            pb, pbq, pa, paq = self.before
            e = (bq if b >= pb else ZERO) - (pbq if b <= pb else ZERO) - (aq if a <= pa else ZERO) + (paq if a >= pa else ZERO)
            self.steps.append((now, e, bq + aq))
        self.before = top
        while self.steps and self.steps[0][0] <= now - self.ofi_ms:
            self.steps.popleft()
        if not self.steps:
            return ZERO
        return sum(s[1] for s in self.steps) / (sum(s[2] for s in self.steps) / len(self.steps))
