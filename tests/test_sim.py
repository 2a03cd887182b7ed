"""The execution kernel on hand-checked cases, and a fuzz of its conservation laws."""

from decimal import Decimal as D
from random import Random

import pytest

from tidebook.sim.exchange import BUY, SELL, Exchange, Settings
from tidebook.sim.replay import Replay
from tidebook.sim.strategies import Noop, OfiGatedMaker, SymmetricMaker

BIDS = [(D(100), D(5)), (D(99), D(10))]
ASKS = [(D(101), D(3)), (D(102), D(8))]


def exchange(bids=BIDS, asks=ASKS, **more):
    ex = Exchange(Settings(latency_ms=0, **more))
    ex.book.replace(bids, asks)
    return ex


def arrive(ex, until):
    out = []
    while (made := ex.next_arrival(until, True)) is not None:
        out += made
    return out


def test_trade_drains_before_it_fills():
    ex = exchange()
    o = ex.submit(BUY, D(1), D(100), 0)
    arrive(ex, 0)
    assert o.ahead == 5
    assert ex.trade(D(100), D(2), True, 1) == [] and o.ahead == 3


def test_trade_beyond_the_queue_fills_the_rest():
    ex = exchange(bids=[(D(100), D(2))])
    o = ex.submit(BUY, D("0.5"), D(100), 0)
    arrive(ex, 0)
    (f,) = ex.trade(D(100), D(3), True, 1)
    assert (f.qty, f.price, f.is_maker, o.status) == (D("0.5"), D(100), True, "filled")
    assert f.fee == D("0.5") * 100 * 2 / 10_000


def test_trade_through_the_price_does_nothing():
    ex = exchange()
    ex.submit(BUY, D(1), D(100), 0)
    arrive(ex, 0)
    assert ex.trade(D(99), D(50), True, 1) == []


@pytest.mark.parametrize("trade, left, expected", [(None, 7, D(7)), (D(2), 5, D("5.6"))])
def test_cancellation_credit(trade, left, expected):
    ex = exchange(bids=[(D(100), D(10))], queue_credit="1")
    o = ex.submit(BUY, D(1), D(100), 0)
    arrive(ex, 0)
    if trade:
        ex.trade(D(100), trade, True, 1)
    ex.book.update([(D(100), D(left))], [])
    ex.settle_depth(1)
    assert o.ahead == expected


def test_no_credit_keeps_the_queue():
    ex = exchange(bids=[(D(100), D(10))], queue_credit="0")
    o = ex.submit(BUY, D(1), D(100), 0)
    arrive(ex, 0)
    ex.book.update([(D(100), D(1))], [])
    ex.settle_depth(1)
    assert o.ahead == 10


def test_two_own_orders_share_a_trade():
    ex = exchange(bids=[(D(99), D(1))])
    a, b = (ex.submit(BUY, D("0.5"), D(100), 0) for _ in range(2))
    arrive(ex, 0)
    assert [f.qty for f in ex.trade(D(100), D("0.6"), True, 1)] == [D("0.5"), D("0.1")]
    assert [f.qty for f in ex.trade(D(100), D("0.4"), True, 2)] == [D("0.4")]
    assert a.filled + b.filled == 1


def test_own_cancel_moves_the_later_order_up():
    ex = exchange()
    a, b = (ex.submit(BUY, D(1), D(100), 0) for _ in range(2))
    arrive(ex, 0)
    assert b.ahead == 6
    ex.cancel(a.id, 1)
    arrive(ex, 1)
    assert (a.status, b.ahead) == ("cancelled", 5)


def test_post_only_rejects_and_takers_walk_levels():
    ex = exchange()
    o = ex.submit(BUY, D(1), D(101), 0)
    arrive(ex, 0)
    assert o.status == "cancelled" and ex.counts["post_only_rejects"] == 1
    ex = exchange(post_only=False)
    ex.submit(BUY, D(5), D(102), 0)
    assert [(f.price, f.qty, f.is_maker) for f in arrive(ex, 0)] == [(D(101), D(3), False), (D(102), D(2), False)]
    o = ex.submit(BUY, D(9), None, 1)  # shares what is displayed until the next depth
    assert [f.qty for f in arrive(ex, 1)] == [D(6)] and o.status == "cancelled"


def test_cancel_arrives_no_earlier_than_its_order():
    ex = Exchange(Settings(latency_ms=50, cancel_latency_ms=0))
    ex.book.replace(BIDS, ASKS)
    o = ex.submit(BUY, D(1), D(100), 0)
    assert ex.cancel(o.id, 1) and not ex.cancel(o.id, 2)
    assert o.cancel_ms == 50
    arrive(ex, 50)
    assert o.status == "cancelled"


def event(t, kind, seq, what, **more):
    return {"time_ms": t, "kind": kind, "seq": seq, "event_type": what, "has_gap": False, "dispatch": True, "bids": [], "asks": []} | more


class Once(Noop):
    def __init__(self, cancel_at=None):
        self.sent = self.order = None
        self.cancel_at = cancel_at

    def on_book(self, book, now):
        if not self.sent:
            self.sent = True
            return [("submit", BUY, D(1), D(100))]
        return [("cancel", self.order.id)] if self.cancel_at == now else []

    def on_placed(self, order):
        self.order = order


def snapshot(t, seq):
    return event(t, 0, seq, "snapshot", bids=[(D(100), D(0)), (D(99), D(1))], asks=[(D(101), D(3))])


def test_equal_time_trade_beats_the_cancel():
    events = [snapshot(0, 0), event(10, 0, 1, "diff"), event(10, 1, 2, "trade", price=D(100), qty=D(1), is_buyer_maker=True)]
    r = Replay(Settings(latency_ms=0), Once(cancel_at=10))
    r.run(events)
    assert [f.time_ms for f in r.ex.fills] == [10] and r.stats["fills"] == 1
    assert r.ex.counts["cancels_too_late"] == 1


def test_gap_taints_its_whole_millisecond():
    events = [
        snapshot(0, 0), event(10, 0, 1, "diff", has_gap=True), event(10, 1, 2, "trade", price=D(100), qty=D(5), is_buyer_maker=True),
        event(11, 0, 3, "diff"), snapshot(20, 4),
    ]
    r = Replay(Settings(latency_ms=0), Once())
    r.run(events)
    assert r.ex.fills == [] and r.stats["gap_invalidations"] == 1 and r.stats["events_during_gap"] == 3
    assert [w for _, _, w, _ in r.ex.log] == ["placed", "arrived", "queued", "invalidated"]


def test_open_orders_expire_at_the_end():
    r = Replay(Settings(latency_ms=0), Once())
    r.run([snapshot(0, 0), event(5, 0, 1, "diff")])
    assert r.stats["replay_end_invalidations"] == 1 and r.ex.log[-1][2] == "expired"


def random_events(rng, n=250):
    events, t = [event(0, 0, 0, "snapshot", bids=[(D(100 - i), D(5)) for i in range(6)], asks=[(D(101 + i), D(5)) for i in range(6)])], 0
    for seq in range(1, n):
        t += rng.randrange(3)
        if rng.random() < 0.5:
            side = rng.choice(["bids", "asks"])
            price = D(100 - rng.randrange(6)) if side == "bids" else D(101 + rng.randrange(6))
            events.append(event(t, 0, seq, "diff", **{side: [(price, D(rng.randrange(8)))]}))
        else:
            events.append(event(t, 1, seq, "trade", price=D(rng.randrange(96, 106)), qty=D(rng.randrange(1, 9)), is_buyer_maker=rng.random() < 0.5))
    return sorted(events, key=lambda e: (e["time_ms"], e["kind"], e["seq"]))


@pytest.mark.parametrize("credit", ["0", "0.5", "1"])
@pytest.mark.parametrize("maker", [SymmetricMaker, OfiGatedMaker])
def test_fuzz_conserves_quantity_and_order(credit, maker):
    for seed in range(15):
        rng = Random(seed)
        events = random_events(rng)
        runs = []
        for _ in range(2):
            r = Replay(Settings(latency_ms=3, jitter_ms=2, queue_credit=credit), maker(D(1), D(2), D(8), tick="1", requote_ms=2))
            r.run(events)
            runs.append(([vars(f) for f in r.ex.fills], r.ex.log, r.stats))
        assert runs[0] == runs[1]
        volume = {}
        for e in events:
            if e["kind"] == 1:
                key = (e["time_ms"], e["price"], BUY if e["is_buyer_maker"] else SELL)
                volume[key] = volume.get(key, 0) + e["qty"]
        made = {}
        for f in r.ex.fills:
            if f.is_maker:
                made[f.time_ms, f.price, f.side] = made.get((f.time_ms, f.price, f.side), 0) + f.qty
        assert all(q <= volume[k] for k, q in made.items())
        assert abs(r.strategy.position) <= 8
        assert sum(f.side * f.qty for f in r.ex.fills) == r.strategy.position


def test_settings_are_checked():
    for bad in ({"latency_ms": -1}, {"jitter_ms": 20}, {"queue_credit": "1.5"}, {"cancel_latency_ms": 1, "cancel_jitter_ms": 2}):
        with pytest.raises(ValueError):
            Settings(**bad)
