"""Book state by dyadic runs: equal to a book kept by a loop, with n log n rows on the way."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidebook.operators import book as B

SCHEMA = "session_id int, segment_id int, seq long, side string, price long, qty long"


def updates(n, seed=1, step=1):
    rng = random.Random(seed)
    return [(0, s % 2, 7 + s * step, rng.choice(["bid", "ask"]), rng.randrange(100, 140), rng.choice([0, 0, 1, 2, 3])) for s in range(n)]


def books(rows):
    """(segment, seq, {side: {price: qty}}) after each update."""
    held = {}
    for _, seg, seq, side, price, qty in rows:
        book = held.setdefault(seg, {"bid": {}, "ask": {}})
        book[side].pop(price, None)
        if qty:
            book[side][price] = qty
        yield seg, seq, {s: dict(b) for s, b in book.items()}


@pytest.mark.parametrize(("n", "step"), [(1, 1), (2, 5), (400, 1), (300, 13)])
def test_book_equals_a_loop(spark, n, step):
    rows = updates(n, n, step)
    u = spark.createDataFrame(rows, SCHEMA).repartition(3)
    probes = u.select("session_id", "segment_id", "seq")
    best, counts, top, full = {}, {}, set(), set()
    for seg, seq, book in books(rows):
        bids, asks = sorted(book["bid"].items(), reverse=True), sorted(book["ask"].items())
        if bids or asks:
            best[seg, seq] = (*(bids[0] if bids else (None, None)), *(asks[0] if asks else (None, None)))
            counts[seg, seq] = (len(bids), len(asks))
        for name, levels in (("bid", bids), ("ask", asks)):
            top |= {(seg, seq, name, r, *level) for r, level in enumerate(levels[:3], 1)}
            full |= {(seg, seq, name, *level) for level in levels}
    got = B.best_quotes(u).collect()
    assert {(r[1], r[2]): tuple(r)[3:] for r in got} == best
    assert {(r[1], r[2]): tuple(r)[3:] for r in B.depth_counts(probes, u).collect()} == counts
    assert {tuple(r)[1:] for r in B.top_levels(probes, u, 3).collect()} == top
    levels = B.levels_at(probes, u).select("segment_id", "seq", "book_side", "price", "qty").collect()
    assert len(levels) == len(full) and {tuple(r) for r in levels} == full


def test_rows_grow_as_n_log_n_in_a_long_segment(spark):
    """Levels that live for the whole segment, which any join of lifetimes with probes would meet n times each."""
    for n in (2_000, 8_000):
        rows = spark.range(n).selectExpr("0 as session_id", "0 as segment_id", "id as seq", "if(id % 2 = 0, 'bid', 'ask') as side", "id as price", "1L as qty")
        ends = B.ends_of(rows)
        limit = n * (math.log2(n) + 1)
        assert B.dyadic_probes(rows.select("session_id", "segment_id", "seq"), ends).count() <= limit
        assert B.dyadic_lives(B.lifetimes(rows), ends).count() <= 2 * limit
        best = B.best_quotes(rows).agg(F.count("*").alias("n"), F.sum("bid").alias("bid"), F.sum("ask").alias("ask")).first()
        assert (best["n"], best["bid"], best["ask"]) == (n, sum(s - s % 2 for s in range(n)), n - 1)
