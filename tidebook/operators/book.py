"""Order-book state as level lifetimes.

A level's update holds until the next one of the same (segment, side, price), so the
book at any moment is the set of lifetimes that cover it: no state is carried from
row to row, and segments are independent. Lifetimes are cut into aligned runs of
2^level events; a moment lies in one run of each level, so probes and lifetimes meet
by an equi-join, and aggregates of the book need one row per run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof

SEGMENT = ("session_id", "segment_id")


def lifetimes(updates: DataFrame, by: Sequence[str] = SEGMENT) -> DataFrame:
    """keys, side, price, qty, from_seq, to_seq (exclusive, null if open); deleted levels have none.

    ``updates``: keys, seq, side, price, qty, and pos if one message may repeat a price (the last one wins).
    """
    order = ["seq", *(["pos"] if "pos" in updates.columns else [])]
    w = Window.partitionBy(*by, "side", "price").orderBy(*order)
    rows = updates.withColumn("to_seq", F.lead("seq").over(w))
    return rows.filter((F.col("qty") > 0) & (F.col("to_seq").isNull() | (F.col("to_seq") > F.col("seq")))).select(
        *by, "side", "price", "qty", F.col("seq").alias("from_seq"), "to_seq"
    )


def ends_of(updates: DataFrame, by: Sequence[str] = SEGMENT) -> DataFrame:
    """keys, __end (past the last event) and __bits (of the longest dyadic run a probe can meet) of each segment."""
    ends = updates.groupBy(*by).agg((F.max("seq") + 1).alias("__end"), F.min("seq").alias("__start"))
    return ends.select(*by, "__end", F.floor(F.log2(F.greatest(F.col("__end") - F.col("__start"), F.lit(1)))).cast("int").alias("__bits"))


def dyadic_lives(lives: DataFrame, ends: DataFrame, by: Sequence[str] = SEGMENT) -> DataFrame:
    """Each lifetime in aligned runs of 2^level events, ``node`` being the run's number at its level: two for each level at most.

    Every moment of a lifetime lies in exactly one of its runs.
    """
    keys = list(by)
    end = F.coalesce("to_seq", F.greatest("__end", F.col("from_seq") + 1))
    spans = lives.join(ends, keys).withColumn("__to", end).withColumn("level", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("__to") - F.col("from_seq"))).cast("int"))))
    spans = spans.withColumns({"__lo": F.expr("(from_seq + shiftleft(1L, level) - 1) div shiftleft(1L, level)"), "__hi": F.expr("__to div shiftleft(1L, level)")})
    runs = spans.filter("__lo < __hi").withColumn("node", F.explode(F.expr("array(if(__lo % 2 = 1, __lo, null), if(__hi % 2 = 1, __hi - 1, null))")))
    return runs.filter("node is not null").select(*lives.columns, "level", "node")


def dyadic_probes(probes: DataFrame, ends: DataFrame, by: Sequence[str] = SEGMENT, at: str = "seq") -> DataFrame:
    """Each probe once for every level, with the number of the run that holds it."""
    cut = probes.join(ends, list(by)).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("__bits")))).drop("__end", "__bits")
    return cut.withColumn("node", F.expr(f"{at} div shiftleft(1L, level)"))


def levels_at(probes: DataFrame, updates: DataFrame, by: Sequence[str] = SEGMENT, at: str = "seq") -> DataFrame:
    """Every level of the book at each probe. Runs and probes meet by equality, so only true pairs are made."""
    ends = ends_of(updates, by)
    lives = dyadic_lives(lifetimes(updates, by), ends, by).withColumnRenamed("side", "book_side").drop("from_seq", "to_seq")
    return dyadic_probes(probes, ends, by, at).join(lives, [*by, "level", "node"]).drop("level", "node")


def summed_at(probes: DataFrame, updates: DataFrame, merge: Mapping[str, tuple[Column, Column]], by: Sequence[str] = SEGMENT, at: str = "seq") -> DataFrame:
    """An aggregate over the book at each probe without listing the book: of each run first, then of the runs that hold the probe.

    ``merge``: by name the aggregate over levels (side, price, qty), and the one over these results.
    A segment of n events has some n log n runs and probes; they meet by equality and a run is one row.
    """
    ends = ends_of(updates, by)
    runs = dyadic_lives(lifetimes(updates, by), ends, by).groupBy(*by, "level", "node").agg(*[first.alias(n) for n, (first, _) in merge.items()])
    met = dyadic_probes(probes, ends, by, at).join(runs, [*by, "level", "node"])
    return met.groupBy(*probes.columns).agg(*[then.alias(n) for n, (_, then) in merge.items()])


def best_quotes(updates: DataFrame, by: Sequence[str] = SEGMENT) -> DataFrame:
    """Best bid and ask with quantities after each update."""
    level = F.struct("price", "qty")
    best = {
        "__bid": (F.max(F.when(F.col("side") == "bid", level)), F.max("__bid")),
        "__ask": (F.min(F.when(F.col("side") == "ask", level)), F.min("__ask")),
    }
    found = summed_at(updates.select(*by, "seq"), updates, best, by)
    return found.select(
        *by,
        "seq",
        F.col("__bid.price").alias("bid"),
        F.col("__bid.qty").alias("bid_qty"),
        F.col("__ask.price").alias("ask"),
        F.col("__ask.qty").alias("ask_qty"),
    )


def best_quotes_by_kernel(updates: DataFrame, by: Sequence[str] = SEGMENT) -> DataFrame:
    """The same by one pass over each segment in Arrow batches; best for long segments."""

    def run(pdf):
        import heapq

        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["seq", "pos"] if "pos" in pdf else ["seq"])
        books: dict[str, dict] = {"bid": {}, "ask": {}}
        heaps: dict[str, list] = {"bid": [], "ask": []}
        out = []
        seqs = pdf["seq"].to_numpy()
        last = np.append(seqs[1:] != seqs[:-1], True)
        for seq, side, price, qty, final in zip(seqs, pdf["side"], pdf["price"], pdf["qty"], last):
            if qty > 0:
                books[side][price] = qty
                heapq.heappush(heaps[side], -price if side == "bid" else price)
            else:
                books[side].pop(price, None)
            if final:
                row = [seq]
                for s, sense in (("bid", -1), ("ask", 1)):
                    while heaps[s] and sense * heaps[s][0] not in books[s]:
                        heapq.heappop(heaps[s])
                    best = sense * heaps[s][0] if heaps[s] else None
                    row += [best, books[s].get(best) if best is not None else None]
                if row[1] is not None or row[3] is not None:
                    out.append(row)
        got = pd.DataFrame(out, columns=["seq", "bid", "bid_qty", "ask", "ask_qty"]).astype("Int64")
        for k in by:
            got[k] = pdf[k].iloc[0]
        return got[[*by, "seq", "bid", "bid_qty", "ask", "ask_qty"]]

    keys = ", ".join(f"{k} long" for k in by)
    return updates.groupBy(*by).applyInPandas(run, f"{keys}, seq long, bid long, bid_qty long, ask long, ask_qty long")


def top_levels(probes: DataFrame, updates: DataFrame, n: int, by: Sequence[str] = SEGMENT) -> DataFrame:
    """The best ``n`` levels of each side at each probe, ranked from 1. A run passes its own best ``n`` on."""
    level = F.struct(F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price")).alias("k"), "price", "qty")

    def of(side: str) -> tuple[Column, Column]:
        own = F.collect_list(F.when(F.col("side") == side, level))
        return F.slice(F.array_sort(own), 1, n), F.slice(F.array_sort(F.flatten(F.collect_list(side))), 1, n)

    found = summed_at(probes, updates, {side: of(side) for side in ("bid", "ask")}, by)
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("book_side"), F.col(s).alias("levels")) for s in ("bid", "ask")]))
    rows = found.select(*probes.columns, sides.alias("__s")).select(*probes.columns, "__s.book_side", F.posexplode("__s.levels").alias("__at", "__l"))
    return rows.select(*probes.columns, "book_side", (F.col("__at") + 1).alias("rank"), "__l.price", "__l.qty")


def depth_counts(probes: DataFrame, updates: DataFrame, by: Sequence[str] = SEGMENT) -> DataFrame:
    counts = {f"{s}_count": (F.count_if(F.col("side") == s), F.sum(f"{s}_count")) for s in ("bid", "ask")}
    return summed_at(probes, updates, counts, by)


def qty_at(probes: DataFrame, updates: DataFrame, by: Sequence[str] = SEGMENT) -> DataFrame:
    """Displayed quantity at each probe's (side, price), 0 if there is none: an as-of join on that level's updates."""
    rank = F.struct("seq", F.col("pos")) if "pos" in updates.columns else F.col("seq")
    keys = [*by, "side", "price"]
    last = updates.groupBy(*keys, "seq").agg(F.max_by("qty", rank).alias("qty")) if "pos" in updates.columns else updates.select(*keys, "seq", "qty")
    found = asof(probes, last, keys, ["qty"], at="seq", quote_time="seq", prefix="__at_")
    return found.withColumn("book_qty", F.coalesce(F.greatest("__at_qty", F.lit(0)), F.lit(0)).cast("long")).drop("__at_qty")


def state_hash(probes: DataFrame, updates: DataFrame, last_id: str = "seq", by: Sequence[str] = SEGMENT) -> DataFrame:
    """SHA-256 of the canonical book at each probe: {"bids":[[p,q],..],"asks":[..],"last_update_id":n}, best levels first."""
    found = levels_at(probes, updates, by)

    def side(name: str, sense: int):
        pairs = F.array_sort(F.collect_list(F.when(F.col("book_side") == name, F.struct((F.col("price") * sense).alias("k"), "price", "qty"))))
        show = F.transform(pairs, lambda x: F.concat(F.lit('["'), x["price"].cast("string"), F.lit('","'), x["qty"].cast("string"), F.lit('"]')))
        return F.array_join(show, ",")

    rows = found.groupBy(*probes.columns).agg(side("bid", -1).alias("b"), side("ask", 1).alias("a"))
    text = F.concat(F.lit('{"bids":['), "b", F.lit('],"asks":['), "a", F.lit('],"last_update_id":'), F.col(last_id).cast("string"), F.lit("}"))
    return rows.withColumn("state_hash", F.sha2(text, 256)).drop("a", "b")


def checkpoints(updates: DataFrame, every: int, by: Sequence[str] = SEGMENT) -> DataFrame:
    """Hashes of the book at every ``every``-th event of a segment."""
    w = Window.partitionBy(*by).orderBy("seq")
    probes = updates.select(*by, "seq").distinct().withColumn("event_no", F.row_number().over(w)).filter(F.col("event_no") % every == 0)
    return state_hash(probes, updates, "seq", by)
