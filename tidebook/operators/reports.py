"""Report tables over sessions, windows and runs."""

from __future__ import annotations

from collections.abc import Sequence
from random import Random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR = 3_600_000


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)).cast("double"), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))).cast("double"))


def run_table(rows: DataFrame, keys: Sequence[str], sums: Sequence[str], means: Sequence[tuple[str, str]]) -> DataFrame:
    """Totals and weighted means per key: one function for strategies, sweeps and panels."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), *[F.sum(c).alias(c) for c in sums], *[weighted_mean(v, w).alias(f"mean_{v}") for v, w in means]
    )


def strict_totals(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums that are null as soon as one row's value is."""
    return rows.groupBy(*keys).agg(*[F.when(F.count(v) == F.count("*"), F.sum(v)).alias(v) for v in values])


def side_counts(fills: DataFrame, keys: Sequence[str], fill_key: Sequence[str]) -> DataFrame:
    """Distinct fills per side. Fill ids restart with each session, so the session belongs to ``fill_key``."""
    one = F.struct(*fill_key)
    return fills.groupBy(*keys).agg(*[F.countDistinct(F.when(F.col("side") == s, one)).alias(f"n_{s}") for s in ("buy", "sell")])


def unique_fills(lots: DataFrame, rest: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fills put together again from both legs of lots and from what is open; fails if a fill has two prices.

    ``lots``: open_fill_id, open_price, close_fill_id, close_price, qty. ``rest``: fill_id, price, open_qty.
    """
    legs = [lots.select(*by, F.col(f"{k}_fill_id").alias("fill_id"), F.col(f"{k}_price").alias("price"), "qty") for k in ("open", "close")]
    every = legs[0].union(legs[1]).union(rest.select(*by, "fill_id", "price", F.col("open_qty").alias("qty")))
    got = every.groupBy(*by, "fill_id").agg(F.sum("qty").alias("qty"), F.min("price").alias("price"), F.max("price").alias("__most"))
    ok = F.when(F.col("price") == F.col("__most"), F.lit(True)).otherwise(F.raise_error(F.lit("a fill has two prices")).cast("boolean"))
    return got.withColumn("__ok", ok).filter("__ok").drop("__most", "__ok")


def same_time_trades(fills: DataFrame, trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """For each fill the volume traded at its own time, side and price."""
    t = trades.withColumn("side", F.when(F.col("is_buyer_maker"), "buy").otherwise("sell")).groupBy(*by, "time_ms", "side", "price").agg(F.sum("qty").alias("traded_qty"))
    return fills.join(t, [*by, "time_ms", "side", "price"], "left").withColumn("traded_qty", F.coalesce("traded_qty", F.lit(0).cast("long")))


def cancel_drained_before_fill(fills: DataFrame, events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fills whose order's queue had been shortened by cancelled depth in the same millisecond."""
    d = F.col("detail")
    e = events.filter((F.col("event_type") == "queue_drain") & (d["reason"] == "cancellation")).groupBy(*by, "order_id", "time_ms").agg(F.sum(d["drained_qty"].cast("double")).alias("cancel_drained"))
    return fills.join(e, [*by, "order_id", "time_ms"]).filter("cancel_drained > 0")


def audit_rollup(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    hit = F.col("traded_qty") > 0
    n = F.count("*")
    return rows.groupBy(*keys).agg(n.alias("n_fills"), F.count_if(hit).alias("n_shared"), F.coalesce(F.try_divide(F.count_if(hit) * 100.0, n.cast("double")), F.lit(0.0)).alias("pct_shared"))


def policy_delta(rows: DataFrame, key: str, policy: str, old: str, new: str, values: Sequence[str]) -> DataFrame:
    """New less old per key, and whether all differences are zero."""
    got = rows.groupBy(key).agg(*[F.sum(F.when(F.col(policy) == p, F.col(v))).alias(f"{v}_{i}") for v in values for i, p in enumerate((old, new))])
    out = got.select(key, *[(F.coalesce(f"{v}_1", F.lit(0)) - F.coalesce(f"{v}_0", F.lit(0))).alias(f"{v}_delta") for v in values])
    zero = F.lit(True)
    for v in values:
        zero = zero & (F.col(f"{v}_delta") == 0)
    return out.withColumn("exact_zero", zero)


def mode_ratios(rows: DataFrame, key: str, mode: str, base: str, other: str, values: Sequence[str]) -> DataFrame:
    """other / base of each value per key."""
    parts = {(v, m): F.sum(F.when(F.col(mode) == m, F.col(v))).cast("double") for v in values for m in (base, other)}
    return rows.groupBy(key).agg(*[F.try_divide(parts[v, other], parts[v, base]).alias(f"{v}_ratio") for v in values])


def wide(base: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Left joins of small per-window tables on their key."""
    for o in others:
        base = base.join(o, key, "left")
    return base


def without_overlap(windows: DataFrame, taken: DataFrame, bucket_ms: int, lo: str = "start_ms", hi: str = "end_ms") -> DataFrame:
    """Windows that overlap none of ``taken``: both are cut into buckets and equi-joined."""

    def cut(df: DataFrame, p: str) -> DataFrame:
        span = F.sequence(F.floor(F.col(lo) / bucket_ms), F.floor((F.col(hi) - 1) / bucket_ms))
        return df.select(F.col(lo).alias(f"{p}lo"), F.col(hi).alias(f"{p}hi"), F.explode(span).alias("__b"))

    hit = cut(windows, "w").join(cut(taken, "t"), "__b").filter((F.col("wlo") < F.col("thi")) & (F.col("tlo") < F.col("whi"))).select(F.col("wlo").alias(lo), F.col("whi").alias(hi)).distinct()
    return windows.join(hit, [lo, hi], "left_anti")


def one_to_one(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is allowed; fails unless every allowed key has exactly one row."""
    got = allowed.select(key).join(rows, key, "left").withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    there = [c for c in rows.columns if c != key][0]
    ok = (F.col("__n") == 1) & F.col(there).isNotNull()
    return got.withColumn("__ok", F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not exactly one row for "), F.col(key).cast("string"))).cast("boolean"))).filter("__ok").drop("__n", "__ok")


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of only one side, with the side."""
    l, r = left.select(key).distinct(), right.select(key).distinct()
    return l.join(r, key, "left_anti").withColumn("only_in", F.lit("left")).union(r.join(l, key, "left_anti").withColumn("only_in", F.lit("right")))


def valid_ranges(hours: DataFrame, by: Sequence[str]) -> DataFrame:
    """Runs of valid hours in a row."""
    w = Window.partitionBy(*by).orderBy("hour_ms")
    rows = hours.filter("valid").withColumn("__g", F.col("hour_ms") - F.row_number().over(w).cast("long") * HOUR)
    return rows.groupBy(*by, "__g").agg(F.min("hour_ms").alias("first_ms"), F.max("hour_ms").alias("last_ms"), F.count("*").alias("n_hours")).drop("__g")


def range_summary(ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    return ranges.groupBy(*by).agg(F.count("*").alias("n_ranges"), F.sum("n_hours").alias("n_hours"), F.max("n_hours").alias("longest"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))


def synthetic_book(spark: SparkSession, n: int, levels: int = 200, seed: int = 42) -> DataFrame:
    """Seeded book operations: a snapshot of both sides, then diffs of up to four levels a side, a fifth of them deletions. Small fixture."""
    rng = Random(seed)
    rows = [(0, 0, p, side, 100_000 + (p + 1) * (1 if side == "ask" else -1), rng.randrange(1, 1000)) for side in ("bid", "ask") for p in range(levels)]
    for seq in range(1, n + 1):
        for side in ("bid", "ask"):
            for pos in range(rng.randrange(5)):
                price = 100_000 + (rng.randrange(levels) + 1) * (1 if side == "ask" else -1)
                rows.append((0, seq, pos, side, price, 0 if rng.random() < 0.2 else rng.randrange(1, 1000)))
    return spark.createDataFrame(rows, "session_id long, seq long, pos int, side string, price long, qty long").withColumn("segment_id", F.lit(0).cast("long"))


def book_mutations(states: DataFrame) -> DataFrame:
    """Events that change a book: no resyncs, no tainted milliseconds, no suppressed diffs. ``states`` as gap_state gives them."""
    kind = F.col("event_type")
    return states.filter((F.col("kind") == 0) & ~F.col("censored") & ((kind == "snapshot") | ((kind == "diff") & ~F.col("in_gap"))))
