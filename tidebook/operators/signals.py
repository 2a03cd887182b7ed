"""Order-flow and microprice signals against later moves of the mid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bucket_label, microprice, ofi_increment, range_names, sign
from .asof import asof, grid, with_horizons

BY = ("session_id",)
BOOK = ("bid", "ask", "bid_qty", "ask_qty")


def with_mid(quotes: DataFrame) -> DataFrame:
    return quotes.withColumn("mid", (F.col("bid") + F.col("ask")) / F.lit(2.0)).withColumn("spread", F.col("ask") - F.col("bid"))


def valid_samples(quotes: DataFrame) -> DataFrame:
    ok = (F.col("bid") + F.col("ask") > 0) & (F.col("bid_qty") >= 0) & (F.col("ask_qty") >= 0)
    return quotes.filter(ok)


def with_ofi_sums(quotes: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Running sums along each key: __ofi, __depth, __deep (samples with depth), and __at (position from 0).

    A trailing sum is then the difference of two as-of lookups, at any interval length.
    """
    order = Window.partitionBy(*by).orderBy("time_ms", "seq")
    grown = order.rowsBetween(Window.unboundedPreceding, 0)
    step = ofi_increment(*[F.col(c) for c in ("bid", "bid_qty", "ask", "ask_qty")], [F.lag(c).over(order) for c in ("bid", "bid_qty", "ask", "ask_qty")])
    depth = F.col("bid_qty") + F.col("ask_qty")
    return (
        quotes.withColumn("__e", F.coalesce(F.when(F.lag("seq").over(order).isNotNull(), step), F.lit(0)))
        .withColumn("__ofi", F.sum("__e").over(grown))
        .withColumn("__depth", F.sum(F.when(depth > 0, depth).otherwise(0)).over(grown))
        .withColumn("__deep", F.sum(F.when(depth > 0, 1).otherwise(0)).over(grown))
        .withColumn("__at", F.row_number().over(order) - 1)
        .drop("__e")
    )


def _interval_ofi(rows: DataFrame) -> DataFrame:
    """raw_ofi and normalized_ofi from the sums at the end (n_) and the start (s_) of the interval."""
    used = F.col("s___at").isNotNull() & (F.col("n___at") > F.col("s___at"))
    raw = F.when(used, F.col("n___ofi") - F.col("s___ofi")).otherwise(F.lit(0))
    depth = F.when(used, F.col("n___depth") - F.col("s___depth")).otherwise(F.lit(0))
    deep = F.when(used, F.col("n___deep") - F.col("s___deep")).otherwise(F.lit(0))
    mean = F.try_divide(depth.cast("double"), deep.cast("double"))
    return rows.withColumn("raw_ofi", raw.cast("long")).withColumn(
        "normalized_ofi", F.coalesce(F.try_divide(raw.cast("double"), mean), F.lit(0.0))
    )


SUMS = ("__ofi", "__depth", "__deep", "__at")


def trailing_imbalance(quotes: DataFrame, ofi_ms: int, by: Sequence[str] = BY) -> DataFrame:
    """raw_ofi and normalized_ofi of the last ``ofi_ms`` after each quote, from the first change on; changes to an empty book don't count.

    Differences of running sums, so the cost doesn't grow with the interval.
    """
    order = Window.partitionBy(*by).orderBy("time_ms", "seq")
    grown = order.rowsBetween(Window.unboundedPreceding, 0)
    step = ofi_increment(*[F.col(c) for c in ("bid", "bid_qty", "ask", "ask_qty")], [F.lag(c).over(order) for c in ("bid", "bid_qty", "ask", "ask_qty")])
    depth = F.col("bid_qty") + F.col("ask_qty")
    counts = F.lag("seq").over(order).isNotNull() & (depth > 0)
    sums = {"flow": step, "depth": depth, "n": F.lit(1)}
    rows = valid_samples(quotes).withColumns({f"__{n}": F.sum(F.when(counts, v).otherwise(0)).over(grown) for n, v in sums.items()})
    names = [f"__{n}" for n in sums]
    both = asof(rows, rows, by, names, at=F.col("time_ms") - ofi_ms, prefix="s_")
    flow, deep, n = (F.col(c) - F.coalesce(f"s_{c}", F.lit(0)) for c in names)
    ratio = F.coalesce(F.try_divide(flow.cast("double"), F.try_divide(deep.cast("double"), n.cast("double"))), F.lit(0.0))
    return both.select(*quotes.columns, flow.cast("long").alias("raw_ofi"), ratio.alias("normalized_ofi"))


def ofi_samples(
    quotes: DataFrame,
    step_ms: int,
    ofi_ms: int,
    horizons_ms: Sequence[int],
    max_staleness_ms: int | None = None,
    max_future_lag_ms: int | None = None,
    by: Sequence[str] = BY,
) -> DataFrame:
    """Order-flow imbalance over the last ``ofi_ms`` at regular times, with the later drift of the mid."""
    book = with_ofi_sums(with_mid(valid_samples(quotes)), by)
    points = grid(book, by, step_ms, ofi_ms)
    now = asof(points, book, by, ["time_ms", "mid", *SUMS], prefix="n_", most_ms=max_staleness_ms).filter(F.col("n___at") > 0)
    both = asof(now, book, by, SUMS, at=F.col("time_ms") - ofi_ms, prefix="s_")
    later = asof(
        with_horizons(_interval_ofi(both), horizons_ms), book, by, ["time_ms", "mid"],
        at=F.col("time_ms") + F.col("horizon_ms"), forward=True, most_ms=max_future_lag_ms, prefix="f_",
    ).filter("f_mid is not null")
    return later.select(
        *by, "time_ms", "horizon_ms", F.col("f_time_ms").alias("future_ms"), F.col("n_mid").alias("mid"), F.col("f_mid").alias("future_mid"),
        "raw_ofi", "normalized_ofi", ((F.col("f_mid") - F.col("n_mid")) / F.col("n_mid") * 10_000.0).alias("drift_bps"),
    )


def ofi_fill_toxicity(
    fills: DataFrame,
    quotes: DataFrame,
    ofi_ms: int,
    horizons_ms: Sequence[int],
    maker_only: bool = True,
    max_staleness_ms: int | None = None,
    max_future_lag_ms: int | None = None,
    by: Sequence[str] = BY,
) -> DataFrame:
    """Imbalance strictly before each fill, and the side-adjusted move after it."""
    book = with_ofi_sums(with_mid(valid_samples(quotes)), by)
    rows = fills.filter("is_maker") if maker_only else fills
    now = asof(rows, book, by, ["time_ms", "mid", *SUMS], strict=True, prefix="n_", most_ms=max_staleness_ms).filter(F.col("n___at") > 0)
    both = asof(now, book, by, SUMS, at=F.col("time_ms") - ofi_ms, prefix="s_")
    later = asof(
        with_horizons(_interval_ofi(both), horizons_ms), book, by, ["time_ms", "mid"],
        at=F.col("time_ms") + F.col("horizon_ms"), forward=True, most_ms=max_future_lag_ms, prefix="f_",
    ).filter("f_mid is not null")
    s = sign(F.col("side"))
    return later.select(
        *by, "fill_id", "side", "time_ms", "horizon_ms", F.col("n_mid").alias("mid_at_fill"), F.col("f_mid").alias("future_mid"), "raw_ofi",
        "normalized_ofi", (s * F.col("normalized_ofi")).alias("side_aligned"),
        (s * (F.col("f_mid") - F.col("n_mid")) / F.col("n_mid") * 10_000.0).alias("move_bps"),
    )


def microprice_samples(
    quotes: DataFrame,
    step_ms: int,
    horizons_ms: Sequence[int],
    max_staleness_ms: int | None = None,
    by: Sequence[str] = BY,
) -> DataFrame:
    """Microprice less mid at regular times, with the later drift of the mid."""
    book = with_mid(valid_samples(quotes)).withColumn("micro", microprice(*[F.col(c) for c in ("bid", "bid_qty", "ask", "ask_qty")]))
    book = book.filter("micro is not null")
    points = grid(book, by, step_ms)
    now = asof(points, book, by, ["mid", "micro"], prefix="n_", most_ms=max_staleness_ms).filter("n_mid is not null")
    later = asof(
        with_horizons(now, horizons_ms), book, by, ["mid"], at=F.col("time_ms") + F.col("horizon_ms"), forward=True, prefix="f_"
    ).filter("f_mid is not null")
    return later.select(
        *by, "time_ms", "horizon_ms", F.col("n_mid").alias("mid"), F.col("f_mid").alias("future_mid"),
        ((F.col("n_micro") - F.col("n_mid")) / F.col("n_mid") * 10_000.0).alias("signal_bps"),
        ((F.col("f_mid") - F.col("n_mid")) / F.col("n_mid") * 10_000.0).alias("drift_bps"),
    )


def microprice_fill_toxicity(fills: DataFrame, quotes: DataFrame, horizons_ms: Sequence[int], maker_only: bool = True, by: Sequence[str] = BY) -> DataFrame:
    """Side-adjusted microprice signal at or before each fill (unlike imbalance, which is strictly before)."""
    book = with_mid(valid_samples(quotes)).withColumn("micro", microprice(*[F.col(c) for c in ("bid", "bid_qty", "ask", "ask_qty")]))
    rows = fills.filter("is_maker") if maker_only else fills
    now = asof(rows, book.filter("micro is not null"), by, ["mid", "micro"], prefix="n_").filter("n_mid is not null")
    later = asof(
        with_horizons(now, horizons_ms), book, by, ["mid"], at=F.col("time_ms") + F.col("horizon_ms"), forward=True, prefix="f_"
    ).filter("f_mid is not null")
    s = sign(F.col("side"))
    return later.select(
        *by, "fill_id", "side", "time_ms", "horizon_ms", F.col("n_mid").alias("mid_at_fill"), F.col("f_mid").alias("future_mid"),
        (s * (F.col("n_micro") - F.col("n_mid")) / F.col("n_mid") * 10_000.0).alias("side_aligned"),
        (s * (F.col("n_mid") - F.col("price")) / F.col("n_mid") * 10_000.0).alias("edge_bps"),
        (s * (F.col("f_mid") - F.col("n_mid")) / F.col("n_mid") * 10_000.0).alias("move_bps"),
    )


def bucketed(
    rows: DataFrame, keys: Sequence[str], signal: str, value: str, edges: Sequence[float], unit: str = "", extra: Sequence[tuple[str, Column]] = ()
) -> DataFrame:
    """n, mean signal, mean and median value per key and signal range; empty ranges of every key have n = 0."""
    spark = rows.sparkSession
    names = spark.createDataFrame(list(enumerate(range_names(edges, unit))), "bucket_no int, bucket string")
    found = rows.withColumn("bucket", bucket_label(F.col(signal), edges, unit)).groupBy(*keys, "bucket").agg(
        F.count("*").alias("n"), F.avg(signal).alias("avg_signal"), F.avg(value).alias("avg_value"), F.median(value).alias("median_value"),
        *[c.alias(n) for n, c in extra],
    )
    every = rows.select(*keys).distinct().join(F.broadcast(names), how="cross")  # a fixed handful of ranges per key
    return every.join(found, [*keys, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def by_side(rows: DataFrame) -> DataFrame:
    """Each row under its own side and under ``all``."""
    return rows.withColumn("side", F.explode(F.array(F.lit("all"), F.col("side"))))
