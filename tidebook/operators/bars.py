"""Bar strategies, backtests and their metrics.

Signals are window expressions over all bars at once. Only the position, which feeds
back into what a signal may do, is folded in order, and that per run (strategy with
parameters): a sweep is a dimension of runs, and each run is one group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR_S = 365.25 * 24 * 3600
#: Units of a buy, and the position below which strategies buy.
BUY_QTY, BUY_BELOW = 0.5, 1.0


@dataclass(frozen=True)
class Run:
    """A strategy with its parameters: momentum or mean_reversion (lookback, threshold), sma (fast, slow), bollinger (period, width)."""

    strategy: str
    a: float
    b: float

    @property
    def name(self) -> str:
        return f"{self.strategy}({self.a:g},{self.b:g})"


def with_shape(bars: DataFrame) -> DataFrame:
    """Middle, range and direction of each bar."""
    return bars.withColumns(
        {"mid": (F.col("high") + F.col("low")) / 2, "bar_range": F.col("high") - F.col("low"), "is_bullish": F.col("close") > F.col("open")}
    )


def summary(bars: DataFrame, time: str = "day") -> DataFrame:
    return bars.agg(
        F.count("*").alias("n_bars"), F.min(time).alias("first"), F.max(time).alias("last"), F.min("low").alias("min_low"), F.max("high").alias("max_high"), F.sum("volume").alias("volume")
    )


def rolling_volatility(bars: DataFrame, bars_back: int, per_year: float, by: Sequence[str] = (), time: str = "day") -> DataFrame:
    """Sample deviation of the last ``bars_back`` returns, a year's, in percent; null while there are fewer."""
    order = Window.partitionBy(*by).orderBy(time)
    back = order.rowsBetween(-(bars_back - 1), 0)
    rows = bars.withColumn("ret", F.col("close") / F.lag("close").over(order) - 1)
    vol = F.when(F.count("ret").over(back) == bars_back, F.stddev_samp("ret").over(back)) * (per_year**0.5 * 100)
    return rows.withColumn("vol_pct", vol)


def _signal(run: Run, order: Window) -> tuple[Column, Column]:
    """(1 buy, -1 sell, 0 hold; strength) before the position is looked at."""
    close, no = F.col("close"), F.row_number().over(order)

    def last(n: int):
        return order.rowsBetween(-(n - 1), 0)

    a, b = run.a, run.b
    if run.strategy == "momentum":
        past = F.lag("close", int(a) - 1).over(order)
        ret = (close - past) / past
        side, strength, ready = F.when(ret > b, 1).when(ret < -b, -1), F.abs(ret) / b, no >= a
    elif run.strategy == "mean_reversion":
        mean = F.avg("close").over(last(int(a)))
        dev = (close - mean) / mean
        side, strength, ready = F.when(dev < -b, 1).when(dev > b, -1), F.abs(dev) / b, no >= a
    elif run.strategy == "sma":
        gap = F.avg("close").over(last(int(a))) - F.avg("close").over(last(int(b)))
        before = F.lag(F.when(no >= b, gap)).over(order)
        side = F.when((before <= 0) & (gap > 0), 1).when((before >= 0) & (gap < 0), -1)
        strength, ready = F.abs(gap) / F.avg("close").over(last(int(b))) * 100, no >= b
    elif run.strategy == "bollinger":
        mean, std = F.avg("close").over(last(int(a))), F.stddev_samp("close").over(last(int(a)))
        lo, hi = mean - b * std, mean + b * std
        side = F.when(close < lo, 1).when(close > hi, -1)
        strength, ready = F.try_divide(F.greatest(lo - close, close - hi), std), no >= a
    else:
        raise ValueError(f"no strategy is named {run.strategy}")
    fired = F.coalesce(F.when(ready, side), F.lit(0))
    return fired, F.when(fired != 0, F.least(strength, F.lit(1.0)))


def signals(bars: DataFrame, runs: Sequence[Run], by: Sequence[str] = (), time: str = "day") -> DataFrame:
    """One row per bar and run: run, time, close, side, strength."""
    order = Window.partitionBy(*by).orderBy(time)
    cols = {}
    for i, r in enumerate(runs):
        side, strength = _signal(r, order)
        cols[f"__s{i}"], cols[f"__g{i}"] = side, strength
    wide = bars.withColumns(cols)
    items = [F.struct(F.lit(r.name).alias("run"), F.col(f"__s{i}").alias("side"), F.col(f"__g{i}").alias("strength")) for i, r in enumerate(runs)]
    return wide.select(*by, time, "close", F.explode(F.array(*items)).alias("x")).select(*by, "x.run", time, "close", "x.side", "x.strength")


def backtest(
    found: DataFrame, by: Sequence[str] = (), time: str = "day", cash: float = 100_000.0, taker_bps: float = 10.0, spread_bps: float = 5.0, max_position: float = 10.0
) -> DataFrame:
    """Equity per run and bar: cash, position, avg_entry, equity, unrealized, realized, and the fill of the bar (qty, fee, slippage) if any.

    Buys take ``BUY_QTY`` while under ``BUY_BELOW``; sells close the position.
    """

    def fold(pdf):
        import pandas as pd

        pdf = pdf.sort_values(time)
        c, pos, avg, realized, out = cash, 0.0, 0.0, 0.0, []
        for when, price, side in zip(pdf[time], pdf["close"].astype(float), pdf["side"]):
            qty = 0.0
            if side == 1 and pos < BUY_BELOW and pos < max_position:
                qty = BUY_QTY
                avg = (avg * pos + price * qty) / (pos + qty)
            elif side == -1 and pos > 0:
                qty = -pos
                realized += (price - avg) * pos
                avg = 0.0
            fee, slip = abs(qty) * price * taker_bps / 10_000, abs(qty) * price * spread_bps / 10_000
            c -= qty * price + fee + slip
            pos += qty
            out.append((when, price, qty, fee, slip, c, pos, avg, c + pos * price, (price - avg) * pos if pos else 0.0, realized))
        names = [time, "close", "qty", "fee", "slippage", "cash", "position", "avg_entry", "equity", "unrealized", "realized"]
        got = pd.DataFrame(out, columns=names)
        for k in (*by, "run"):
            got.insert(0, k, pdf[k].iloc[0])
        return got[[*by, "run", *names]]

    keys = "".join(f"{k} {found.schema[k].dataType.simpleString()}, " for k in by)
    kind = found.schema[time].dataType.simpleString()
    nums = ", ".join(f"{n} double" for n in ("close", "qty", "fee", "slippage", "cash", "position", "avg_entry", "equity", "unrealized", "realized"))
    return found.groupBy(*by, "run").applyInPandas(fold, f"{keys}run string, {time} {kind}, {nums}")


def drawdowns(equity: DataFrame, keys: Sequence[str] = ("run",), time: str = "day", value: str = "equity") -> DataFrame:
    """Each point's fall from the running peak."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(value).over(w)
    return equity.withColumn("peak", peak).withColumn("drawdown", (F.col(value) - F.col("peak")) / F.col("peak"))


def drawdown_days(equity: DataFrame, keys: Sequence[str] = ("run",), time: str = "day", value: str = "equity") -> DataFrame:
    """Days from the peak before the deepest point to the first return to it, or to the last point."""
    d = drawdowns(equity, keys, time, value)
    deep = d.groupBy(*keys).agg(F.min_by(F.struct(F.col(time).alias("at"), F.col("peak").alias("peak"), F.col("drawdown").alias("depth")), F.struct("drawdown", time)).alias("x"), F.max(time).alias("end"))
    r = d.join(F.broadcast(deep), list(keys))
    start = F.min(F.when((F.col(time) <= F.col("x.at")) & (F.col(value) == F.col("x.peak")), F.col(time)))
    back = F.min(F.when((F.col(time) >= F.col("x.at")) & (F.col(value) >= F.col("x.peak")), F.col(time)))
    got = r.groupBy(*keys).agg(F.first("x.depth").alias("depth"), start.alias("s"), F.coalesce(back, F.first("end")).alias("e"))
    return got.select(*keys, F.abs("depth").alias("max_drawdown"), F.when(F.col("depth") < 0, F.datediff("e", "s")).otherwise(0).cast("double").alias("max_drawdown_days"))


def trade_pnls(ledger: DataFrame, keys: Sequence[str] = ("run",), time: str = "day") -> DataFrame:
    """Profit of each first-in-first-out match of a sell with a buy, less both sides' costs pro rata.

    Matches are overlaps of running quantities, as for lots.
    """
    fills = ledger.filter("qty <> 0").withColumn("cost", F.col("fee") + F.col("slippage")).withColumn("buy", F.col("qty") > 0).withColumn("q", F.abs("qty"))
    w = Window.partitionBy(*keys, "buy").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    fills = fills.withColumn("hi", F.round(F.sum("q").over(w), 9)).withColumn("lo", F.round(F.col("hi") - F.col("q"), 9))

    def side(buy: bool, p: str) -> DataFrame:
        return fills.filter(F.col("buy") == buy).select(*keys, *[F.col(c).alias(p + c) for c in (time, "close", "q", "cost", "lo", "hi")])

    m = side(True, "b_").join(side(False, "s_"), list(keys)).filter((F.col("b_lo") < F.col("s_hi")) & (F.col("s_lo") < F.col("b_hi")))
    qty = F.least("b_hi", "s_hi") - F.greatest("b_lo", "s_lo")
    return m.select(
        *keys, F.col(f"s_{time}").alias(time), qty.alias("qty"),
        ((F.col("s_close") - F.col("b_close")) * qty - F.col("b_cost") * qty / F.col("b_q") - F.col("s_cost") * qty / F.col("s_q")).alias("pnl"),
    )


def metrics(ledger: DataFrame, keys: Sequence[str] = ("run",), time: str = "day", cash: float = 100_000.0, risk_free: float = 0.0) -> DataFrame:
    """Performance of each run; ``ledger`` as ``backtest`` gives it."""
    w = Window.partitionBy(*keys).orderBy(time)
    secs = F.unix_timestamp(F.col(time).cast("timestamp"))
    r = ledger.withColumn("__before", F.lag("equity").over(w)).withColumn("ret", F.col("equity") / F.col("__before") - 1)
    r = r.withColumn("__s", secs).withColumn("__step", F.col("__s") - F.lag("__s").over(w))
    down = F.when(F.col("ret") < 0, F.col("ret"))
    s = r.groupBy(*keys).agg(
        F.max_by("equity", time).alias("final"), (F.max("__s") - F.min("__s")).alias("secs"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("vol"),
        F.stddev_samp(down).alias("dvol"), F.count(down).alias("nd"), F.median(F.when(F.col("__step") > 0, F.col("__step"))).alias("step"),
        F.count_if(F.col("qty") != 0).alias("num_trades"), F.sum("fee").alias("total_fees"), F.sum("slippage").alias("total_slippage"), F.sum(F.abs("qty") * F.col("close")).alias("total_volume"),
    )
    p = trade_pnls(ledger, keys, time).groupBy(*keys).agg(
        F.count("*").alias("np"), F.count_if(F.col("pnl") > 0).alias("wins"), F.avg("pnl").alias("avg_pnl"),
        F.coalesce(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.lit(0.0)).alias("gain"), F.abs(F.coalesce(F.sum(F.when(F.col("pnl") < 0, F.col("pnl"))), F.lit(0.0))).alias("loss"),
    )
    x = s.join(drawdown_days(ledger, keys, time), list(keys)).join(p, list(keys), "left")
    total = (F.col("final") - cash) / cash
    years = F.greatest(F.col("secs") / YEAR_S, F.lit(1 / 365.25))
    cagr = F.pow(1 + total, 1 / years) - 1
    per_year = F.coalesce(YEAR_S / F.col("step"), F.lit(365.25))
    excess = F.col("mean") - risk_free / per_year
    dstd = F.when(F.col("nd") > 1, F.col("dvol")).otherwise(F.col("vol"))
    zero = F.lit(0.0)
    return x.select(
        *keys, total.alias("total_return"), cagr.alias("annualized_return"), (F.col("vol") * F.sqrt(per_year)).alias("annualized_volatility"),
        F.when(F.col("vol") > 0, excess / F.col("vol") * F.sqrt(per_year)).otherwise(zero).alias("sharpe_ratio"),
        F.when(dstd > 0, excess / dstd * F.sqrt(per_year)).otherwise(zero).alias("sortino_ratio"), "max_drawdown", "max_drawdown_days",
        F.when(F.col("max_drawdown") > 0, cagr / F.col("max_drawdown")).otherwise(zero).alias("calmar_ratio"), "num_trades",
        F.coalesce(F.try_divide(F.col("wins").cast("double"), F.col("np").cast("double")), zero).alias("win_rate"), F.coalesce("avg_pnl", zero).alias("avg_trade_pnl"),
        F.when(F.col("np").isNull(), zero).when(F.col("loss") > 0, F.col("gain") / F.col("loss")).otherwise(F.lit(float("inf"))).alias("profit_factor"),
        "total_fees", "total_slippage", "total_volume",
    )


def best_run(found: DataFrame, runs: Sequence[Run], keys: Sequence[str] = ("window",)) -> DataFrame:
    """The run with the greatest Sharpe ratio of each window, ties in the order of ``runs``; non-finite ratios come last."""
    spark = found.sparkSession
    no = F.broadcast(spark.createDataFrame([(r.name, i) for i, r in enumerate(runs)], "run string, __no int"))
    sharpe = F.when(F.isnan("sharpe_ratio") | (F.abs("sharpe_ratio") == float("inf")) | F.col("sharpe_ratio").isNull(), float("-inf")).otherwise(F.col("sharpe_ratio"))
    return found.withColumn("__sh", sharpe).join(no, "run").groupBy(*keys).agg(F.min_by("run", F.struct(-F.col("__sh"), F.col("__no"))).alias("run"), F.max("__sh").alias("train_sharpe"))


def walk_forward(bars: DataFrame, runs: Sequence[Run], windows: Sequence[tuple[str, str, str, str]], time: str = "day") -> tuple[DataFrame, DataFrame]:
    """(tests, equity): per window (train start, train end, test start, test end) the run chosen on training bars, tested on the next ones.

    All windows are one job: windows are a dimension that bars are joined to.
    """
    spark = bars.sparkSession
    w = spark.createDataFrame([(i, *x) for i, x in enumerate(windows, 1)], "window int, a string, b string, c string, d string")
    w = F.broadcast(w.selectExpr("window", *[f"cast({c} as date) as {c}" for c in "abcd"]))

    def part(lo: str, hi: str) -> DataFrame:
        rows = bars.join(w, (F.col(time) >= F.col(lo)) & (F.col(time) <= F.col(hi)))
        return backtest(signals(rows, runs, ("window",), time), ("window",), time)

    train = metrics(part("a", "b"), ("window", "run"), time)
    chosen = best_run(train, runs)
    equity = part("c", "d").join(F.broadcast(chosen), ["window", "run"])
    tests = metrics(equity, ("window", "run"), time).join(chosen, ["window", "run"])
    return tests, equity


def stitched(equity: DataFrame, cash: float = 100_000.0, time: str = "day") -> DataFrame:
    """One compounded curve of the windows' curves: each is scaled by what all earlier ones made."""
    ends = equity.groupBy("window").agg((F.max_by("equity", time) / cash).alias("r"))
    before = Window.orderBy("window").rowsBetween(Window.unboundedPreceding, -1)  # one row per window
    scale = ends.select("window", F.coalesce(F.product("r").over(before), F.lit(1.0)).alias("scale"))
    return equity.join(F.broadcast(scale), "window").withColumn("stitched", F.col("equity") * F.col("scale"))


def stitched_sharpe(equity: DataFrame, per_year: float, time: str = "day") -> DataFrame:
    w = Window.partitionBy("window").orderBy(time)
    r = equity.withColumn("r", F.col("equity") / F.lag("equity").over(w) - 1)
    return r.agg((F.coalesce(F.try_divide(F.avg("r"), F.stddev_samp("r")), F.lit(0.0)) * (per_year**0.5)).alias("stitched_sharpe"))
