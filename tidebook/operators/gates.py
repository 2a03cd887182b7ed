"""Decision rules over small aggregates, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the imbalance gate.
OFI_GATE = {"stable": 0.75, "t": 2.0, "effect": 0.05, "separation": 1.0, "bucket": 30}
MARGINAL = 0.75


def conditional_separation(buckets: DataFrame, horizon_ms: int) -> DataFrame:
    """Mean move of the largest favourable bucket less that of the largest adverse one, and the smaller count. One row."""
    rows = buckets.filter((F.col("horizon_ms") == horizon_ms) & (F.col("side") == "all") & F.col("avg_value").isNotNull())
    key = F.struct(-F.col("n"), F.col("bucket_no"))
    bad, good = F.col("avg_signal") < 0, F.col("avg_signal") >= 0
    got = rows.agg(
        F.min_by(F.when(bad, F.struct("avg_value", "n")), F.when(bad, key)).alias("a"), F.min_by(F.when(good, F.struct("avg_value", "n")), F.when(good, key)).alias("f")
    )
    both = F.col("a").isNotNull() & F.col("f").isNotNull()
    return got.select(
        F.when(both, F.col("f.avg_value") - F.col("a.avg_value")).alias("separation"), F.when(both, F.least("a.n", "f.n")).otherwise(F.lit(0).cast("long")).alias("min_bucket")
    )


def ofi_gate(windows: DataFrame, pooled: DataFrame, separation: DataFrame, g: dict[str, float] = OFI_GATE) -> DataFrame:
    """One row: sign stability over windows, pooled t and effect, conditional status and the verdict.

    ``windows``: beta. ``pooled``: one row with t_stat and drift_1std. ``separation``: as above.
    """
    signs = windows.filter("beta is not null").agg(
        F.count("*").alias("total"), F.greatest(F.count_if(F.col("beta") > 0), F.count_if(F.col("beta") < 0)).alias("stable")
    )
    p = pooled.agg(F.abs(F.first("t_stat")).alias("abs_t"), F.abs(F.first("drift_1std")).alias("abs_effect"))
    row = signs.join(p, how="cross").join(separation, how="cross")  # one row each
    share = F.coalesce(F.try_divide(F.col("stable").cast("double"), F.col("total").cast("double")), F.lit(0.0))
    row = row.withColumn("stable_share", share).withColumns(
        {
            "stable_pass": (F.col("total") > 0) & (share >= g["stable"]),
            "t_pass": F.coalesce(F.col("abs_t") >= g["t"], F.lit(False)),
            "effect_pass": F.coalesce(F.col("abs_effect") >= g["effect"], F.lit(False)),
            "conditional_status": F.when(F.col("separation").isNull() | (F.col("min_bucket") < g["bucket"]), "inconclusive_power")
            .when(F.col("separation") >= g["separation"], "pass")
            .otherwise("fail_signal"),
        }
    )
    base = F.col("stable_pass") & F.col("t_pass") & F.col("effect_pass")
    verdict = (
        F.when(~base | (F.col("conditional_status") == "fail_signal"), "blocked")
        .when(F.col("conditional_status") == "pass", "supported")
        .otherwise("supported_with_conditional_power_limit")
    )
    powered = F.col("conditional_status") != "inconclusive_power"
    passes = F.col("stable_pass") | F.col("t_pass") | F.col("effect_pass") | (powered & (F.col("conditional_status") == "pass"))
    near = (
        (F.col("stable_share") >= g["stable"] * MARGINAL)
        & F.coalesce(F.col("abs_t") >= g["t"] * MARGINAL, F.lit(False))
        & F.coalesce(F.col("abs_effect") >= g["effect"] * MARGINAL, F.lit(False))
        & (~powered | ((F.col("separation") >= g["separation"] * MARGINAL) & (F.col("min_bucket") >= int(g["bucket"] * MARGINAL))))
    )
    row = row.withColumns({"unconditional_pass": base, "verdict": verdict})
    return row.withColumn("marginal_fallback", (F.col("verdict") == "blocked") & passes & F.coalesce(near, F.lit(False)))


def screen_status(unconditional: Column, conditional: Column) -> Column:
    return (
        F.when(~unconditional | (conditional == "fail_signal"), "blocked").when(conditional == "inconclusive_power", "inconclusive").otherwise("supported")
    )


def worst_status(rows: DataFrame, order: list[str], col: str = "status") -> DataFrame:
    """The first of ``order`` that occurs: blocked before inconclusive, fail before mixed. One row."""
    out = F.lit(order[-1])
    for s in reversed(order[:-1]):
        out = F.when(F.count_if(F.col(col) == s) > 0, s).otherwise(out)
    return rows.agg(out.alias(col))


def paired_windows(baseline: DataFrame, candidate: DataFrame, key: str = "window") -> DataFrame:
    """Both sides' metrics per window; fails if the windows differ. Columns get the suffixes _b and _c."""
    b = baseline.select(F.col(key), *[F.col(c).alias(f"{c}_b") for c in baseline.columns if c != key], F.lit(True).alias("__b"))
    c = candidate.select(F.col(key), *[F.col(x).alias(f"{x}_c") for x in candidate.columns if x != key], F.lit(True).alias("__c"))
    both = b.join(c, key, "full")
    ok = F.when(F.col("__b") & F.col("__c"), F.lit(True)).otherwise(F.raise_error(F.lit("baseline and candidate windows must match exactly")).cast("boolean"))
    return both.withColumn("__ok", ok).filter("__ok").drop("__b", "__c", "__ok")


def strategy_gate(pairs: DataFrame, ci_low: float | None) -> DataFrame:
    """One row of guardrails; columns per window: fills, maker_fills, matched_qty, matched_net, net_pnl, residual."""
    s = pairs.agg(
        F.sum("fills_b").alias("baseline_fills"), F.sum("fills_c").alias("candidate_fills"), F.min(F.col("matched_qty_c") > 0).alias("positive_quantity"),
        F.min(F.col("maker_fills_c") == F.col("fills_c")).alias("all_maker"), F.sum("net_pnl_b").alias("nb"), F.sum("net_pnl_c").alias("nc"),
        F.avg(F.abs("residual_b")).alias("rb"), F.avg(F.abs("residual_c")).alias("rc"),
    )
    share = F.try_divide(F.col("candidate_fills").cast("double"), F.col("baseline_fills").cast("double"))
    s = s.withColumns(
        {
            "fill_share": share, "fill_activity_pass": F.coalesce(share >= 0.5, F.lit(False)), "maker_only_pass": (F.col("candidate_fills") > 0) & F.col("all_maker"),
            "pnl_pass": F.col("nc") >= F.col("nb"), "residual_pass": F.col("rc") <= F.col("rb") * 1.1, "ci_pass": F.lit(ci_low is not None and ci_low > 0),
        }
    )
    every = F.col("ci_pass") & F.col("positive_quantity") & F.col("fill_activity_pass") & F.col("maker_only_pass") & F.col("pnl_pass") & F.col("residual_pass")
    return s.withColumn("advance", every).drop("nb", "nc", "rb", "rc", "all_maker")


def holdout_status(mean: Column, bound: Column, guardrails: Column) -> Column:
    return F.when(mean.isNull() | (mean <= 0), "fail").when((mean >= bound) & guardrails, "pass").otherwise("mixed")


def verdict_ladder(mean: Column, low: Column, high: Column, old_mean: Column, fraction: float = 0.25) -> Column:
    return (
        F.when(low > 0, "Overturns V1")
        .when(high < 0, "Strengthens V1")
        .when(mean - old_mean >= F.abs(old_mean) * fraction, "Weakens V1")
        .otherwise("Confirms V1")
    )


def ci_relation(low: Column, high: Column) -> Column:
    return F.when(low > 0, "above_zero").when(high < 0, "below_zero").otherwise("contains_zero")


def queue_flags(fill_ratio: Column, orders_ratio: Column, *nets: Column, drop_pct: float = 50.0, worse_pct: float = 50.0) -> list[Column]:
    negative = F.lit(True)
    for n in nets:
        negative = negative & (n < 0)
    return [
        F.coalesce(fill_ratio < 1 - drop_pct / 100, F.lit(False)).alias("far_fewer_fills"),
        F.coalesce(orders_ratio > 1 + worse_pct / 100, F.lit(False)).alias("worse_orders_per_fill"),
        negative.alias("stable_negative"),
    ]
