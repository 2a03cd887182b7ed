"""Scalar expressions of market microstructure, all JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: UTC hour buckets by their first hour.
UTC_BUCKETS = [("00-06", 0), ("07-12", 7), ("13-16", 13), ("17-23", 17)]
#: Session boundaries in minutes of the UTC day, in tie order.
BOUNDARIES = [("Tokyo", 0), ("Singapore/Hong Kong", 60), ("London", 420), ("US cash open", 810), ("US cash close", 1200)]
PROXIMITY_MS = 30 * 60_000


def sign(side: Column) -> Column:
    return F.when(side == "buy", 1).otherwise(-1)


def bps(value: Column, base: Column) -> Column:
    """``value`` as basis points of ``base``; null if that is null or zero."""
    return F.try_divide(value.cast("double"), base.cast("double")) * 10_000.0


def ratio(value: Column, base: Column) -> Column:
    """``value`` / ``base`` as doubles: by zero it is infinite, or not a number if both are zero, as in DuckDB."""
    v, b = value.cast("double"), base.cast("double")
    return F.when(b == 0, v * F.lit(float("inf"))).otherwise(F.try_divide(v, b))


def ceil_to(value: Column, step: int) -> Column:
    return (F.ceil(value / F.lit(float(step))) * step).cast("long")


def ofi_increment(bid: Column, bid_qty: Column, ask: Column, ask_qty: Column, before: Sequence[Column]) -> Column:
    """Order-flow imbalance of one best-quote change; ``before``: the same four one sample earlier."""
    b, bq, a, aq = before
    zero = F.lit(0)
    return (
        F.when(bid >= b, bid_qty).otherwise(zero)
        - F.when(bid <= b, bq).otherwise(zero)
        - F.when(ask <= a, ask_qty).otherwise(zero)
        + F.when(ask >= a, aq).otherwise(zero)
    )


def microprice(bid: Column, bid_qty: Column, ask: Column, ask_qty: Column) -> Column:
    """Null if both quantities are zero."""
    return F.try_divide((bid_qty * ask + ask_qty * bid).cast("double"), (bid_qty + ask_qty).cast("double"))


def quote_position(side: Column, price: Column, bid: Column, ask: Column) -> Column:
    near, far = F.when(side == "buy", bid).otherwise(-ask), F.when(side == "buy", ask).otherwise(-bid)
    p = F.when(side == "buy", price).otherwise(-price)
    return (
        F.when(bid.isNull() | ask.isNull(), "unknown")
        .when(p >= far, "crossed")
        .when(p > near, "inside_spread")
        .when(p == near, "at_best")
        .otherwise("behind_best")
    )


def utc_bucket(hour: Column) -> Column:
    out = F.lit(UTC_BUCKETS[0][0])
    for name, first in UTC_BUCKETS[1:]:
        out = F.when(hour >= first, name).otherwise(out)
    return out


def nearest_boundary(time_ms: Column) -> Column:
    """Struct of the boundary next to a time: distance, tie keys, name, signed distance."""
    day = F.floor(time_ms / F.lit(DAY_MS)) * DAY_MS
    options = []
    for shift in (-1, 0, 1):
        for order, (name, minute) in enumerate(BOUNDARIES):
            delta = (time_ms - (day + shift * DAY_MS + minute * 60_000)).cast("long")
            options.append(
                F.struct(
                    F.abs(delta).alias("distance"),
                    F.when(delta >= 0, 0).otherwise(1).alias("ahead"),
                    F.lit(order).alias("order"),
                    F.lit(name).alias("name"),
                    delta.alias("delta"),
                )
            )
    return F.least(*options)


def bucket_label(value: Column, edges: Sequence[float], unit: str = "") -> Column:
    """Half-open range of ``value``: ``<e0``, ``[lo,hi)``, ``>=en``; no edges: ``all``."""
    names = range_names(edges, unit)
    if not edges:
        return F.lit(names[0])
    out = F.lit(names[-1])
    for name, hi in zip(reversed(names[:-1]), reversed(sorted(edges))):
        out = F.when(value < hi, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def range_names(edges: Sequence[float], unit: str = "") -> list[str]:
    e = sorted(edges)
    if not e:
        return ["all"]
    return [f"<{e[0]}{unit}", *[f"[{a},{b}){unit}" for a, b in zip(e, e[1:])], f">={e[-1]}{unit}"]


def bin_index(value: Column, edges: Sequence[float]) -> Column:
    """Index of the last edge at or below ``value``; null below the first."""
    out = F.lit(None).cast("int")
    for i, e in enumerate(edges):
        out = F.when(value >= e, i).otherwise(out)
    return out


def bin_names(edges: Sequence[float], unit: str) -> list[str]:
    show = [f"{e:g}" for e in edges] + ["inf"]
    return [f"[{a},{b}){unit}" for a, b in zip(show, show[1:])]


def round_bid(price: Column, tick: float) -> Column:
    return F.floor(price / F.lit(tick)) * tick


def round_ask(price: Column, tick: float) -> Column:
    return F.ceil(price / F.lit(tick)) * tick


def fee(qty: Column, price: Column, rate_bps: Column | float) -> Column:
    rate = rate_bps if isinstance(rate_bps, Column) else F.lit(float(rate_bps))
    return (qty * price).cast("double") * rate / 10_000.0


def fee_notional(fees: Column, rate_bps: float) -> Column:
    return fees / (rate_bps / 10_000.0) if rate_bps else F.lit(None).cast("double")


def break_even_bps(gross: Column, notional: Column) -> Column:
    return bps(gross, notional)


def loss_source(net: Column, matched: Column, residual: Column) -> Column:
    return (
        F.when(net >= 0, "not_loss_window")
        .when((residual < 0) & (matched < 0), "matched_and_residual_loss")
        .when(residual < 0, "residual_inventory_loss")
        .when(matched < 0, "matched_loss")
        .otherwise("other_loss")
    )


def fixed8(text: Column) -> Column:
    """A decimal string with exactly eight fractional digits as a scaled long; null if it isn't one."""
    return F.when(text.rlike(r"^[0-9]+\.[0-9]{8}$"), F.try_to_number(F.replace(text, F.lit("."), F.lit("")), F.lit("9" * 38))).cast(
        "decimal(38,0)"
    ).try_cast("long")


def tail_count(n: Column, fraction: str) -> Column:
    """Rows in the worst ``fraction`` (a decimal string): half up, one at least if there are any."""
    k = F.round(n.cast("decimal(20,0)") * F.lit(fraction).cast("decimal(9,6)"), 0).cast("long")
    return F.when(n > 0, F.greatest(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))


def fraction_label(fraction: str) -> str:
    from decimal import Decimal

    pct = format((Decimal(fraction) * 100).normalize(), "f")
    return pct.replace(".", "p") + "pct"


def hour_label(time_ms: Column) -> Column:
    """The hour of a time as YYYY-MM-DD HH:00 (in the session's zone)."""
    return F.date_format(F.timestamp_millis(time_ms), "yyyy-MM-dd HH:00")
