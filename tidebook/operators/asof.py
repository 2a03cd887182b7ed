"""As-of joins as one sort: both sides are unioned and the last quote is carried along a growing frame.

No row is multiplied and no range condition is joined. A partition key with very many
rows is cut by time: with ``bucket_ms`` the frame runs within (key, bucket), and what
was last before a bucket comes from one small row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(
    probes: DataFrame,
    quotes: DataFrame,
    by: Sequence[str],
    take: Sequence[str],
    at: Column | str = "time_ms",
    quote_time: str = "time_ms",
    quote_seq: str = "seq",
    forward: bool = False,
    strict: bool = False,
    most_ms: int | None = None,
    prefix: str = "q_",
    bucket_ms: int | None = None,
) -> DataFrame:
    """``probes`` with ``take`` of the quote that each one sees, named ``prefix`` + name, null if none.

    Backward: the last quote at or before ``at`` (``strict``: before it); of equal
    times the greatest ``quote_seq``. Forward: the first quote at or after ``at``
    (``strict``: after it); of equal times the least. ``most_ms`` bounds the distance.
    """
    when = F.col(at) if isinstance(at, str) else at
    sense = -1 if forward else 1
    # along the frame: quotes before probes of the same time, unless these must not see them
    quote_kind, probe_kind = (1, 0) if strict else (0, 1)
    picked = F.struct(F.col(quote_time).alias("__qt"), *[F.col(c).alias(c) for c in take])
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(by)]
    left = probes.select(
        *keys,
        (when * sense).alias("__t"),
        F.lit(probe_kind).alias("__kind"),
        F.lit(0).cast("long").alias("__s"),
        F.lit(None).cast(quotes.select(picked.alias("x")).schema["x"].dataType).alias("__q"),
        F.struct(*[F.col(c) for c in probes.columns]).alias("__p"),
    )
    right = quotes.select(
        *keys,
        (F.col(quote_time) * sense).alias("__t"),
        F.lit(quote_kind).alias("__kind"),
        (F.col(quote_seq) * sense).cast("long").alias("__s"),
        picked.alias("__q"),
        F.lit(None).cast(left.schema["__p"].dataType).alias("__p"),
    )
    rows = left.unionByName(right)
    names = [f"__k{i}" for i in range(len(by))]
    if bucket_ms is not None:
        rows = rows.withColumn("__b", F.floor(F.col("__t") / F.lit(float(bucket_ms))))
        last = rows.filter(F.col("__q").isNotNull()).groupBy(*names, "__b").agg(F.max_by("__q", F.struct("__t", "__s")).alias("__q"))
        seen = rows.select(*names, "__b").distinct().join(last, [*names, "__b"], "left")
        before = Window.partitionBy(*names).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carry = seen.withColumn("__q", F.last("__q", ignorenulls=True).over(before)).filter(F.col("__q").isNotNull())
        carry = carry.select(
            *names,
            F.lit(None).cast("long").alias("__t"),  # nulls come first
            F.lit(-1).alias("__kind"),
            F.lit(0).cast("long").alias("__s"),
            "__q",
            F.lit(None).cast(left.schema["__p"].dataType).alias("__p"),
            "__b",
        )
        rows = rows.unionByName(carry)
        names = [*names, "__b"]
    frame = Window.partitionBy(*names).orderBy("__t", "__kind", "__s").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("__q", F.last("__q", ignorenulls=True).over(frame)).filter(F.col("__p").isNotNull())
    hit = F.col("__q").isNotNull()
    if most_ms is not None:
        hit = hit & (F.abs(F.col("__t") * sense - F.col("__q.__qt")) <= most_ms)
    return found.select(
        *[F.col(f"__p.{c}").alias(c) for c in probes.columns], *[F.when(hit, F.col(f"__q.{c}")).alias(prefix + c) for c in take]
    )


def with_horizons(rows: DataFrame, horizons_ms: Sequence[int]) -> DataFrame:
    """Each row once per horizon, as ``horizon_ms``."""
    return rows.withColumn("horizon_ms", F.explode(F.array(*[F.lit(h).cast("long") for h in horizons_ms])))


def grid(quotes: DataFrame, by: Sequence[str], step_ms: int, lead_ms: int = 0, time: str = "time_ms") -> DataFrame:
    """Regular times of each key: multiples of ``step_ms`` from the first quote plus ``lead_ms`` to the last quote."""
    ends = quotes.groupBy(*by).agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
    first = (F.ceil((F.col("__lo") + lead_ms) / F.lit(float(step_ms))) * step_ms).cast("long")
    return (
        ends.withColumn("__first", first)
        .filter(F.col("__first") <= F.col("__hi"))
        .select(*by, F.explode(F.sequence("__first", "__hi", F.lit(step_ms).cast("long"))).alias(time))
    )
