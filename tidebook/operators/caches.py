"""A table of per-second mids that follows its source hour by hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

HOUR_MS = 3_600_000


def hour_manifest(quotes: DataFrame) -> DataFrame:
    """hour_ms, n, and two sums over row hashes: what tells that an hour's rows have changed."""
    hour = (F.floor(F.col("time_ms") / HOUR_MS) * HOUR_MS).alias("hour_ms")
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(quotes.columns)])
    return quotes.groupBy(hour).agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("sum"))


def second_mids(quotes: DataFrame) -> DataFrame:
    """session_id, second_ms, mid (the second's last), hour_ms."""
    last = F.max_by((F.col("bid") + F.col("ask")) / F.lit(2.0), F.struct("time_ms", "seq"))
    rows = quotes.groupBy("session_id", (F.floor(F.col("time_ms") / 1000) * 1000).alias("second_ms")).agg(last.alias("mid"))
    return rows.withColumn("hour_ms", F.floor(F.col("second_ms") / HOUR_MS) * HOUR_MS)


def refresh(quotes: DataFrame, path: str) -> int:
    """Bring the table in ``path`` up to date and return how many hours that took.

    Only hours whose manifest row changed are computed and their partitions overwritten; hours that are gone go.
    The manifest is replaced last, so after a break the same hours are simply done again.
    """
    spark = quotes.sparkSession
    now = hour_manifest(quotes)
    known = spark.read.parquet(f"{path}/manifest") if files.exists(spark, f"{path}/manifest/_SUCCESS") else spark.createDataFrame([], now.schema)
    changed = now.join(known, now.columns, "left_anti").select("hour_ms")
    gone = known.join(now, "hour_ms", "left_anti").select("hour_ms")
    n = changed.count()
    if n:
        hour = F.floor(F.col("time_ms") / HOUR_MS) * HOUR_MS
        rows = quotes.withColumn("__h", hour).join(changed.withColumnRenamed("hour_ms", "__h"), "__h", "left_semi").drop("__h")
        write = second_mids(rows).repartition("hour_ms").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        write.partitionBy("hour_ms").parquet(f"{path}/mids")
    lost = [r["hour_ms"] for r in gone.collect()]  # hours
    for h in lost:
        files.remove(spark, f"{path}/mids/hour_ms={h}")
    if n or lost:
        now.write.parquet(f"{path}/manifest-next")
        files.move(spark, f"{path}/manifest-next", f"{path}/manifest")
    return n + len(lost)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/mids").select("session_id", "second_ms", "mid")
