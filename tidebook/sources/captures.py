"""Sources and sinks: recorded depth and trade captures, bars, and result tables."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = "array<array<string>>"


def hourly_paths(root: str, symbol: str, kind: str, start: datetime, hours: int) -> list[str]:
    """Files of ``hours`` hours: {symbol}_{kind}_YYYYMMDD_HH00.jsonl.gz."""
    times = (start + timedelta(hours=i) for i in range(hours))
    return [f"{root}/{symbol}_{kind}_{t:%Y%m%d_%H}00.jsonl.gz" for t in times]


def require_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """``paths``, or an error that lists all missing ones; any file system that Spark reads will do."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(p: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(conf).exists(path)

    if missing := [p for p in paths if not there(p)]:
        raise FileNotFoundError("missing captures: " + ", ".join(missing))
    return list(paths)


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Non-blank lines with their place: file name, then number. A compressed file is one partition, in line order."""
    rows = spark.read.text(paths if isinstance(paths, str) else list(paths))
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    return rows.select(F.trim("value").alias("value"), place.alias("place")).filter("value <> ''")


def _field(path: str, kind: str = "string") -> Column:
    got = F.get_json_object("value", f"$.{path}")
    return got if kind == "string" else got.cast(kind)


def _epoch_ms(text: Column) -> Column:
    """ISO time as milliseconds; without a zone it is UTC (the session's zone)."""
    return F.unix_millis(F.to_timestamp(text))


def _levels(path: str) -> Column:
    pairs = F.from_json(F.get_json_object("value", f"$.{path}"), PAIRS)
    return F.transform(pairs, lambda x: F.struct(x[0].cast("decimal(28,10)").alias("price"), x[1].cast("decimal(28,10)").alias("qty")))


def with_seq(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``seq`` from the place of each line: files in name order, then lines; within ``by``, so files spread over tasks."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("place.file", "place.line")
    return rows.withColumn("seq", F.row_number().over(w).cast("long"))


def read_depth(spark: SparkSession, paths: str | Sequence[str], session: Column | None = None) -> DataFrame:
    """Depth captures as rows for ``bridge_snapshots``; a line with a ``type`` is a snapshot."""
    rows = _lines(spark, paths)
    snap = F.get_json_object("value", "$.type").isNotNull()
    rows = rows.select(
        (session if session is not None else F.lit(0)).alias("session_id"), "place", _epoch_ms(_field("recv_time")).alias("recv_ms"),
        F.when(snap, _epoch_ms(_field("request_time"))).alias("request_ms"), F.when(snap, "snapshot").otherwise("diff").alias("event_type"),
        F.when(~snap, _field("data.E", "long")).alias("time_ms"), F.when(~snap, _field("data.U", "long")).alias("first_update_id"),
        F.when(snap, _field("data.lastUpdateId", "long")).otherwise(_field("data.u", "long")).alias("last_update_id"),
        F.when(snap, _levels("data.bids")).otherwise(_levels("data.b")).alias("bids"), F.when(snap, _levels("data.asks")).otherwise(_levels("data.a")).alias("asks"),
    )
    return with_seq(rows, ["session_id"]).drop("place")


def read_trades(spark: SparkSession, paths: str | Sequence[str], session: Column | None = None) -> DataFrame:
    """Trade captures, ordered by their lines and timed by the exchange's trade time."""
    rows = _lines(spark, paths).select(
        (session if session is not None else F.lit(0)).alias("session_id"), "place", _epoch_ms(_field("recv_time")).alias("recv_ms"), _field("data.T", "long").alias("time_ms"),
        _field("data.a", "long").alias("agg_trade_id"), _field("data.p", "decimal(28,10)").alias("price"), _field("data.q", "decimal(28,10)").alias("qty"),
        _field("data.m", "boolean").alias("is_buyer_maker"),
    )
    return with_seq(rows, ["session_id"]).drop("place")


def events_for_replay(depth: DataFrame, trades: DataFrame) -> DataFrame:
    """The merged stream of ``sim.replay`` from both captures: bridged depth and trades with gap marks."""
    from ..operators.streams import bridge_snapshots, trade_gaps

    empty = F.array().cast("array<struct<price: decimal(28,10), qty: decimal(28,10)>>")
    d = bridge_snapshots(depth).withColumns({"price": F.lit(None).cast("decimal(28,10)"), "qty": F.lit(None).cast("decimal(28,10)"), "is_buyer_maker": F.lit(None).cast("boolean"), "kind": F.lit(0)})
    # a resync stands before its snapshot
    d = d.withColumn("seq", F.col("seq") * 2 + F.col("sub")).withColumns({c: F.when(F.col("event_type") == "resync", empty).otherwise(F.col(c)) for c in ("bids", "asks")})
    t = trade_gaps(trades).withColumns({"event_type": F.lit("trade"), "dispatch": F.lit(True), "kind": F.lit(1), "bids": empty, "asks": empty}).withColumn("seq", F.col("seq") * 2)
    cols = ["session_id", "time_ms", "kind", "seq", "event_type", "bids", "asks", "price", "qty", "is_buyer_maker", "has_gap", "dispatch"]
    return d.select(*cols).unionByName(t.select(*cols))


def read_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from Parquet, or CSV with open_time; both ends of the range are included, and filters reach the scan."""
    if path.endswith(".csv"):
        rows = spark.read.csv(path, header=True, schema="open_time timestamp, open double, high double, low double, close double, volume double")
        rows = rows.withColumnRenamed("open_time", "day")
    else:
        rows = spark.read.parquet(path)
        rows = rows.withColumnRenamed("open_time", "day") if "open_time" in rows.columns else rows
    if start is not None:
        rows = rows.filter(F.col("day") >= F.lit(start).cast(rows.schema["day"].dataType))
    if end is not None:
        rows = rows.filter(F.col("day") <= F.lit(end).cast(rows.schema["day"].dataType))
    return rows


def list_symbols(spark: SparkSession, root: str, pattern: str = "*") -> list[str]:
    """Names of the bar files below ``root``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}")
    found = path.getFileSystem(conf).globStatus(path)
    return sorted(str(f.getPath().getName()) for f in found or [])


def file_hashes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """SHA-256 of whole files."""
    rows = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Decimals in plain notation, null as nothing, arrays and maps as JSON."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        cols.append((F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string") if kind.startswith("decimal") else c).alias(f.name))
    w = df.select(*cols).write.mode("overwrite").option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def write_results(tables: dict[str, DataFrame], root: str, provenance: dict[str, object]) -> None:
    """A folder per table as Parquet, and the provenance beside them; readers take the tables without parsing."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{safe_component(name)}")
    spark.createDataFrame([(canonical_json(provenance),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/provenance")


def read_results(spark: SparkSession, root: str, names: Iterable[str], require: Mapping[str, object] | None = None) -> tuple[dict[str, DataFrame], dict]:
    """Tables and provenance of a run; an error if the provenance lacks or contradicts any of ``require``.

    A value of ``require`` is what must be found, or a function that says whether what was found will do.
    """
    told = json.loads(spark.read.text(f"{root}/provenance").first()[0])
    wrong = []
    for field, want in (require or {}).items():
        if field not in told:
            wrong.append(f"{field} is missing")
        elif not (want(told[field]) if callable(want) else told[field] == want):
            wrong.append(f"{field} is {told[field]!r}")
    if wrong:
        raise ValueError(f"{root} can't be used: {'; '.join(wrong)}")
    return {n: spark.read.parquet(f"{root}/{safe_component(n)}") for n in names}, told


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def manifest_hash(rows: Sequence[dict]) -> str:
    """Identity of a small manifest: SHA-256 of its canonical JSON."""
    import hashlib

    return hashlib.sha256(canonical_json(list(rows)).encode()).hexdigest()


def safe_component(name: str) -> str:
    """A single path component of letters, digits, dot, dash and underscore."""
    import re

    if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9._-]*", name):
        raise ValueError(f"not a safe path component: {name!r}")
    return name
