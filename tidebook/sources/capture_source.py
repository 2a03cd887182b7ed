"""Hourly captures as a data source: ``spark.read.format("captures").option("root", ..).option("kind", "depth").load()``.

Files are named {symbol}_{kind}_YYYYMMDD_HH00.jsonl.gz. Each hour is one partition; filters on ``hour_ms`` choose
hours before any file is opened. A file is read as a stream, twice: for its SHA-256, and for its lines. A
line that can't be decoded, or the place where a file breaks off, is a row with ``bad``, and ends its file.
Paths may be of any store that pyarrow reads.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = """hour_ms long, file string, sha256 string, seq long, bad boolean, recv_ms long, request_ms long, event_type string, time_ms long,
first_update_id long, last_update_id long, agg_trade_id long, price string, qty string, is_buyer_maker boolean"""
FILE = "{symbol}_{kind}_{hour:%Y%m%d_%H}00.jsonl.gz"


def _store(root: str):
    from pyarrow import fs

    root = re.sub("^file:/+", "/", root)  # Hadoop writes file:/path
    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


def _ms(text: str) -> int:
    at = datetime.fromisoformat(text)
    return round((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def parsed(kind: str, line: str) -> tuple:
    """recv_ms to is_buyer_maker of one line."""
    record = json.loads(line)
    recv, data = _ms(record["recv_time"]), record["data"]
    if kind == "trade":
        return recv, None, "trade", data["T"], None, None, data["a"], data["p"], data["q"], data["m"]
    if "type" in record:
        return recv, _ms(record["request_time"]) if "request_time" in record else None, "snapshot", None, None, data["lastUpdateId"], None, None, None, None
    return recv, None, "diff", data["E"], data["U"], data["u"], None, None, None, None


class Hour(InputPartition):
    def __init__(self, hour_ms: int, file: str, path: str):
        self.hour_ms, self.file, self.path = hour_ms, file, path


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.kind, self.symbol = options["root"], options.get("kind", "depth"), options.get("symbol", "*")
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {EqualTo: lambda v: lambda h: h == v, In: lambda v: lambda h: h in v, LessThan: lambda v: lambda h: h < v, GreaterThan: lambda v: lambda h: h > v}
        kinds |= {LessThanOrEqual: lambda v: lambda h: h <= v, GreaterThanOrEqual: lambda v: lambda h: h >= v}
        for f in filters:
            if type(f) in kinds and f.attribute == ("hour_ms",):
                self.tests.append(kinds[type(f)](f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        store, base = _store(self.root)
        symbol = "[^_]+" if self.symbol == "*" else re.escape(self.symbol)
        name = re.compile(rf"{symbol}_{self.kind}_(\d{{8}}_\d{{2}})00\.jsonl\.gz")
        found = []
        for info in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if m := name.fullmatch(info.base_name):
                hour = int(datetime.strptime(m[1], "%Y%m%d_%H").replace(tzinfo=timezone.utc).timestamp()) * 1000
                if all(t(hour) for t in self.tests):
                    found.append(Hour(hour, info.base_name, info.path))
        return sorted(found, key=lambda p: (p.hour_ms, p.file))

    def read(self, partition: Hour) -> Iterator[tuple]:
        store, _ = _store(self.root)
        digest = hashlib.sha256()
        with store.open_input_stream(partition.path, compression=None) as raw:
            while part := raw.read(1 << 20):
                digest.update(part)
        head = (partition.hour_ms, partition.file, digest.hexdigest())
        with store.open_input_stream(partition.path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as lines:
            seq = 0
            try:
                for seq, line in enumerate(lines):
                    if line.strip():
                        yield *head, seq, False, *parsed(self.kind, line.decode())
            except (ValueError, KeyError, TypeError, EOFError, OSError, zlib.error):
                yield *head, seq, True, *[None] * 10


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)


def read_captures(spark: SparkSession, root: str, kind: str, symbol: str = "*") -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)
    return spark.read.format("captures").options(root=root, kind=kind, symbol=symbol).load()


def write_captures(rows: DataFrame, root: str, kind: str, symbol: str) -> DataFrame:
    """One file for each hour of ``rows`` (seq, time_ms to name the hour, line: JSON text); a row per file: hour_ms, file, lines, sha256.

    An hour is written line by line by one task under another name and moved into place, so a task that is run again leaves no half file.
    """
    hour = F.floor(F.col("time_ms") / 3_600_000) * 3_600_000
    dealt = rows.select(hour.alias("hour_ms"), "seq", "line").repartition("hour_ms").sortWithinPartitions("hour_ms", "seq")

    def write(batches):
        import pandas as pd
        from pyspark import TaskContext

        store, base = _store(root)
        store.create_dir(base, recursive=True)
        now, out, raw, n, done = None, None, None, 0, []

        def close() -> None:
            out.close()
            raw.close()
            name = FILE.format(symbol=symbol, kind=kind, hour=datetime.fromtimestamp(now / 1000, timezone.utc))
            store.move(draft, f"{base}/{name}")
            digest = hashlib.sha256()
            with store.open_input_stream(f"{base}/{name}", compression=None) as back:
                while part := back.read(1 << 20):
                    digest.update(part)
            done.append((now, name, n, digest.hexdigest()))

        for b in batches:
            for hour_ms, line in zip(b["hour_ms"], b["line"]):
                if hour_ms != now:
                    if now is not None:
                        close()
                    now, n = int(hour_ms), 0
                    draft = f"{base}/_{now}_{TaskContext.get().taskAttemptId()}"
                    raw = store.open_output_stream(draft, compression=None)
                    out = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0)
                out.write(line.encode() + b"\n")
                n += 1
        if now is not None:
            close()
        yield pd.DataFrame(done, columns=["hour_ms", "file", "lines", "sha256"])

    return dealt.mapInPandas(write, "hour_ms long, file string, lines long, sha256 string")
