"""Files of any store that Spark reads, through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Name and length of the files right in ``path``, hidden ones left out."""
    fs, p = _at(spark, path)
    found = [(s.getPath().getName(), s.getLen()) for s in (fs.listStatus(p) if fs.exists(p) else []) if s.isFile()]
    return sorted((n, size) for n, size in found if n[0] not in "._")


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """``path`` appears with all of ``text`` or not at all."""
    fs, p = _at(spark, path)
    _, draft = _at(spark, f"{path}.draft")
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(p, False)
    if not fs.rename(draft, p):
        raise OSError(f"can't rename {draft} to {path}")


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, a = _at(spark, source)
    _, b = _at(spark, target)
    fs.mkdirs(b.getParent())
    fs.delete(b, True)
    if not fs.rename(a, b):
        raise OSError(f"can't rename {source} to {target}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
