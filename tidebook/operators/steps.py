"""Resumable chains of steps.

A step's key is the hash of its name, version, parameters and the content of its inputs. Its result is
written beside its place, moved there, and then entered in the manifest with its content's hash and
its files; the entry appears whole or not at all. A step whose key is entered and whose files
are as entered isn't run again. As inputs count by content, a step that is run again with
the same result doesn't make later ones run.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources import files
from ..sources.captures import canonical_json, safe_component
from .digests import content


@dataclass(frozen=True)
class Step:
    """``run`` takes the session and its inputs by name: sources and earlier steps. ``version`` changes with the code."""

    name: str
    run: Callable[[SparkSession, Mapping[str, DataFrame]], DataFrame]
    inputs: tuple[str, ...] = ()
    params: Mapping[str, object] = field(default_factory=dict)
    version: str = "1"


@dataclass(frozen=True)
class Outcome:
    tables: dict[str, DataFrame]
    ran: list[str]
    digests: dict[str, str]


def content_hash(df: DataFrame) -> str:
    return hashlib.sha256(canonical_json([df.dtypes, [str(x) for x in content(df).first()]]).encode()).hexdigest()


def run_steps(spark: SparkSession, root: str, sources: Mapping[str, DataFrame], steps: Sequence[Step]) -> Outcome:
    """All tables by name, and the steps that had to run. Steps stand behind those that they take."""
    tables, ran = dict(sources), []
    hashes = {n: content_hash(df) for n, df in sources.items()}
    for step in steps:
        key = hashlib.sha256(canonical_json([step.name, step.version, dict(step.params), [[n, hashes[n]] for n in step.inputs]]).encode()).hexdigest()
        place = f"{root}/{safe_component(step.name)}/{key}"
        entry = json.loads(files.read_text(spark, f"{place}.json") or "null")
        if entry is None or entry["files"] != [list(f) for f in files.listed(spark, place)]:
            draft = f"{root}/_drafts/{uuid.uuid4().hex}"
            step.run(spark, {n: tables[n] for n in step.inputs}).write.parquet(draft)
            files.move(spark, draft, place)
            entry = {"step": step.name, "digest": content_hash(spark.read.parquet(place)), "files": files.listed(spark, place)}
            files.put_text(spark, f"{place}.json", canonical_json(entry))
            ran.append(step.name)
        tables[step.name], hashes[step.name] = spark.read.parquet(place), entry["digest"]
    return Outcome({s.name: tables[s.name] for s in steps}, ran, hashes)
