"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text. Only
(blob, rule version) pairs that the ledger lacks are scanned, each distinct blob
once, and findings are joined back to all paths that ever held the blob.

Rows whose blob is certain to be unique (see ``bloom``) go to the scan as they are;
only possibly repeated ones are shuffled with their texts, reduced to one text per
blob before and after the shuffle. What is joined back is narrow, and the few blobs
with very many paths are broadcast.

Defined results: null text counts as empty and has no findings; repeated rows each
get the blob's findings; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .base import attach_groups, checkpointed, in_arrow, text_or_empty

#: Raise it with any change of the rules: all blobs are scanned anew.
RULE_VERSION = 1
#: Base rules, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BASE = ("assign", "access", "hex")
#: Rules that add spans to the base ones, with a string without which they can't match.
MORE = {
    "private_key": ("PRIVATE KEY-----", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
    "web_token": ("eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+")),
    "forge_token": ("gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    "chat_token": ("xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
}
KINDS = [*BASE, *MORE]
#: One of these is in any text with an assignment.
WORDS = ("passw", "secret", "token", "api")
_HEX_BYTES = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", dtype=np.uint8))


def may_have_hex(raw: bytes) -> bool:
    """A run of 32 hex digits covers two places in a row out of every 16th; without such a pair there is none."""
    hit = _HEX_BYTES[np.frombuffer(raw, dtype=np.uint8)[15::16]]
    return bool((hit[1:] & hit[:-1]).any())


def spans_of(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start and then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if may_have_hex(text.encode("utf-8", "surrogatepass")):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for kind, (sign, rule) in MORE.items():
        if sign in text:
            found += [(m.start(), KINDS.index(kind), m.end()) for m in rule.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [spans_of(t) for t in batch.column(2).to_pylist()]
        named = [
            [{"kind": k, "start": a, "end": b} for a, k, b in s] for s in spans
        ]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(named, pa.list_(kind))], ["blob", "paths", "spans"]
        )


def scan(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    rule_version: int = RULE_VERSION,
) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): findings has id, blob and spans of every row of ``versions``.

    ``ledger``: blob, rule_version, spans of earlier scans, or None. The ledger
    returned has the new blobs only; append it to the old one.
    """
    text = text_or_empty(text_col)
    rows = versions.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))
    keys = checkpointed(rows.select("id", "blob").withColumn("h", F.xxhash64("blob")))
    n_rows = keys.count()
    blocks = bloom.n_blocks(n_rows)
    texts = rows.select("blob", "text", F.xxhash64("blob").alias("h"))
    flagged = bloom.with_maybe_repeated(texts, "h", blocks, bloom.repeat_filter(keys, "h", blocks), "maybe")
    once = flagged.filter(~F.col("maybe")).select("blob", F.lit(1).cast("long").alias("paths"), "text")
    again = flagged.filter("maybe").groupBy("blob").agg(F.count("*").alias("paths"), F.first("text").alias("text"))
    blobs = once.unionByName(again)
    known = None
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == rule_version).select("blob", "spans").dropDuplicates(["blob"])
        blobs = blobs.join(known.select("blob"), "blob", "left_anti")
    scanned = checkpointed(in_arrow(
        blobs.select("blob", "paths", "text"), _scan, "blob binary, paths long, spans array<struct<kind: string, start: long, end: long>>"
    ))
    every = scanned
    if known is not None:
        counted = keys.groupBy("blob").agg(F.count("*").alias("paths"))
        every = scanned.unionByName(counted.join(known, "blob"))
    findings = attach_groups(keys.select("id", "blob"), every, "blob", "paths", n_rows)
    return findings.select("id", "blob", "spans"), scanned.select("blob", F.lit(rule_version).alias("rule_version"), "spans")


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(findings: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return findings.select(
        F.col("id").alias("doc_id"), *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
