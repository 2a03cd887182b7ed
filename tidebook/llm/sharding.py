"""K-d tree partitioning into shards of near equal bytes.

A row is a point in the space of its metadata (size, mean bytes a character,
source, language) with its bytes as weight. Each node is split along the
dimension in which its points spread widest, at the weighted median, until a leaf
has one shard's target bytes. Medians are found by distributed histograms: one
aggregation per level and refinement serves all nodes, and the driver sees only
``BINS`` sums per node. Rows are then placed by one nested CASE expression, and
slots are counted per sub-bucket, so that no shard is ever one task.

Equal texts are one group and stay in one shard, unless the group is larger than
``MAX_GROUP`` of a shard: such groups (at most shards / MAX_GROUP of them) are cut
into parts by a hash of the id, so that a huge group can't unbalance the shards.
For that, the coordinates of a group are those of its smallest row.

Defined results: null text weighs ``OVERHEAD`` bytes and equals an empty text;
null metadata is a value of its own; repeated rows get slots of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import attach_groups, checkpointed, text_or_empty

SHARDS = 24
#: Bytes that a row counts besides its text.
OVERHEAD = 8
MAX_GROUP = 0.1
BINS = 1024
#: A split stops when its bin holds less than this share of a shard.
TOLERANCE = 0.002
#: Coordinates have 20 bits, followed by 42 bits of the group's hash, which tell equal coordinates apart.
COORD, TIE = 20, 42
ROWS_PER_SUB = 50_000


def _coordinate(value: Column, tie: Column) -> Column:
    return F.shiftleft(F.least(F.greatest(value, F.lit(0)), F.lit((1 << COORD) - 1)).cast("long"), TIE) + tie


def _ranked(value: Column) -> Column:
    """A string's place in a 20-bit space in the order of its first bytes."""
    head = F.rpad(F.hex(F.coalesce(value, F.lit("")).cast("binary").substr(1, 3)), 6, "0")
    return F.shiftright(F.conv(head, 16, 10).cast("long"), 4)


def _points(docs: DataFrame, id_col: str, text_col: str, labels: list[str]) -> tuple[DataFrame, list[str]]:
    text = text_or_empty(text_col)
    size = F.octet_length(text).cast("long") + OVERHEAD
    mean = F.octet_length(text) / F.greatest(F.char_length(text), F.lit(1))
    meta = {"m0": (F.log2(size.cast("double")) * 32768).cast("long"), "m1": ((mean - 1) * (1 << 18)).cast("long")}
    meta |= {f"m{2 + i}": _ranked(F.col(f"`{c}`").cast("string")) for i, c in enumerate(labels)}
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("h"),
        *[c.alias(n) for n, c in meta.items()],
    )
    return rows, list(meta)


def _place(shards: int, splits: dict[tuple[int, int], tuple[str, int, int]]) -> Column:
    """CASE expression for the tree: a node is (first shard, number of shards)."""

    def at(lo: int, n: int) -> Column:
        if (lo, n) not in splits:
            return F.lit(lo)
        dim, cut, left = splits[lo, n]
        return F.when(F.col(dim) < cut, at(lo, left)).otherwise(at(lo + left, n - left))

    return at(0, shards)


def build_tree(points: DataFrame, dims: list[str], shards: int) -> dict[tuple[int, int], tuple[str, int, int]]:
    """Splits of the k-d tree over ``points`` (``dims`` as long coordinates, ``bytes``)."""
    splits: dict[tuple[int, int], tuple[str, int, int]] = {}
    total = points.agg(F.sum("bytes")).first()[0] or 0
    spread_of = {}
    open_nodes = [(0, shards)]
    while open_nodes := [(lo, n) for lo, n in open_nodes if n > 1]:
        placed = points.withColumn("node", _place(shards, splits))
        edges = [f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]
        stats = {r["node"]: r for r in placed.groupBy("node").agg(F.sum("bytes").alias("bytes"), *edges).collect()}
        spread_of = spread_of or {d: max(1, stats[0][f"max_{d}"] - stats[0][f"min_{d}"]) if 0 in stats else 1 for d in dims}
        state = {}
        for lo, n in open_nodes:
            left = n // 2
            if lo not in stats:
                splits[lo, n] = (dims[0], 0, left)
                continue
            r = stats[lo]
            dim = max(dims, key=lambda d: ((r[f"max_{d}"] - r[f"min_{d}"]) / spread_of[d], -dims.index(d)))
            state[lo] = {"dim": dim, "n": n, "left": left, "want": r["bytes"] * left / n, "lo": r[f"min_{dim}"], "hi": r[f"max_{dim}"] + 1}
        pending = dict(state)
        while pending:
            # one aggregation narrows the medians of all nodes by a factor of BINS
            for s in pending.values():
                s["step"] = -(-(s["hi"] - s["lo"]) // BINS)
            # exact integer division: doubles are too coarse for 62 bits
            sums = defaultdict(dict)
            exact = F.lit(None).cast("long")
            for lo, s in pending.items():
                c = s["dim"]
                exact = F.when(
                    (F.col("node") == lo) & (F.col(c) >= s["lo"]) & (F.col(c) < s["hi"]),
                    F.expr(f"({c} - {s['lo']}L) div {s['step']}L"),
                ).otherwise(exact)
            binned = placed.select("node", exact.alias("bin"), "bytes").filter("bin is not null")
            for node, b, w in binned.groupBy("node", "bin").agg(F.sum("bytes")).collect():
                sums[node][b] = w
            for lo, s in list(pending.items()):
                acc = 0
                for b in sorted(sums[lo]):
                    w = sums[lo][b]
                    if acc + w > s["want"]:
                        break
                    acc += w
                low = s["lo"] + b * s["step"]
                if w <= TOLERANCE * total / shards or s["step"] == 1:
                    cut = low if s["want"] - acc < acc + w - s["want"] else low + s["step"]
                    splits[lo, s["n"]] = (s["dim"], cut, s["left"])
                    del pending[lo]
                else:
                    s |= {"lo": low, "hi": low + s["step"], "want": s["want"] - acc}
        open_nodes = [x for lo, n in open_nodes for x in ((lo, n // 2), (lo + n // 2, n - n // 2))]
    return splits


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    labels: tuple[str, ...] = ("source", "lang"),
    max_group: float = MAX_GROUP,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    rows, meta = _points(docs, id_col, text_col, [c for c in labels if c in docs.columns])
    rows = checkpointed(rows)
    n_rows, total = rows.agg(F.count("*"), F.sum("size")).first()
    target = (total or 0) / shards
    first = F.min(F.struct("doc_id", *meta))
    groups = rows.groupBy("h").agg(first.alias("first"), F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # a group counts as large by its bytes: there are at most shards / max_group of them
    large = groups.filter(F.col("bytes") > max(1.0, max_group * target)).select(
        "h", F.ceil(F.col("bytes") / F.lit(max(1.0, max_group * target))).cast("int").alias("parts")
    )
    parts = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0))
    keyed = rows.join(F.broadcast(large), "h", "left").withColumn("g", F.xxhash64("h", parts)).drop("parts")
    keyed = checkpointed(keyed)
    points = keyed.groupBy("g").agg(first.alias("first"), F.sum("size").alias("bytes"), F.count("*").alias("n"))
    tie = F.pmod(F.xxhash64("g", F.lit(7)), F.lit(1 << TIE))
    points = checkpointed(points.select("g", "bytes", "n", *[_coordinate(F.col(f"first.{m}"), tie).alias(m) for m in meta]))
    splits = build_tree(points, meta, shards)
    of_group = points.select("g", "n", _place(shards, splits).alias("shard"))
    placed = attach_groups(keyed, of_group, "g", "n", n_rows).drop("n")
    subs = max(8, -(-n_rows // (shards * ROWS_PER_SUB)))
    placed = checkpointed(placed.withColumn("sub", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(subs)).cast("int")).drop(*meta))
    return with_slots(placed, "shard", "sub").select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def with_slots(rows: DataFrame, shard_col: str, sub_col: str) -> DataFrame:
    """Adds ``slot``, gapless from 0 within a shard: sub-buckets are numbered apart and moved by their offsets."""
    from pyspark.sql import Window

    counts = rows.groupBy(shard_col, sub_col).agg(F.count("*").alias("n"))
    before = Window.partitionBy(shard_col).orderBy(sub_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard_col, sub_col, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(shard_col, sub_col).orderBy("doc_id", "crc", "size")
    numbered = rows.withColumn("__at", F.row_number().over(within) - 1)
    return numbered.join(offsets, [shard_col, sub_col]).withColumn("slot", (F.col("__before") + F.col("__at")).cast("long"))
