"""Best-fit packing by linear grouping.

Only lengths matter to a packing, and there are ``max_length`` of them at most, so the
plan is made in the driver from the histogram of lengths (one row per length, whatever
the number of documents) and applied by all tasks:

1. Lengths over ``1 / per_sequence`` of a sequence are large. Sorted, they fall into groups
   of equal cardinality (a length that fills one alone is one); a group's are rounded up to its largest.
2. The few sizes left give few configurations of a sequence. Their best mix is a linear
   program, solved by column generation: a simplex basis, and a knapsack over the
   sizes that prices the next configuration. Whole multiples of each are kept.
3. Actual documents take the places of the rounded ones, longest first. The sequences of
   one configuration then fall into runs of equal contents, as many as lengths change.
4. Large ones left over, then the small, go by best fit in falling order: into the fullest
   sequences that hold them, a run at a time, or into new ones.

Steps 1 to 4 are done for each number of groups in ``GROUPS`` and limit of the large in
``PER_SEQUENCE``; the plan with the fewest sequences is used.

A plan says of each length which ranks go into which sequences, in as many rows as there
are runs. A piece's rank among those of its length is its place within its input
partition, numbered while it is tokenised, and an offset for (partition, length) from a
running sum of counts; so no length's pieces ever meet in one task. Narrow rows go
through one shuffle, texts and ids through none (ids through that one if asked for).

Defined results: null text counts as empty (it has the end id alone); repeated rows are
pieces of their own; null ids of documents are kept; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import checkpointed, in_arrow
from .wordbpe import word_bpe

MAX_LENGTH = 4096
END_ID = 1
#: Numbers of groups, and how many of the smallest large pieces a sequence holds, that are tried.
GROUPS = (16, 48)
PER_SEQUENCE = (6, 4, 3, 2)
#: Steps of the simplex at most; stopping early costs sequences, not validity.
STEPS = 400


class Slot(NamedTuple):
    """``count`` pieces of ``length`` from rank ``first`` on lie in sequences from ``sequence`` on, ``each`` in a sequence, from ``offset`` on."""

    length: int
    first: int
    count: int
    sequence: int
    each: int
    offset: int


def grouped(counts: np.ndarray, least: int, n_groups: int) -> list[list[tuple[int, int, int]]]:
    """The lengths from ``least`` on in groups of equal cardinality, longest first: (length, first rank, count) of each part.

    A length isn't cut: one that fills a group by itself is a group, and needs no rounding.
    """
    each = -(-int(counts[least:].sum()) // n_groups)
    groups: list[list[tuple[int, int, int]]] = []
    held = each
    for length in range(len(counts) - 1, least - 1, -1):
        if n := int(counts[length]):
            if held >= each or n >= each:
                groups.append([])
                held = 0
            groups[-1].append((length, 0, n))
            held += n
    return groups


def best_configuration(worth: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size a sequence holds, so that their worth is greatest (a knapsack by number of pieces)."""
    use = np.flatnonzero(worth > 1e-12)
    out = np.zeros(len(sizes), dtype=np.int64)
    if not len(use):
        return out
    at = np.arange(capacity + 1)[None, :] - sizes[use][:, None]
    fits = at >= 0
    at = np.where(fits, at, 0)
    best, chosen = [np.zeros(capacity + 1)], []
    for _ in range(capacity // int(sizes[use].min())):
        gain = np.where(fits, best[-1][at] + worth[use][:, None], -1.0)
        pick = gain.argmax(axis=0)
        value = gain[pick, np.arange(capacity + 1)]
        keep = value > best[-1]
        chosen.append(np.where(keep, pick, -1))
        best.append(np.maximum(value, best[-1]))
    room = capacity
    for pick in reversed(chosen):
        if pick[room] >= 0:
            i = use[pick[room]]
            out[i] += 1
            room -= int(sizes[i])
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and whole numbers of sequences that use each, from the linear program's best mix, rounded down."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    cost = np.ones(k)
    for _ in range(STEPS):
        inverse = np.linalg.inv(basis)
        worth, x = cost @ inverse, inverse @ demand
        if worth.min() < -1e-9:  # more of that size than asked for pays off
            column, price = -np.eye(k)[int(worth.argmin())], 0.0
        else:
            column, price = best_configuration(worth, sizes, capacity).astype(float), 1.0
            if worth @ column <= 1 + 1e-7:
                break
        change = inverse @ column
        able = change > 1e-9
        if not able.any():
            break
        ratio = np.where(able, np.maximum(x, 0) / np.where(able, change, 1), np.inf)
        leaves = int(ratio.argmin())
        basis[:, leaves], cost[leaves] = column, price
    x = np.linalg.solve(basis, demand.astype(float))
    found, left = [], demand.copy()
    for j in np.argsort(-x, kind="stable"):
        column = np.rint(basis[:, j]).astype(np.int64)
        if cost[j] == 0 or not column.any():
            continue
        n = min(int(np.floor(x[j] + 1e-6)), int((left[column > 0] // column[column > 0]).min()))
        if n > 0:
            found.append((column, n))
            left = left - n * column
    return found


def plan_with(counts: np.ndarray, n_groups: int, per_sequence: int) -> tuple[list[Slot], int]:
    """Slots, and the number of sequences, for ``counts[length]`` pieces of each length."""
    capacity = len(counts) - 1
    slots: list[Slot] = []
    sequences = 0
    groups = grouped(counts, capacity // per_sequence + 1, n_groups)
    rooms: dict[int, list[tuple[int, int]]] = {}  # by tokens left: runs of sequences, (first, number)
    order: list[int] = []

    def put_back(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in rooms:
                insort(order, room)
            rooms.setdefault(room, []).append((first, n))

    if groups:
        sizes = np.array([g[0][0] for g in groups])
        demand = np.array([sum(p[2] for p in g) for g in groups])
        for column, n in configurations(sizes, demand, capacity):
            runs = [(sequences, n, 0)]  # first sequence, number, tokens used
            sequences += n
            for g in np.repeat(np.arange(len(groups)), column):
                parts, split = groups[g], []
                for first, left, used in runs:
                    while left:
                        length, rank, have = parts[0]
                        take = min(left, have)
                        slots.append(Slot(length, rank, take, first, 1, used))
                        split.append((first, take, used + length))
                        first, left = first + take, left - take
                        if take == have:
                            parts.pop(0)
                        else:
                            parts[0] = (length, rank + take, have - take)
                runs = split
            for first, m, used in runs:
                put_back(capacity - used, first, m)
    # what the configurations left, then the small, by best fit in falling order
    rest = sorted((p for g in groups for p in g), key=lambda p: (-p[0], p[1]))
    rest += [(length, 0, int(counts[length])) for length in range(capacity // per_sequence, 0, -1) if counts[length]]
    for length, rank, left in rest:
        while left:
            at = bisect_left(order, length)
            if at < len(order):
                room = order[at]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            each = room // length
            full = min(n, left // each)
            if full:
                slots.append(Slot(length, rank, full * each, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                put_back(room - each * length, first, full)
            first, n = first + full, n - full
            if n and left:  # fewer than ``each`` remain for one more sequence
                slots.append(Slot(length, rank, left, first, left, capacity - room))
                put_back(room - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            put_back(room, first, n)
    return slots, sequences


def plan(counts: np.ndarray) -> tuple[list[Slot], int]:
    """The best of the plans tried."""
    return min((plan_with(counts, g, p) for g in GROUPS for p in PER_SEQUENCE), key=lambda found: found[1])


def tokenised(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, max_length: int, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32, ids (null unless asked for), part, nth (of its length in this part)."""
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [("ids", pa.binary()), ("part", pa.int64()), ("nth", pa.int64())]
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe(vocabulary)
        part = TaskContext.get().partitionId()
        seen = [0] * (max_length + 1)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
                raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                for i, start in enumerate(range(0, len(ids) + 1, max_length)):
                    own = raw[4 * start : 4 * (start + max_length)]
                    length = len(own) // 4
                    rows.append((doc, i, start, length, zlib.crc32(own), own if with_ids else None, part, seen[length]))
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        encoder.forget()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return in_arrow(rows, pieces, "doc_id long, piece long, start long, length long, ids_crc32 long, ids binary, part long, nth long")


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_length: int = MAX_LENGTH,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (binary, little-endian uint32), sequence_id, offset.

    ``vocabulary``: path of the tokenizer file, the same on every executor. ``with_ids``: else ids are null.
    The numbered pieces are written to the shared folder once, so ranks hold if an executor is lost.
    """
    pieces = checkpointed(tokenised(docs, vocabulary, id_col, text_col, max_length, end_id, with_ids))
    held = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(max_length + 1, dtype=np.int64)
    for row in held.groupBy("length").agg(F.sum("n").alias("n")).collect():  # max_length rows at most
        counts[row["length"]] = row["n"]
    slots, _ = plan(counts)
    slots.sort()
    table = np.array(slots, dtype=np.int64).reshape(-1, len(Slot._fields))
    # one increasing number for (length, rank): where the lengths' ranks begin
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
    starts = begins[table[:, 0]] + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 6))
            slot = table[np.searchsorted(starts, begins[length] + rank, side="right") - 1]
            over = rank - slot[:, 1]
            put = (slot[:, 3] + over // slot[:, 4], slot[:, 5] + over % slot[:, 4] * length)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], *map(pa.array, put)], names=[*b.schema.names[:6], "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("before") + F.col("nth")).alias("rank")
    )
    placed = in_arrow(ranked, place, "doc_id long, piece long, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long", rows=100_000)
    return placed.withColumn("piece", F.col("piece").cast("int"))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences' own ids, pieces in order of place: sequence_id, length, ids. ``packed`` with ids; a sequence has ``max_length`` pieces at most."""
    placed = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), placed.alias("own"))
    return joined.select("sequence_id", "length", F.expr("aggregate(own, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))
