"""Exact ranked lexical search with range-maximum sparse tables.

Documents lie in blocks of at most ``BLOCK`` rows. A block's posting lists are sorted by place in
the block; over each list's impacts lies a sparse table (for every power of two, where the
maximum of the run from each place lies), so the largest impact within any interval of
documents is two look-ups. An item's search is best-first over intervals: the sum of its
terms' range maxima bounds the score of every document inside. The interval with the highest
bound is taken, split at the document where the heaviest of those maxima lies, that document
is scored, and both sides get bounds of their own. Intervals whose bound is below the k-th
best score so far are never opened; one that only ties with it is opened if it can hold a
smaller id. All items of a block advance together, some of each item's best intervals at a
time, so that the arithmetic is done by numpy over flat arrays.

The block search runs twice. The first time each item opens ``PROBES`` documents a block at
most, and the k-th best of what all blocks found is a floor for the second time, in which
most blocks open hardly anything and only documents that reach the floor are passed on.

Tables on the way: one row per document with its length and the items' terms in it, written
to the shared folder (no text is shuffled); counts of documents per term. Items are taken in
chunks of ``TERMS`` distinct terms (more only if one item alone has more), each chunk against
all documents. The driver holds one chunk's terms and, for each, a count.

Defined results: null and empty texts have no terms, so such items get no rows; repeated rows
are items and documents of their own; null ids of documents come after all others among equal
scores and are returned as null; an item that fewer than ``k`` documents match gets those.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import checkpointed, give_back, in_arrow, small_batches

K = 20
#: Documents of a block, and posting entries after which a block is closed before that.
BLOCK, ENTRIES = 8192, 2_000_000
#: Documents that the first search opens for each item and block, at most.
PROBES = 48
#: Distinct terms of a chunk of items.
TERMS = 200_000
#: (interval, term) pairs that are bounded at once.
AT_ONCE = 300_000
LAST = np.iinfo(np.int64).max


def _term_bytes() -> bytes:
    """Letters and digits of ASCII and all bytes from 0x80 on are term bytes, A-Z in lower case; others part terms."""
    keep = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
    return bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in keep else 0x20 for b in range(256))


TERM_BYTES = _term_bytes()


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """Posting lists of one block, one after the other, with sparse tables of where maxima lie."""

    def __init__(self, ids: np.ndarray, slot: np.ndarray, place: np.ndarray, impact: np.ndarray):
        """``ids`` ascending; the postings' (slot, place) pairs ascending and distinct; ``impact`` without the term's weight."""
        self.ids, self.size = ids, len(ids)
        self.keys = slot * self.size + place
        self.place, self.impact = place, impact
        level = np.arange(len(slot), dtype=np.int32)
        longest = int(np.bincount(slot).max()) if len(slot) else 1
        self.tables = [level]
        step = 1
        while 2 * step <= longest:  # runs that reach into the next list are never asked for
            other = np.concatenate([level[step:], np.repeat(level[-1:], step)])
            level = np.where(impact[other] > impact[level], other, level)
            self.tables.append(level)
            step *= 2
        self.tables = np.stack(self.tables)
        self.log = np.zeros(longest + 1, dtype=np.int64)
        for n in range(2, longest + 1):
            self.log[n] = self.log[n // 2] + 1

    def find(self, slot: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first posting of each list at ``place`` or behind."""
        return np.searchsorted(self.keys, slot * self.size + place)

    def top(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the maximum of each non-empty run of postings lies."""
        j = self.log[hi - lo]
        one, two = self.tables[j, lo], self.tables[j, hi - (1 << j)]
        return np.where(self.impact[two] > self.impact[one], two, one)


class Items:
    """The items' terms as flat arrays: ``slot`` and ``weight`` of item i are those from ``start[i]`` to ``start[i + 1]``."""

    def __init__(self, start: np.ndarray, slot: np.ndarray, weight: np.ndarray):
        self.start, self.slot, self.weight = start, slot, weight
        self.count = np.diff(start)


def search_block(block: Block, items: Items, k: int, floor: np.ndarray, probes: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The best documents of each item: (item, place, score), in order, and how many were scored.

    ``floor``: scores below it don't count. With ``probes`` an item's search ends after about so many documents.
    """
    n_items = len(items.count)
    least = np.maximum(floor, 1)
    least_place = np.full(n_items, block.size)  # a tie at ``least`` must lie before this place
    best = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))  # item, score, place
    opened = np.zeros(n_items, dtype=np.int64)
    live = np.flatnonzero(items.count > 0)
    everywhere = np.zeros(len(live), dtype=np.int64), np.full(len(live), block.size)
    pending = _bounded(block, items, live, *everywhere, *_runs(block, items, live, *everywhere))
    while True:
        item, a, b, bound, split = pending
        open_ = (bound > least[item]) | ((bound == least[item]) & (a < least_place[item]))
        if probes is not None:
            open_ &= opened[item] < probes
        item, a, b, bound, split = (x[open_] for x in pending)
        if not len(item):
            break
        order = np.lexsort((a, -bound, item))
        item, a, b, bound, split = (x[order] for x in (item, a, b, bound, split))
        ranks = np.arange(len(item)) - np.searchsorted(item, item)
        active = np.unique(item)
        now = ranks < max(2, AT_ONCE // int(items.count[active].sum()))
        if probes is not None:
            now &= ranks < np.maximum(1, probes // 6)
        kept = tuple(x[~now] for x in (item, a, b, bound, split))
        item, a, b, split = (x[now] for x in (item, a, b, split))
        np.add.at(opened, item, 1)
        node, slot, own_weight = _entries(items, item)
        lo, mid, hi = block.find(slot, a[node]), block.find(slot, split[node]), block.find(slot, b[node])
        held = mid < hi
        held[held] = block.place[mid[held]] == split[node][held]
        part = np.zeros(len(node), dtype=np.int64)
        part[held] = own_weight[held] * block.impact[mid[held]]
        score = np.add.reduceat(part, np.concatenate([[0], np.cumsum(items.count[item])[:-1]]))
        left = _bounded(block, items, item, a, split, lo, mid, node, own_weight)
        right = _bounded(block, items, item, split + 1, b, mid + held, hi, node, own_weight)
        pending = tuple(np.concatenate(x) for x in zip(kept, left, right))
        best = _best(*(np.concatenate([x, y]) for x, y in zip(best, (item, score, split))), k, floor)
        full = np.flatnonzero(np.bincount(best[0], minlength=n_items) == k)
        last = np.searchsorted(best[0], full, side="right") - 1
        least[full], least_place[full] = best[1][last], best[2][last]
    return best[0], best[2], best[1], int(opened.sum())


def _entries(items: Items, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry per (node, term): the node's number, the term's slot and its weight."""
    count = items.count[item]
    node = np.repeat(np.arange(len(item)), count)
    at = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count) + items.start[item][node]
    return node, items.slot[at], items.weight[at]


def _runs(block: Block, items: Items, item: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    node, slot, own_weight = _entries(items, item)
    return block.find(slot, a[node]), block.find(slot, b[node]), node, own_weight


def _bounded(block: Block, items: Items, item, a, b, lo, hi, node, own_weight) -> tuple[np.ndarray, ...]:
    """The intervals that hold any posting, with the sum of their range maxima and the place of the heaviest."""
    some = np.flatnonzero(hi > lo)
    if not len(some):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    at = block.top(lo[some], hi[some])
    gain = own_weight[some] * block.impact[at]
    of = node[some]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    bound = np.add.reduceat(gain, first)
    heaviest = np.maximum.reduceat(gain, first)
    is_top = np.flatnonzero(gain == np.repeat(heaviest, np.diff(first, append=len(of))))
    own = of[first]
    split = block.place[at[is_top[np.searchsorted(of[is_top], own)]]]
    return item[own], a[own], b[own], bound, split


def _best(item, score, place, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each item, ties by place (ids ascend with it)."""
    enough = (score > 0) & (score >= floor[item])
    item, score, place = item[enough], score[enough], place[enough]
    order = np.lexsort((place, -score, item))
    item, score, place = item[order], score[order], place[order]
    keep = np.arange(len(item)) - np.searchsorted(item, item) < k
    return item[keep], score[keep], place[keep]


def _counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms of the text), term (numbers of those in the vocabulary, ascending), tf."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])
    size = max(len(vocabulary), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [terms(t) for t in b.column(1).to_pylist()]
            n = np.array([len(x) for x in own], dtype=np.int64)
            number = np.fromiter(map(vocabulary.get, chain.from_iterable(own), repeat(-1)), dtype=np.int64, count=int(n.sum()))
            key = np.repeat(np.arange(len(own)) * size, n) + number
            key, tf = np.unique(key[number >= 0], return_counts=True)
            ends = np.searchsorted(key, np.arange(len(own) + 1) * size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((key % size, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *lists], schema=schema)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return in_arrow(rows, count, "doc_id long, n long, term array<int>, tf array<long>")


def _blocks(batches: Iterator[pa.RecordBatch], impact, most: int) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    """Blocks of a partition's documents, with the terms' numbers by slot and the ids as they were (null: ``LAST``)."""

    def closed(held: list[tuple[np.ndarray, ...]]) -> tuple[Block, np.ndarray]:
        ids, n, size, term, tf = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(ids, kind="stable")
        place_of = np.empty(len(order), dtype=np.int64)
        place_of[order] = np.arange(len(order))
        place = np.repeat(place_of, size)
        present, slot = np.unique(term, return_inverse=True)
        by_list = np.argsort(slot * len(ids) + place)
        value = impact(tf, np.repeat(n, size))
        return Block(ids[order], slot[by_list], place[by_list], value[by_list]), present

    held, docs, entries = [], 0, 0
    for b in batches:
        size = b.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        some = np.flatnonzero(size > 0)
        if not len(some):
            continue
        ids = b.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
        held.append((ids[some], b.column(1).to_numpy(zero_copy_only=False)[some], size[some], *(b.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))))
        docs, entries = docs + len(some), entries + int(size.sum())
        if docs >= most or entries >= ENTRIES:
            yield closed(held)
            held, docs, entries = [], 0, 0
    if held:
        yield closed(held)


def _chunk(docs: DataFrame, chunk: list[tuple[int, dict[bytes, int]]], k: int, id_col: str, text_col: str, block_docs: int, probes: int) -> DataFrame:
    """(item, doc_id, score) of documents that may be among the ``k`` best of the chunk's items."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in chunk for t in own}))}
    counted = checkpointed(_counted(docs, vocabulary, id_col, text_col))
    whole = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = whole["docs"], whole["terms"]
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for row in counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator():  # TERMS rows at most
        df[row["term"]] = row["df"]
    own_weight = np.array([weight(n_docs, int(x)) for x in df], dtype=np.int64)
    numbers = np.array([i for i, _ in chunk], dtype=np.int64)
    start = np.cumsum([0, *(len(own) for _, own in chunk)])
    term = np.array([vocabulary[t] for _, own in chunk for t in own], dtype=np.int64)
    heavy = own_weight[term] * np.array([c for _, own in chunk for c in own.values()], dtype=np.int64)

    def impact(tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 75 + 25 * n * n_docs // n_terms
        return 1_000_000_000 * tf // (1000 * tf + 12 * m)

    def found(floor: np.ndarray, limit: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of_item = np.repeat(np.arange(len(numbers)), np.diff(start))
            for block, present in _blocks(batches, impact, block_docs):
                slot = np.searchsorted(present, term)
                here = (slot < len(present)) & (present[np.minimum(slot, len(present) - 1)] == term) & (heavy > 0)
                own = Items(np.concatenate([[0], np.cumsum(np.bincount(of_item[here], minlength=len(numbers)))]), slot[here], heavy[here])
                item, place, score, _ = search_block(block, own, k, floor, limit)
                ids = block.ids[place]
                cols = [pa.array(numbers[item]), pa.array(ids, mask=ids == LAST), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, names=["item", "doc_id", "score"])
            give_back()

        return run

    small_batches(docs.sparkSession)
    kind = "item long, doc_id long, score long"
    probed = counted.mapInArrow(found(np.zeros(len(chunk), dtype=np.int64), probes), kind)
    by_score = Window.partitionBy("item").orderBy(F.desc("score"))
    floors = probed.withColumn("at", F.row_number().over(by_score)).filter(F.col("at") <= k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
    floor = np.zeros(len(chunk), dtype=np.int64)
    at = {int(x): i for i, x in enumerate(numbers)}
    for row in floors.filter(F.col("n") == k).collect():  # one row per item of the chunk at most
        floor[at[row["item"]]] = row["floor"]
    return counted.mapInArrow(found(floor, None), kind)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_docs: int = BLOCK,
    probes: int = PROBES,
    chunk_terms: int = TERMS,
) -> DataFrame:
    """Each item's ``k`` best documents: item_id, rank (from 1), doc_id, score."""
    # a number for each row of items; written, so that all reads agree on it
    numbered = checkpointed(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")))
    parts: list[DataFrame] = []
    chunk: list[tuple[int, dict[bytes, int]]] = []
    seen: set[bytes] = set()
    for row in numbered.select("item", "text").toLocalIterator():
        own = dict(Counter(terms(row["text"])))
        if chunk and len(seen | own.keys()) > chunk_terms:
            parts.append(_chunk(docs, chunk, k, id_col, text_col, block_docs, probes))
            chunk, seen = [], set()
        chunk.append((row["item"], own))
        seen |= own.keys()
    if chunk:
        parts.append(_chunk(docs, chunk, k, id_col, text_col, block_docs, probes))
    if not parts:
        return numbered.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


#: The same rows in DuckDB's SQL.
ORACLE = r"""
with parsed as (
  select doc_id, row_number() over () as r,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents where text is not null
),
docs as (select *, len(terms) as n from parsed where len(terms) > 0),
whole as (select count(*) as n_docs, sum(n)::bigint as n_terms from docs),
tfs as (select r, term, count(*) as tf from (select r, unnest(terms) as term from docs) group by all),
weights as (
  select term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)::double))::bigint as w
  from (select term, count(*) as df from tfs group by term), whole
),
items as (
  select i, item_id, term, count(*) as times
  from (
    select i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select row_number() over () as i, item_id, text from benchmark)
  ) group by all
),
scored as (
  select i, any_value(item_id) as item_id, d.r, any_value(d.doc_id) as doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint as score
  from items join tfs using (term) join weights using (term) join docs d on d.r = tfs.r, whole
  group by i, d.r
),
ranked as (select *, row_number() over (partition by i order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20
"""
