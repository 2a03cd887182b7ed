"""Exact top-k inner products by best-first search in M-trees.

Inner products become distances: with M the largest norm of a block, x is
extended to (x, sqrt(M^2 - |x|^2)) and q to (q, 0), so that
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x and the nearest vectors are the best ones.

Every task bulk-loads one M-tree per block of its candidates. A node is a page of
entries with routing vectors, covering radii and distances to the parent's routing
vector. A query opens pages in the order of their lower bounds; the stored parent
distance rules entries out before any distance is computed, and a page is left
alone once its bound is beyond the k-th best so far. Bounds are floating point with
slack; scores themselves are exact integers.

Queries are handed to the executors in chunks of at most ``QUERY_CHUNK``, so
what is broadcast is bounded, and each task returns at most k rows per query.

Defined results: vectors that are null or hold null or non-finite components take
no part, nor do rows without an id; vectors are compared with those of equal
length; rows that repeat an id count once, with their best score; scores beyond 64
bits are clipped; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_CHUNK = 20_000
PAGE = 256
BLOCK = 8192
LONG = (1 << 63) - 1


def whole(values: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * values.astype(np.float64))


def dots(xs: np.ndarray, q: np.ndarray) -> list[int]:
    """Exact inner products of integral rows with ``q``."""
    top = float(np.abs(xs).max(initial=0.0)) * float(np.abs(q).max(initial=0.0)) * max(1, len(q))
    if top < 2.0**53:
        return [int(v) for v in xs @ q]
    exact = [sum(int(a) * int(b) for a, b in zip(x, q)) for x in xs]
    return [max(-LONG - 1, min(LONG, v)) for v in exact]


class MTree:
    def __init__(self, ids: np.ndarray, xs: np.ndarray):
        self.ids, self.xs = ids, xs
        norms = np.einsum("ij,ij->i", xs, xs)
        self.top = float(norms.max(initial=0.0))
        self.unique = len(np.unique(ids)) == len(ids)
        self.high = float(np.abs(xs).max(initial=0.0))
        self.points = np.hstack([xs, np.sqrt(np.maximum(self.top - norms, 0.0))[:, None]])
        self.nodes: list[dict] = []
        self.root = self._load(np.arange(len(ids)), 0) if len(ids) else None

    def _apart(self, rows: np.ndarray, at: int) -> np.ndarray:
        d = self.points[rows] - self.points[at]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _load(self, rows: np.ndarray, route: int) -> int:
        """A page for ``rows`` whose entries know their distance to ``route``."""
        if len(rows) <= PAGE:
            self.nodes.append({"rows": rows, "parent": self._apart(rows, route), "ids": self.ids[rows], "xs": self.xs[rows]})
            return len(self.nodes) - 1
        n = min(PAGE, -(-len(rows) // (PAGE // 2)))
        seeds = rows[np.linspace(0, len(rows) - 1, n).astype(int)]
        far = np.stack([self._apart(rows, s) for s in seeds])
        near = far.argmin(axis=0)
        if np.bincount(near, minlength=n).max() > 0.9 * len(rows):  # equal or nearly equal points: cut evenly
            near = np.arange(len(rows)) * n // len(rows)
        kept = [(int(seeds[i]), rows[near == i], far[i][near == i]) for i in range(n) if (near == i).any()]
        page = {
            "routes": np.array([s for s, _, _ in kept]),
            "radius": np.array([d.max() for _, _, d in kept]),
            "parent": self._apart(np.array([s for s, _, _ in kept]), route),
        }
        page["below"] = [self._load(own, s) for s, own, _ in kept]
        self.nodes.append(page)
        return len(self.nodes) - 1

    def search(self, qid: int, q: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """``best``: (score, -id) found so far, best first; the same with this tree's vectors."""
        if self.root is None:
            return best
        qq = float(q @ q)
        point = np.append(q, 0.0)
        slack = 1e-9 * (1.0 + qq + self.top)
        exact = self.high * float(np.abs(q).max(initial=0.0)) * max(1, len(q)) < 2.0**53

        def limit() -> float:
            if len(best) < k:
                return float("inf")
            return float(np.sqrt(max(0.0, qq + self.top - 2.0 * best[-1][0]) + slack)) + 1e-9

        gap = float(np.linalg.norm(point - self.points[0]))
        heap = [(0.0, self.root, gap)]
        most = limit()
        while heap:
            bound, at, gap = heapq.heappop(heap)
            if bound > most:
                break
            page = self.nodes[at]
            least = np.abs(gap - page["parent"])
            if "rows" in page:
                near = least <= most
                n = int(near.sum())
                if not n:
                    continue
                ids, xs = (page["ids"], page["xs"]) if 2 * n > len(near) else (page["ids"][near], page["xs"][near])
                scores = xs @ q if exact else np.array(dots(xs, q), dtype=object)
                floor = best[-1][0] if len(best) >= k else None
                if floor is None and exact and self.unique and len(scores) > 2 * k:
                    floor = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]  # one spare for the query's own row
                some = np.flatnonzero(scores >= floor) if floor is not None else range(len(scores))
                found = {i: s for s, i in best}
                for row in some:
                    i = -int(ids[row])
                    if -i != qid:
                        found[i] = max(int(scores[row]), found.get(i, int(scores[row])))
                if len(some):
                    best = sorted(((s, i) for i, s in found.items()), reverse=True)[:k]
                    most = limit()
                continue
            maybe = np.flatnonzero(least - page["radius"] <= most)
            if len(maybe):
                d = self.points[page["routes"][maybe]] - point
                gaps = np.sqrt(np.einsum("ij,ij->i", d, d))
                lower = np.maximum(np.maximum(gaps, least[maybe]) - page["radius"][maybe], 0.0)
                for j in np.flatnonzero(lower <= most):
                    heapq.heappush(heap, (float(lower[j]), page["below"][maybe[j]], float(gaps[j])))
        return best


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows of each query row."""
    spark = vectors.sparkSession
    finite = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(vec_col).isNotNull() & finite & F.col(id_col).isNotNull())
    candidates = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    asked = rows.filter(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    n = asked.count()
    chunks = -(-n // QUERY_CHUNK)
    found = []
    for c in range(chunks):
        part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c).distinct().toArrow()
        ids = part.column("id").to_numpy()
        vectors_of = [whole(np.asarray(v, dtype=np.float64)) for v in part.column("v").to_pylist()]
        sent = spark.sparkContext.broadcast((ids, vectors_of))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, qs = sent.value
            best: list[list[tuple[int, int]]] = [[] for _ in qs]
            of_length: dict[int, list[int]] = {}
            for i, q in enumerate(qs):
                of_length.setdefault(len(q), []).append(i)
            held: dict[int, list] = {}

            def flush(length: int) -> None:
                own = held.pop(length)
                tree = MTree(np.concatenate([a for a, _ in own]), np.concatenate([b for _, b in own]))
                for i in of_length[length]:
                    best[i] = tree.search(int(ids[i]), qs[i], k, best[i])

            for batch in batches:
                lists = batch.column(1)
                lengths = np.asarray(lists.value_lengths())
                flat = np.asarray(lists.flatten(), dtype=np.float64)
                starts = np.cumsum(lengths) - lengths
                own = np.asarray(batch.column(0))
                for length in np.unique(lengths):
                    if int(length) not in of_length:
                        continue
                    at = np.flatnonzero(lengths == length)
                    for a in range(0, len(at), BLOCK):
                        some = at[a : a + BLOCK]
                        xs = whole(flat[starts[some][:, None] + np.arange(length)])
                        held.setdefault(int(length), []).append((own[some], xs))
                        if sum(len(x) for x, _ in held[int(length)]) >= BLOCK:
                            flush(int(length))
            for length in list(held):
                flush(length)
            out = [(int(ids[i]), -j, s) for i, b in enumerate(best) for s, j in b]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["query_id", "vec_id", "score"])

        found.append(candidates.mapInArrow(search, "query_id long, vec_id long, score long"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    merged = reduce(DataFrame.union, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), p as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
