"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are first aggregated by membership
pattern (the set of their sources); the driver sees one row per pattern. A flow
then routes each pattern's words to the sources' quotas: an arc for every epoch
of a pattern carries at most its words, and each further epoch costs more, so
repetition is spread as a convex cost wants. Last, documents are drawn in the
order of a seeded hash: a pattern that gives f of its words per epoch takes those
below the hash value at which the running sum of sizes reaches f, and a few
further ones that fill what is then missing.

Defined results: null text has no words; null and empty memberships are a
pattern, and so a source, of their own; sizes of zero take nothing; the hash is that of id and
text, so that null or repeated ids are drawn one by one, while rows that repeat both
are taken together; an empty table gives an empty result. Columns may have any names.

The driver holds one row for each pattern that occurs and each of ``BINS`` parts of its hash values.
"""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import checkpointed, packed

#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
SEED = 20_240_601
BINS = 256
LEVELS = 4
FILLS = 4
#: Per-pattern rows are broadcast up to this many, about 10 MB.
MAX_BROADCAST = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weights_by_rank(sources: list[str | None], cycle: tuple[int, ...] = (3, 1, 2)) -> dict[str | None, int]:
    """Weights repeat along the sources in code-point order, null last."""
    return {s: cycle[i % len(cycle)] for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


def targets(sizes: dict, weights: dict, share: float = 1.5, most: float = 2.0) -> dict:
    """Each source's words: ``share`` of all by weight, at most ``most`` times its own size, the excess reshared."""
    left, fixed = share * sum(sizes.values()), {}
    free = {s for s in sizes if weights[s] > 0}
    while free:
        unit = left / sum(weights[s] for s in free)
        over = {s for s in free if unit * weights[s] > most * sizes[s]}
        if not over:
            return {s: fixed.get(s, unit * weights[s] if s in free else 0.0) for s in sizes}
        for s in over:
            fixed[s] = most * sizes[s]
            left -= fixed[s]
        free -= over
    return {s: fixed.get(s, 0.0) for s in sizes}


def min_cost_flow(supply: dict, quota: dict, epochs: int = 2) -> dict:
    """Words that each (pattern, source, epoch) carries. Patterns are tuples of sources.

    Successive shortest paths on pattern epochs and sources; the k-th epoch of a
    pattern costs k*k, so the cost is convex in its repetitions.
    """
    flow: dict = defaultdict(int)
    left = {(p, k): n for p, n in supply.items() for k in range(epochs)}
    need = dict(quota)
    members = defaultdict(list)
    for p in sorted(supply, key=repr):
        for s in p:
            members[s].append(p)

    def route(goal):
        """Cheapest way from an epoch with words left to ``goal``, over words that can be handed on."""
        best, via, heap = {goal: 0}, {}, [(0, 0, goal)]
        n = 0
        found = None
        while heap:
            cost, _, s = heappop(heap)
            if cost > best[s] or found and cost >= found[0]:
                continue
            for p in members[s]:
                for k in range(epochs):
                    if left[p, k] > 0 and (found is None or cost + k * k < found[0]):
                        found = (cost + k * k, p, k, s)
                    for other in p:
                        if other != s and flow[p, other, k] > 0 and cost < best.get(other, float("inf")):
                            best[other], via[other] = cost, (p, k, s)
                            n += 1
                            heappush(heap, (cost, n, other))
        return found, via

    for s in sorted(need, key=repr):
        while need[s] > 0:
            found, via = route(s)
            if not found:
                break
            _, p, k, at = found
            amount, hops, x = min(need[s], left[p, k]), [], at
            while x != s:
                q, j, to = via[x]
                amount = min(amount, flow[q, x, j])
                hops.append((q, j, x, to))
                x = to
            left[p, k] -= amount
            flow[p, at, k] += amount
            for q, j, x, to in hops:  # x hands its words of (q, j) on to the next source
                flow[q, x, j] -= amount
                flow[q, to, j] += amount
            need[s] -= amount
    return {key: n for key, n in flow.items() if n}


def _in_patterns(rows: DataFrame, state: DataFrame, n: int, condition: Column) -> DataFrame:
    """Rows of the patterns in ``state`` for which ``condition`` holds; it is part of the join, so that no other row comes out of it."""
    state = state.withColumnRenamed("pattern", "of")
    return rows.join(F.broadcast(state) if n <= MAX_BROADCAST else state, (F.col("pattern") == F.col("of")) & condition)


def _cuts(rows: DataFrame, wanted: dict[str, float]) -> tuple[dict[str, int], dict[str, float]]:
    """For each pattern the largest hash value below which sizes sum up to no more than wanted, and what is missing.

    ``rows``: pattern, size, u (0 to 2^32 - 1). Each level looks at one bin of the
    last, so the driver sees at most ``BINS`` sums for a pattern.
    """
    spark = rows.sparkSession
    low, width = {p: 0 for p in wanted}, 1 << 32
    rest = dict(wanted)
    cuts: dict[str, int] = {}
    for level in range(LEVELS):
        if not low:
            break
        width //= BINS
        at = spark.createDataFrame(sorted(low.items()), "pattern string, low long")
        bin_of = F.floor((F.col("u") - F.col("low")) / width).cast("int")
        inside = (F.col("u") >= F.col("low")) & (F.col("u") < F.col("low") + width * BINS)
        sums = _in_patterns(rows, at, len(low), inside).groupBy("pattern", bin_of.alias("bin")).agg(F.sum("size").alias("size"))
        of = defaultdict(dict)
        for p, b, n in sums.collect():
            of[p][b] = n
        following = {}
        for p in low:
            left, cut = rest[p], None
            for b in range(BINS):
                n = of[p].get(b, 0)
                if n > left:
                    cut = b
                    break
                left -= n
            rest[p] = left
            if cut is None:
                cuts[p] = low[p] + width * BINS
            elif level == LEVELS - 1 or left <= 0:
                cuts[p] = low[p] + width * cut
            else:
                following[p] = low[p] + width * cut
        low = following
    return cuts, rest


def _fills(rows: DataFrame, cuts: dict[str, int], missing: dict[str, float]) -> dict[str, list[int]]:
    """For each pattern the hashes of a few rows beyond the cut that fill what is missing.

    First the largest rows that fit, at last the one that brings the sum nearest.
    """
    fills: dict[str, list[int]] = {p: [] for p in cuts}
    gap = dict(missing)
    for last in (False,) * (FILLS - 1) + (True,):
        state = [(p, cuts[p], float(gap[p]), fills[p]) for p in cuts if gap[p] >= 1]
        if not state:
            break
        gaps = rows.sparkSession.createDataFrame(state, "pattern string, cut long, gap double, used array<long>")
        off = F.abs(F.col("size") - F.col("gap"))
        fits = (off < F.col("gap")) if last else (F.col("size") > 0) & (F.col("size") <= F.col("gap"))
        fits = fits & (F.col("u") >= F.col("cut")) & ~F.array_contains("used", F.col("u"))
        near = _in_patterns(rows, gaps, len(state), fits).groupBy("pattern").agg(F.min(F.struct(off.alias("off"), "u", "size")).alias("x"))
        for p, x in near.collect():
            fills[p].append(x["u"])
            gap[p] -= x["size"]
    return fills


def mix(
    docs: DataFrame,
    members: Column,
    weights=weights_by_rank,
    share: float = 1.5,
    most: int = 2,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """row (the columns of ``docs`` as a struct), size, sources, source_size, target, epochs.

    ``members``: array of the sources of a row (a null element is a source, too).
    ``epochs``: how often the mix takes the row. ``source_size`` and ``target`` add up
    the row's sources.
    """
    spark = docs.sparkSession
    clean = F.array_sort(F.array_distinct(F.coalesce(members, F.array(F.lit(None).cast("string")))))
    clean = F.when(F.size(clean) == 0, F.array(F.lit(None).cast("string"))).otherwise(clean)
    text = F.col(f"`{text_col}`")
    keyed = docs.select(
        packed(docs).alias("row"),
        clean.alias("sources"),
        n_words(text).alias("size"),
        F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.coalesce(text, F.lit("")), F.lit(seed)), F.lit(1 << 32)).alias("u"),
    ).withColumn("pattern", F.to_json("sources", {"ignoreNullFields": "false"}))
    narrow = checkpointed(keyed.select("sources", "pattern", "size", "u"))
    patterns = narrow.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size")).collect()
    supply = {tuple(r["sources"]): r["size"] for r in patterns}
    name = {tuple(r["sources"]): r["pattern"] for r in patterns}
    sizes: dict = defaultdict(int)
    for p, n in supply.items():
        for s in p:
            sizes[s] += n
    weight = weights(list(sizes))
    # what overlapping patterns hold is shared out once
    quota = targets(dict(sizes), weight, share * sum(supply.values()) / max(1, sum(sizes.values())), most)
    flow = min_cost_flow(supply, {s: round(t) for s, t in quota.items()}, most)
    full, wanted = {}, {}
    for p, i in name.items():
        full[p] = 0
        for k in range(most):
            n = sum(flow.get((p, s, k), 0) for s in p)
            if n >= supply[p]:
                full[p] += 1
            elif n > 0:
                wanted[i] = wanted.get(i, 0) + n
    cuts, fills = {}, {}
    if wanted:
        cuts, missing = _cuts(narrow.select("pattern", "size", "u"), wanted)
        fills = _fills(narrow.select("pattern", "size", "u"), cuts, missing)
    schema = "pattern string, full int, source_size long, target double, cut long, fill array<long>"
    small = spark.createDataFrame(
        [(i, full[p], sum(sizes[s] for s in p), float(sum(quota[s] for s in p)), cuts.get(i, 0), fills.get(i, [])) for p, i in name.items()], schema
    )
    small = F.broadcast(small) if len(name) <= MAX_BROADCAST else small
    extra = ((F.col("u") < F.col("cut")) | F.array_contains("fill", F.col("u"))).cast("int")
    epochs = F.when(F.col("size") == 0, 0).otherwise(F.col("full") + extra)
    return keyed.join(small, "pattern").select("row", "size", "sources", "source_size", "target", epochs.alias("epochs"))
