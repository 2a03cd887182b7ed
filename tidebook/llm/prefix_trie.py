"""Conversation prefix trie by vertical bitmaps.

Every distinct sequence of first turns is a node; its members are the conversations that
begin so. Conversations, ordered by id, are dealt in shards of ``SHARD``. A shard indexes
(position, turn) to a bitset of its conversations and walks its trie depth-first: a child is
the parent's bitset intersected with the posting of the lowest remaining member's next turn,
its count is a popcount, and where members end is one more intersection. So a shard gives a
row per node, with the node's count, smallest id and text of ended ids. These meet by the
node's key, a hash chained over its turns: as many rows for a node as shards that hold it,
already summed, read in order of ids with one row in memory.

* Long conversations are cut in segments of ``SEGMENT`` turns. A segment enters at a key that
  all conversations with the same turns before it share, so each is a shard's row of its own.
* Turns get their places from a range sort by (conversation, turn) and one offset for each
  partition, so that a conversation with a large share of all rows is spread over tasks.
* Sums over subtrees: nodes with the same smallest id form a chain downwards, and a chain hangs
  on a node of another chain. Totals of chains come by pointer doubling (rounds grow with
  the logarithm of how deep chains hang on chains), totals of nodes by running sums from a
  chain's end, within segments and over them.
* The text of ended ids is hashed in id order in one stream for each node (SHA-256 can't be split),
  which holds one shard's text at a time.

Texts aren't shuffled: a turn goes on as its MD5 (128 bits) and its byte length.

Defined results: rows without conversation id take no part; a null role or text is empty; turns
are ordered by number, null first, equal ones by the MD5 of role and text (repeated rows
are turns of their own); remainders have the sign of the id; an empty table gives no node.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import attach_groups, checkpointed, give_back, packed, small_batches, tidy

SEGMENT = 256
SHARD = 4096
#: Conversations of a family, and the most turns that they take over from its first one.
FAMILY, SHARED = 5, 8
ROOT = bytes(16)
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "key binary, parent binary, depth long, n_convs long, conv_id long, bytes long, ends string"


def _turns(conversations: DataFrame, conv: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """conv_id, pos (from 0), hash, bytes: a row for each turn, numbered in order."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    # the role's length in front tells role and text apart
    rows = conversations.select(
        conv.cast("long").alias("conv_id"),
        turn.cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("hash"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("salt"),  # equal rows needn't share a partition
    ).filter("conv_id is not null")
    order = ["conv_id", "turn", "hash", "salt"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(placed.select("conv_id", "hash", "bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    held = placed.groupBy("part", "conv_id").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    edges = held.groupBy("part").agg(F.min("conv_id"), F.max("conv_id"), F.max_by("n", "conv_id"))
    before: dict[int, tuple[int, int]] = {}  # by partition: its first conversation, and how many turns of it lie in earlier ones
    last, so_far = None, 0
    for part, low, high, n in sorted(map(tuple, edges.collect())):  # one row per partition
        before[part] = (low, so_far if low == last else 0)
        so_far = (so_far if low == high == last else 0) + n
        last = high
    starts = held.sparkSession.createDataFrame([(p, c, n) for p, (c, n) in before.items() if n], "part int, conv_id long, before long")
    firsts = held.join(F.broadcast(starts), ["part", "conv_id"], "left").select("part", "conv_id", "first", F.coalesce("before", F.lit(0)).alias("before"))
    # a (part, conversation) pair has a partition's rows at most
    return placed.join(firsts, ["part", "conv_id"]).select("conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "hash", "bytes")


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, pos, hash, bytes), and all conversations (conv_id, length)."""
    turn = F.struct("pos", "hash", "bytes")
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("pos") < SHARED, turn))).alias("head"))
    own = checkpointed(own)
    heads = own.select(F.col("conv_id").alias("base"), "head")
    asks = own.select(
        "conv_id",
        "n",
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)).alias("h"),
    )
    taken = F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast(heads.schema["head"].dataType))
    convs = checkpointed(asks.join(heads, "base", "left").select("conv_id", "n", "h", taken.alias("taken")))
    size = F.size("taken").cast("long")
    shifts = convs.select("conv_id", "n", "h", size.alias("b"))
    n_rows = shifts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    later = attach_groups(turns, shifts, "conv_id", "n", n_rows).filter("pos >= h")
    first = convs.select("conv_id", F.explode("taken").alias("t")).select("conv_id", "t.*")
    all_turns = later.select("conv_id", (F.col("pos") - F.col("h") + F.col("b")).alias("pos"), "hash", "bytes").unionByName(first)
    return all_turns, convs.select("conv_id", (size + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def _segments(turns: DataFrame, convs: DataFrame, size: int) -> DataFrame:
    """conv_id, seg, entry, leave (keys before and after a segment), hashes, sizes, ends (it is the conversation's last)."""
    cut = turns.select("conv_id", F.floor(F.col("pos") / size).alias("seg"), F.struct("pos", "hash", "bytes").alias("t"), F.lit(None).cast("long").alias("length"))
    lengths = convs.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / size))).alias("seg"), F.lit(None).alias("t"), "length")
    joined = cut.unionByName(lengths).groupBy("conv_id", "seg").agg(F.max("length").alias("length"), F.sort_array(F.collect_list("t")).alias("ts"))
    rows = joined.select("conv_id", "seg", "length", F.col("ts.hash").alias("hashes"), F.col("ts.bytes").alias("sizes"))
    short = rows.filter(F.col("length") < size).select("*", F.lit(ROOT).alias("entry"), F.lit(ROOT).alias("leave"))
    digest = F.md5(F.aggregate("hashes", F.lit(b""), lambda a, x: F.concat(a, x)))
    long = rows.filter(F.col("length") >= size).withColumns({"one": F.xxhash64("seg", digest), "two": F.xxhash64(digest, "seg", F.lit(2))})
    upto = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    key = F.unhex(F.concat(*[F.lpad(F.hex(F.bit_xor(c).over(upto)), 16, "0") for c in ("one", "two")]))
    before = F.lag("leave", 1).over(Window.partitionBy("conv_id").orderBy("seg"))
    long = long.withColumn("leave", key).withColumn("entry", F.coalesce(before, F.lit(ROOT)))
    ends = F.col("length") <= (F.col("seg") + 1) * size
    return short.unionByName(long.drop("one", "two")).select("conv_id", "seg", "entry", "leave", "hashes", "sizes", ends.alias("ends"))


def shard_nodes(seg: int, shard: list[tuple], segment: int) -> Iterator[tuple]:
    """The trie's nodes below the entries of one shard: rows of ``NODE``. ``shard``: segment number ``seg`` of conversations, ids ascending."""
    convs = [r[0] for r in shard]
    index: dict[tuple[int, bytes], int] = defaultdict(int)
    going: dict[int, int] = defaultdict(int)  # by position: conversations with a turn there
    ended: dict[int, int] = defaultdict(int)
    entries: dict[bytes, int] = defaultdict(int)
    for i, (_, entry, _, hashes, _, ends) in enumerate(shard):
        bit = 1 << i
        entries[entry] |= bit
        for at in enumerate(hashes):
            index[at] |= bit
            going[at[0]] |= bit
        if ends:
            ended[len(hashes)] |= bit

    def ids(bits: int) -> str | None:
        own = []
        while bits:
            low = bits & -bits
            own.append(str(convs[low.bit_length() - 1]))
            bits ^= low
        return ",".join(own) or None

    base = seg * segment
    stack = [(0, entry, None, bits) for entry, bits in entries.items()]
    while stack:
        pos, key, parent, bits = stack.pop()
        lowest = (bits & -bits).bit_length() - 1
        if parent is not None or base == 0:  # else the segment before has this node
            size = shard[lowest][4][pos - 1] if pos else 0
            yield key, parent, base + pos, bits.bit_count(), convs[lowest], size, ids(bits & ended[pos])
        rest = bits & going[pos]
        while rest:
            first = shard[(rest & -rest).bit_length() - 1]
            turn = first[3][pos]
            child = bits & index[pos, turn]
            last = pos + 1 == segment
            own = first[2] if last else hashlib.blake2b(key + turn, digest_size=16).digest()
            stack.append((pos + 1, own, key, child))
            rest &= ~child


def _walk(segment: int, size: int):
    """A function for ``mapInArrow``: segments, sorted by number and conversation, to ``NODE`` rows, ``size`` conversations at a time."""
    schema = pa.schema([("key", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in ("depth", "n_convs", "conv_id", "bytes")), ("ends", pa.string())])

    def written(seg: int, shard: list[tuple]) -> Iterator[pa.RecordBatch]:
        nodes = shard_nodes(seg, shard, segment)
        while out := list(islice(nodes, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, shard = 0, []
        for b in batches:
            for conv, own, *rest in zip(*(c.to_pylist() for c in b.columns)):
                if shard and (own != seg or len(shard) == size):
                    yield from written(seg, shard)
                    shard = []
                seg = own
                shard.append((conv, *rest))
        if shard:
            yield from written(seg, shard)
        give_back()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a key, which follow each other in order of ids, as one; the texts of ended ids are hashed one after the other."""
    schema = pa.schema([("key", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in ("depth", "n_convs", "conv_id", "bytes")), ("ends", pa.string())])
    row, digest, any_end = None, None, False
    for b in batches:
        out: list[tuple] = []
        for key, parent, depth, n, conv, size, ends in zip(*(c.to_pylist() for c in b.columns)):
            if row is None or row[0] != key:
                if row is not None:
                    out.append((*row, digest.hexdigest()))
                row, digest, any_end = [key, parent, depth, 0, conv, size], hashlib.sha256(), False
            row[3] += n
            if ends is not None:
                digest.update(f"{',' * any_end}{ends}".encode())
                any_end = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if row is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*row, digest.hexdigest()), schema)], schema=schema)
    give_back()


def _chain_totals(chains: DataFrame) -> DataFrame:
    """Chains (conv_id, up_conv, leaves, saved) with the sums over all chains below added, by pointer doubling."""
    spark = chains.sparkSession
    state = chains.withColumn("ptr", F.col("up_conv"))
    while True:
        state = checkpointed(state)
        tidy(spark)
        hanging = state.filter("ptr is not null")
        below = hanging.groupBy("ptr").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("n"))
        n_rows = hanging.count()
        if not n_rows:
            return state.drop("ptr")
        targets = below.select("ptr", "n").join(state.select(F.col("conv_id").alias("ptr"), F.col("ptr").alias("next")), "ptr")
        moved = attach_groups(hanging, targets, "ptr", "n", n_rows).select("conv_id", "up_conv", "leaves", "saved", F.col("next").alias("ptr"))
        moved = moved.unionByName(state.filter("ptr is null"))
        added = below.select(F.col("ptr").alias("conv_id"), "more_leaves", "more_saved")
        state = moved.join(added, "conv_id", "left").select(
            "conv_id",
            "up_conv",
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            "ptr",
        )


def trie(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    segment: int = SEGMENT,
    shard: int = SHARD,
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    small_batches(conversations.sparkSession)
    source = conversations.select(packed(conversations).alias("r"))
    turns = checkpointed(_turns(source, *(F.col(f"r.`{c}`") for c in (conv_col, turn_col, role_col, text_col))))
    segments = _segments(*_rebuilt(turns), segment).repartitionByRange("seg", "conv_id").sortWithinPartitions("seg", "conv_id")
    order = segments.select("conv_id", "seg", "entry", "leave", "hashes", "sizes", "ends")
    found = order.mapInArrow(_walk(segment, shard), NODE).repartition("key").sortWithinPartitions("key", "conv_id")
    nodes = checkpointed(found.mapInArrow(_merged, NODE))

    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    full = nodes.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    full = checkpointed(full.withColumns({"leaves": leaf, "saved": (F.col("n_convs") - 1) * F.col("bytes")}))

    chains = full.groupBy("conv_id").agg(F.min("depth").alias("depth"), F.min_by("parent", "depth").alias("key"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    chains = checkpointed(chains)
    hosts = full.filter("n_children > 0").select("key", F.col("conv_id").alias("up_conv"), F.col("depth").alias("up_depth"), "n_children")
    hung = attach_groups(chains.filter("key is not null"), hosts, "key", "n_children", chains.count()).select("conv_id", "depth", "up_conv", "up_depth", "leaves", "saved")
    roots = chains.filter("key is null").select("conv_id", "depth", F.lit(None).cast("long").alias("up_conv"), F.lit(None).cast("long").alias("up_depth"), "leaves", "saved")
    hung = checkpointed(hung.unionByName(roots))
    totals = _chain_totals(hung.select("conv_id", "up_conv", "leaves", "saved")).select("conv_id", "leaves", "saved")
    at_nodes = hung.drop("leaves", "saved").join(totals, "conv_id").filter("up_conv is not null")
    at_nodes = at_nodes.groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))

    heads = hung.select("conv_id", "depth", F.col("up_conv").alias("parent_conv_id"))
    rows = full.join(at_nodes, ["conv_id", "depth"], "left").join(heads, ["conv_id", "depth"], "left")
    none = F.lit(0).cast("long")
    rows = rows.select(
        "conv_id",
        "depth",
        F.floor(F.col("depth") / segment).alias("seg"),
        F.coalesce("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id"))).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", none)).alias("leaves"),
        (F.col("saved") + F.coalesce("more_saved", none)).alias("saved"),
        "ends",
    )
    # running sums from the chain's end: within a segment, and over the segments behind it
    within = Window.partitionBy("conv_id", "seg").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    rows = checkpointed(rows)
    later = rows.groupBy("conv_id", "seg").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).select(
        "conv_id", "seg", *[F.coalesce(F.sum(c).over(behind), none).alias(f"later_{c}") for c in ("l", "s")]
    )
    summed = rows.join(later, ["conv_id", "seg"])
    return summed.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.sum("leaves").over(within) + F.col("later_l")).alias("n_leaves"),
        (F.sum("saved").over(within) + F.col("later_s")).alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )


#: The same rows in DuckDB's SQL; the first lists are CRC-32 by its table.
ORACLE = """
with crc_table as (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as t
),
turns as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, turn,
         md5(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as hash
  from conversations where conv_id is not null
),
own as (select c, hash, strlen(text) as bytes, row_number() over (partition by c order by turn nulls first, hash) - 1 as pos from turns),
convs as (
  select c, c - c % 5 as base,
         xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split(c::varchar, ''), lambda s: ord(s)::bigint),
                                     lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 9 as h
  from (select distinct c from own), crc_table
),
shared as (select v.c, o.pos, o.hash, o.bytes from convs v join own o on o.c = v.base where o.pos < v.h),
taken as (select v.c, v.h, count(s.c) as b from convs v left join shared s using (c) group by all),
rebuilt as (
  select * from shared
  union all select o.c, o.pos - t.h + t.b, o.hash, o.bytes from own o join taken t using (c) where o.pos >= t.h
),
paths as (
  select c, pos + 1 as depth, string_agg(hash, '') over (partition by c order by pos) as path, bytes from rebuilt
  union all select c, 0, '', 0 from convs
),
lengths as (select c, max(depth) as length from paths group by c),
nodes as (
  select path, depth, min(c) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
         sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where depth = length), '')) as ends_sha256
  from paths join lengths using (c) group by path, depth
),
kids as (select p.path, count(k.path) as n_children, any_value(up.conv_id) as parent_conv_id
         from nodes p left join nodes k on k.depth = p.depth + 1 and left(k.path, 32 * p.depth) = p.path
                      left join nodes up on up.depth = p.depth - 1 and left(p.path, 32 * up.depth) = up.path
         group by p.path)
select n.conv_id, n.depth, k.parent_conv_id, n.n_convs, k.n_children,
       count(*) filter (where s.n_children = 0) as n_leaves,
       sum((s.n_convs - 1) * s.bytes)::bigint as saved_tokens, n.ends_sha256
from nodes n join kids k using (path)
     join (select path, n_convs, bytes, n_children from nodes join kids using (path)) s on left(s.path, 32 * n.depth) = n.path
group by all
"""
