"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines (split at line feeds, trimmed of ``[\\x20\\x09-\\x0D]``) within one character edit of each
other are one class, as are equal ones; the earliest line of a class, by doc_id, text and
line number, stays. Two texts are within one edit if and only if they give an equal variant:
after deleting the character at the same place from both (a substitution), or from the longer
one alone (an insertion). Each line emits the hashes of its variants, equal ones are
joined, and every pair is verified on the texts.

All variants of all lines would be hundreds of times the input, so lossless steps before leave
out most of them. The one edit of a pair lies within a half of the shorter line, and what is
outside that half is equal. So a line goes on with a half only if another line has the same outside
(with length and place). Halves are cut into ``PIECES``, and pieces again, in the same way, until
they have ``LEAF`` characters at most; only for such pieces variants are emitted, two dozen
for a line that has a neighbour and few for any other, however long the lines are and however many
share a template.

A line takes part in two roles: with a partner of its own length or a longer one (its frame is
its length), and as the longer one (its frame is one less).

Same-place variants form groups in which lines differ in one character, so a group is
never larger than the alphabet, and groups of an insertion have the shorter line as their centre: links
are stars. Equal lines are reduced to one before any join.

Defined results: null text has no lines; blank lines always stay and aren't counted; lines
under ``MIN_CHARS`` are compared for equality only; rows that repeat both id and text count as one
document, rows that repeat an id alone as several; null ids come last; an empty table gives
an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .base import attach_groups, checkpointed, packed, text_or_empty, tidy, unpacked
from .graph import components

MIN_CHARS = 12
PIECES, LEAF = 8, 12
#: Fixed value: what is trimmed from a line.
BLANK = " \t\x0b\x0c\r\n"
NOT_BLANK_LINE = r"[^\x20\x09-\x0D][^\n]*"


def _outside(x: Column, role: Column, frame: Column, start: Column, end: Column) -> Column:
    """Hash of what a line has outside the piece ``start`` to ``end`` of its frame, comparable between roles."""
    return F.xxhash64(F.substr(x, F.lit(1), start), F.substr(x, end + role + 1), frame, start, end)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h (hash of the text), no, x of all lines that aren't blank."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    return rows.select("id", "h", "no", F.btrim("raw", F.lit(BLANK)).alias("x")).filter("x <> ''")


def _node(x: Column) -> Column:
    return F.unhex(F.md5(x))


def _half(frame: Column) -> Column:
    return F.shiftright(frame, 1)


def _shared(keys: DataFrame, owner: str) -> DataFrame:
    """key, n of the keys that different owners have, one of them in the role of the shorter line; ``keys``: key, role, owner."""
    ends = keys.groupBy("key").agg(F.min(owner).alias("lo"), F.max(owner).alias("hi"), F.min("role").alias("first"), F.count("*").alias("n"))
    return checkpointed(ends.filter("lo <> hi and first = 0").select("key", "n"))


def _first_spans(places: DataFrame) -> DataFrame:
    """(node, role, piece): halves whose outside another line has, too."""
    keys = F.array(*[F.struct(F.col(f"k{i}").alias("key"), F.lit(i // 2).alias("role"), F.lit(i % 2).alias("piece")) for i in range(4)])
    every = places.filter("k0 is not null").select("node", "owner", F.explode(keys).alias("k")).select("node", "owner", "k.*")
    shared = _shared(every.select("key", "role", "owner"), "owner")
    n = shared.count()
    blocks = bloom.n_blocks(n)
    some = bloom.with_maybe_member(every, "key", blocks, bloom.member_filter(shared, "key", blocks), "hit").filter("hit")
    some = some.groupBy("node", "key", "role", "piece").agg(F.count("*").alias("copies"))
    return checkpointed(some.join(shared, "key").select("node", "role", "piece").distinct())


def _narrowed(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """``spans`` (node, role, start, end) cut into pieces until these are leaves; only what another line shares goes on."""
    leaves = []
    while True:
        leaves.append(spans.filter(F.col("end") - F.col("start") <= LEAF))
        spans = checkpointed(spans.filter(F.col("end") - F.col("start") > LEAF))
        if spans.isEmpty():
            return checkpointed(reduce(DataFrame.union, leaves).distinct())
        size = F.col("end") - F.col("start")
        pieces = F.transform(
            F.sequence(F.lit(0), F.lit(PIECES - 1)),
            lambda i: F.struct(
                (F.col("start") + F.floor(size * i / PIECES)).cast("int").alias("s"), (F.col("start") + F.floor(size * (i + 1) / PIECES)).cast("int").alias("e")
            ),
        )
        cut = spans.join(texts, "node").select("node", "x", "role", F.explode(pieces).alias("p")).select("node", "x", "role", "p.s", "p.e")
        frame = F.char_length("x") - F.col("role")
        cut = checkpointed(cut.select("node", "role", "s", "e", _outside(F.col("x"), F.col("role"), frame, F.col("s"), F.col("e")).alias("key")))
        shared = _shared(cut.select("key", "role", "node"), "node")
        spans = attach_groups(cut, shared, "key", "n", cut.count()).select("node", "role", F.col("s").alias("start"), F.col("e").alias("end")).distinct()
        tidy(texts.sparkSession)


def _variants(leaves: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, place, node, whole): hashes of a line without a character; the place counts in substitutions only (else -1)."""
    x = F.col("x")

    def without(i: Column) -> Column:
        return F.xxhash64(F.substr(x, F.lit(1), i), F.substr(x, i + 2))

    def cut(first: Column, last: Column, place: bool):
        return F.transform(
            F.sequence(first, last), lambda i: F.struct(without(i).alias("key"), (i if place else F.lit(-1)).cast("int").alias("place"), F.lit(False).alias("whole"))
        )

    # a whole line is hashed as the two parts that it has before and after the place where a longer line has one more
    same = F.when((F.col("role") == 0) & (F.col("end") > F.col("start")), cut(F.col("start"), F.col("end") - 1, True))
    longer = F.when(F.col("role") == 1, cut(F.col("start"), F.col("end"), False))
    at = F.transform(
        F.sequence(F.col("start"), F.col("end")),
        lambda i: F.struct(F.xxhash64(F.substr(x, F.lit(1), i), F.substr(x, i + 1)).alias("key"), F.lit(-1).alias("place"), F.lit(True).alias("whole")),
    )
    shorter = F.when(F.col("role") == 0, at)
    none = F.array().cast("array<struct<key:bigint,place:int,whole:boolean>>")
    all_of = F.concat(*[F.coalesce(v, none) for v in (same, longer, shorter)])
    found = leaves.join(texts, "node").select("node", F.explode(all_of).alias("v")).select("v.*", "node")
    return checkpointed(found.distinct())


def _links(leaves: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes within one edit that join all such nodes."""
    rows = _variants(leaves, texts)
    groups = rows.groupBy("key", "place").agg(
        F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.max(F.when(F.col("whole"), F.col("node"))).alias("shorter")
    )
    groups = groups.filter("lo <> hi and (place >= 0 or shorter is not null)")
    groups = checkpointed(groups.select(F.struct("key", "place").alias("g"), "n", F.when(F.col("place") >= 0, F.col("lo")).otherwise(F.col("shorter")).alias("a")))
    pairs = attach_groups(rows.select(F.struct("key", "place").alias("g"), "node"), groups, "g", "n", rows.count())
    pairs = pairs.filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("x").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("x").alias("y")), "b")
    return checkpointed(sides.filter(F.levenshtein("x", "y", 1) >= 0).select("a", "b"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document (id and text): doc_id, h (xxhash64 of the text), n_lines, n_dropped, dropped (line numbers from 0, sorted)."""
    x, size = F.col("x"), F.char_length("x")
    keys = {}
    for role in (0, 1):
        frame = size - role
        for piece, (s, e) in enumerate(((F.lit(0), _half(frame)), (_half(frame), frame))):
            keys[f"k{2 * role + piece}"] = F.when(size >= MIN_CHARS, _outside(x, F.lit(role), frame, s, e))
    lines = _lines(docs, id_col, text_col)
    places = checkpointed(lines.select("id", "h", "no", _node(x).alias("node"), F.xxhash64("x").alias("owner"), *[c.alias(k) for k, c in keys.items()]))
    n_places = places.count()
    spans = _first_spans(places)
    wanted = checkpointed(spans.select("node").distinct())
    blocks = bloom.n_blocks(wanted.count())
    item = F.xxhash64("node")
    some = lines.select(_node(x).alias("node"), "x").withColumn("item", item)
    some = bloom.with_maybe_member(some, "item", blocks, bloom.member_filter(wanted.select(item.alias("item")), "item", blocks), "hit").filter("hit")
    texts = checkpointed(some.groupBy("node").agg(F.first("x").alias("x")).join(wanted, "node"))
    tidy(docs.sparkSession)
    frame = F.char_length("x") - F.col("role")
    spans = spans.join(texts, "node").select(
        "node", "role", F.when(F.col("piece") == 0, 0).otherwise(_half(frame)).cast("int").alias("start"),
        F.when(F.col("piece") == 0, _half(frame)).otherwise(frame).cast("int").alias("end"),
    )
    labels = components(_links(_narrowed(spans, texts), texts))
    tidy(docs.sparkSession)
    first = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "h", "no"))
    groups = places.groupBy("node").agg(F.count("*").alias("n"), first.alias("first"))
    groups = groups.join(labels, "node", "left").filter("n > 1 or label is not null").select(
        "node", "n", "first", F.coalesce("label", "node").alias("label")
    )
    groups = checkpointed(groups)
    of_class = groups.groupBy("label").agg(F.min("first").alias("stays"))
    stays = checkpointed(groups.join(of_class, "label").select("node", "n", "stays"))
    late = attach_groups(places.select("id", "h", "no", "node"), stays, "node", "n", n_places).filter(
        ~(F.col("id").eqNullSafe(F.col("stays.id")) & (F.col("h") == F.col("stays.h")) & (F.col("no") == F.col("stays.no")))
    )
    gone = late.groupBy(F.col("id").alias("of"), F.col("h").alias("oh")).agg(F.array_sort(F.collect_set("no")).alias("dropped"))
    text = text_or_empty(text_col)
    counted = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.regexp_count(text, F.lit(NOT_BLANK_LINE)).cast("long").alias("n_lines"))
    counted = counted.groupBy("doc_id", "h").agg(F.max("n_lines").alias("n_lines"))
    empty = F.array().cast("array<int>")
    return counted.join(gone, counted["doc_id"].eqNullSafe(gone["of"]) & (counted["h"] == gone["oh"]), "left").select(
        "doc_id",
        "h",
        "n_lines",
        F.size(F.coalesce("dropped", empty)).cast("long").alias("n_dropped"),
        F.coalesce("dropped", empty).alias("dropped"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines taken out of the text."""
    cols = docs.columns
    gone = dropped_lines(docs, id_col, text_col).filter("n_dropped > 0").select(F.col("doc_id").alias("of"), F.col("h").alias("oh"), "dropped")
    rows = docs.select(packed(docs).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("h"))
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("oh")), "left")
    lines = F.transform(F.split(F.col(f"row.`{text_col}`"), "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    kept = F.array_join(F.transform(F.filter(lines, lambda r: ~F.array_contains("dropped", r["i"])), lambda r: r["x"]), "\n")
    new = F.when(F.col("dropped").isNull(), F.col(f"row.`{text_col}`")).otherwise(kept)
    return joined.select(*[new.alias(c) if c == text_col else part for c, part in zip(cols, unpacked(cols))])
