"""Conversation prefix trie against a plain trie, in one shard and many, with long and odd conversations."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from tidebook.llm import prefix_trie as p

from .conftest import SF

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        built = (*own.get(c - int(math.fmod(c, 5)), [])[:h], *own[c][h:])
        for d in range(len(built) + 1):
            members[built[:d]].append(c)
        ends[built].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        own_saved = (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
        leaves[n] = sum(leaves[k] for k in children[n]) or 1
        saved[n] = own_saved + sum(saved[k] for k in children[n])
    return sorted(
        (
            (m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
            for n, m in members.items()
        ),
        key=str,
    )


def rows(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def test_matches_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    want = brute(map(tuple, table.select("conv_id", "turn", "role", "text").collect()))
    assert rows(p.trie(table)) == want == sorted(con.sql(p.ORACLE).fetchall(), key=str)


@pytest.mark.parametrize(("segment", "shard"), [(256, 4096), (3, 7), (1, 1)])
def test_segments_and_shards_do_not_change_the_trie(spark, segment, shard):
    rng = random.Random(segment)
    made = []
    for c in [*range(90), *range(-12, 0), 10**12]:
        n = rng.choice([1, 2, 3, 6, 14, 40])
        made += [(c, t, rng.choice(["user", "user", "bot"]), rng.choice(["a", "bb", "é"]) if t else "hello") for t in range(n)]
    rng.shuffle(made)
    got = p.trie(spark.createDataFrame(made, SCHEMA).repartition(5), segment=segment, shard=shard)
    assert rows(got) == brute(made)


def test_chains_hang_on_chains(spark):
    """Conversation 10 * (k + 1) leaves the path of 10 * k, so that chains nest as deep as there are conversations."""
    made = []
    for k in range(24):
        made += [(1000 - 5 * k, t, "u", "x" * (t + 1)) for t in range(10 + k)] + [(1000 - 5 * k, 10 + k, "u", f"end {k}")]
    assert rows(p.trie(spark.createDataFrame(made, SCHEMA))) == brute(made)


def test_hot_conversation_and_hot_copies(spark):
    made = [(3, t, "u", f"turn {t % 7}") for t in range(500)]
    made += [(c, t, "u", "same") for c in range(5, 405) for t in range(2)]
    made += [(7, 9, "u", "again")] * 30  # repeated rows are turns
    assert rows(p.trie(spark.createDataFrame(made, SCHEMA).repartition(6), segment=16, shard=50)) == brute(made)


def test_odd_rows(spark):
    made = [
        (1, 0, "user", None),
        (1, None, None, "first"),
        (1, 0, None, "user"),
        (None, 0, "user", "no conversation"),
        (2, 3, "", ""),
        (2, 3, "", ""),
        (6, 0, "us", "er"),
        (7, 0, "u", "ser"),
        (9, 1, "user", "long " * 100_000),
        (12, 2, "user", "€\U0001f389"),
    ]
    table = spark.createDataFrame(made, SCHEMA).selectExpr("*", "'x' as r", "1 as seg", "2 as key", "3 as depth", "4 as n", "5 as pos", "6 as hash")
    assert rows(p.trie(table)) == brute(made)
    assert p.trie(table.limit(0)).count() == p.trie(table.filter("conv_id is null")).count() == 0
