"""Ranked lexical search: block search against exhaustive scores, whole queries against brute force."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidebook.llm import lexical as L

from .conftest import SF

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    """(item_id, rank, doc_id, score) by scoring all documents."""
    own = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in own)
    total = sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in own:
            n = sum(c.values())
            score = 0
            for t in plain_terms(text):
                if t in c:
                    m = 100 - 25 + (25 * n * n_docs) // total
                    score += L.weight(n_docs, df[t]) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_terms():
    text = "Don't STOP_me 12x3 Ünï İ\x00 a b   \U0001f389ok é"
    assert [t.decode() for t in L.terms(text)] == plain_terms(text)
    assert L.terms(None) == L.terms("") == L.terms(" .,\n") == []


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 60), st.integers(1, 12), st.sampled_from([1, 3, 20]), st.booleans())
def test_block_search_equals_exhaustive_scores(seed, n_docs, n_terms, k, flat):
    rng = np.random.default_rng(seed)
    pairs = np.argwhere(rng.random((n_terms, n_docs)) < rng.random())
    impact = rng.integers(1, 3 if flat else 1000, len(pairs))  # flat: ties everywhere
    block = L.Block(np.arange(n_docs) * 3, pairs[:, 0], pairs[:, 1], impact)
    sizes = rng.integers(0, n_terms + 1, 5)
    slots = [np.sort(rng.choice(n_terms, s, replace=False)) for s in sizes]
    items = L.Items(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(slots).astype(np.int64), rng.integers(1, 4, int(sizes.sum())))
    dense = np.zeros((n_terms, n_docs), dtype=np.int64)
    dense[pairs[:, 0], pairs[:, 1]] = impact
    want, floor = [], np.zeros(5, dtype=np.int64)
    for i, s in enumerate(slots):
        score = items.weight[items.start[i] : items.start[i + 1]] @ dense[s] if len(s) else np.zeros(n_docs, dtype=np.int64)
        floor[i] = rng.choice([0, np.sort(score)[-min(k, n_docs)]])
        want += [(i, d, score[d]) for d in sorted(range(n_docs), key=lambda d: (-score[d], d))[:k] if score[d] > 0 and score[d] >= floor[i]]
    item, place, score, _ = L.search_block(block, items, k, floor)
    assert list(zip(item.tolist(), place.tolist(), score.tolist())) == want


def test_bounds_leave_most_documents_unopened():
    rng = np.random.default_rng(0)
    n = 4000
    pairs = np.argwhere(rng.random((30, n)) < 0.2)
    impact = (1000 * rng.random(len(pairs)) ** 8).astype(np.int64) + 1
    block = L.Block(np.arange(n), pairs[:, 0], pairs[:, 1], impact)
    items = L.Items(np.array([0, 6]), np.arange(6), np.full(6, 7))
    assert L.search_block(block, items, 5, np.zeros(1, dtype=np.int64))[3] < n / 4


@pytest.mark.parametrize(("block", "probes", "chunk"), [(8192, 48, 200_000), (16, 2, 60)])
def test_search_matches_brute_force(spark, block, probes, chunk):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = items.filter("item_id < 12")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert rows(L.search(docs.repartition(3), items, block_docs=block, probes=probes, chunk_terms=chunk)) == want


def test_search_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = L.search(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark")))
    assert rows(got) == sorted(con.sql(L.ORACLE).fetchall(), key=str)


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame(
        [(1, "one two THREE"), (1, "lang lang nothing"), (None, "has id"), (2, None), (3, ""), (4, "?!"), (5, "12345 six six"), (6, "absent")],
        "item_id long, text string",
    ).selectExpr("*", "1 as rank", "2 as score", "'x' as doc_id", "3 as item")
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    got = L.search(odd, items)
    assert rows(got) == want and got.columns == ["item_id", "rank", "doc_id", "score"]
    assert L.search(empty, items).count() == L.search(odd, items.limit(0)).count() == L.search(odd, items.filter("item_id = 2")).count() == 0


def test_many_equal_documents_tie_by_id(spark):
    docs = spark.range(500).selectExpr("499 - id as doc_id", "if(id % 3 = 0, 'aa bb cc', concat('aa ', id)) as text").repartition(4)
    items = spark.createDataFrame([(7, "aa bb")], "item_id int, text string")
    got = L.search(docs, items).orderBy("rank").collect()
    ids = sorted(499 - i for i in range(0, 500, 3))[:20]
    assert [r["doc_id"] for r in got] == ids and len({r["score"] for r in got}) == 1
    by_item = defaultdict(list)
    for r in got:
        by_item[r["item_id"]].append(r["rank"])
    assert by_item == {7: list(range(1, 21))}
