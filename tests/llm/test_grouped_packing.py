"""Best-fit packing by linear grouping: whole results, near the bound, and whole documents back."""

import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidebook.llm import grouped_packing as g

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def unrolled(counts, slots):
    """What lies in each sequence: (offset, length, rank)."""
    held = defaultdict(list)
    for s in slots:
        for i in range(s.count):
            held[s.sequence + i // s.each].append((s.offset + i % s.each * s.length, s.length, s.first + i))
    return held


def check_plan(counts, slots, n):
    held = unrolled(counts, slots)
    assert sorted(held) == list(range(n))
    assert sorted((length, rank) for own in held.values() for _, length, rank in own) == [
        (length, rank) for length in range(len(counts)) for rank in range(counts[length])
    ]
    for own in held.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at < len(counts)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 90), max_size=25), st.sampled_from([1, 3, 12]), st.sampled_from([2, 4, 6]))
def test_plans_place_every_piece_once_without_gaps(lengths, n_groups, per_sequence):
    counts = np.zeros(65, dtype=np.int64)
    for length, n in lengths.items():
        counts[length] = n
    check_plan(counts, *g.plan_with(counts, n_groups, per_sequence))


def fewest(lengths, capacity):
    """The fewest sequences, by trying all ways."""

    @cache
    def need(left):
        if not left:
            return 0
        best = len(left)

        def fill(room, at, kept):
            nonlocal best
            if at == len(left):
                best = min(best, 1 + need(tuple(kept)))
                return
            if left[at] <= room:
                fill(room - left[at], at + 1, kept)
            if at:  # the longest goes in
                fill(room, at + 1, [*kept, left[at]])

        fill(capacity, 0, [])
        return best

    return need(tuple(sorted(lengths, reverse=True)))


def test_small_plans_against_brute_force():
    rng = np.random.default_rng(4)
    over = 0
    for _ in range(60):
        lengths = rng.integers(3, 20, 9)
        counts = np.bincount(lengths, minlength=31)
        n = g.plan(counts)[1]
        best = fewest(tuple(lengths.tolist()), 30)
        assert best <= n <= best + 1
        over += n - best
    assert over <= 6


def test_configurations_beat_best_fit_where_three_must_meet():
    lengths = np.random.default_rng(5).integers(1100, 1700, 30_000)
    counts = np.bincount(lengths, minlength=4097)
    least = -(-int(lengths.sum()) // 4096)
    found = g.plan(counts)[1]
    assert found < 1.06 * least < g.plan_with(counts, 1, 1)[1]


def test_hot_lengths_are_groups_of_their_own_and_plans_stay_small():
    counts = np.zeros(4097, dtype=np.int64)
    counts[[2000, 1000, 96]] = 10**9
    slots, n = g.plan(counts)
    assert n == -(-3096 * 10**9 // 4096) or n <= 1.1 * 3096 * 10**9 / 4096
    assert len(slots) < 200
    assert g.plan(np.zeros(4097, dtype=np.int64)) == ([], 0)


@pytest.mark.parametrize("length", [64, 4096])
def test_documents_come_back_whole(spark, odd, empty, length):
    docs = odd.repartition(3).persist()
    got = g.pack(docs, VOCAB, max_length=length).collect()
    plain = Tokenizer.from_file(VOCAB)
    want = defaultdict(int)
    for r in docs.collect():
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), length):
            own = np.array(ids[i : i + length], dtype="<u4").tobytes()
            want[r["doc_id"], i // length, i, len(own) // 4, zlib.crc32(own), own] += 1
    have = defaultdict(int)
    held = defaultdict(list)
    for r in got:
        have[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])] += 1
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == want
    for own in held.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= length
    total = sum(r["length"] for r in got)
    assert len(held) <= -(-total // length) + 1
    joined = g.sequences(g.pack(docs, VOCAB, max_length=length)).collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in joined) and sum(r["length"] for r in joined) == total
    assert g.pack(empty, VOCAB, max_length=length).count() == 0
