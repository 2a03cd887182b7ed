"""One stream cut into many chunks gives what a loop over its rows gives."""

import random

import pytest
from pyspark.sql import functions as F

from tidebook.operators import integrity as I
from tidebook.operators import scans
from tidebook.operators import streams as S

DEPTH = "seq long, recv_ms long, request_ms long, event_type string, time_ms long, first_update_id long, last_update_id long"


def recorded(seed, n):
    rng, rows, uid, ms = random.Random(seed), [], 100, 1_000
    for seq in range(n):
        ms += rng.choice([0, 1, 5])
        if rng.random() < 0.06:
            request = ms - rng.choice([0, 3]) if rng.random() < 0.5 else None
            rows.append((seq * 3, ms + rng.choice([0, 0, 9]), request, "snapshot", None, None, uid + rng.choice([-8, 0, 4, 30])))
        else:
            first = uid + 1 + (rng.random() < 0.05) * rng.choice([-1, 2])
            uid += rng.randrange(1, 9)
            rows.append((seq * 3, ms, None, "diff", ms - 2, first, uid))
    return rows


def replayed(rows):
    """The recovery rule, one row after the other."""
    out, wait, last, plain = [], None, None, None
    for seq, recv, request, kind, ms, first, uid in rows:
        if kind == "snapshot":
            tag = recv if request is None else request
            out.append((seq, "resync", tag, False, False, 0))
            wait, last = {"id": uid, "cutoff": recv, "timed": request is not None, "held": [], "seq": seq}, None
        elif wait is not None:
            if uid > wait["id"]:
                ok = wait["id"] + 1 in range(first, uid + 1) if last is None else first == last + 1
                last = uid
                if not ok:
                    out.append((seq, "diff", ms, True, True, 1))
                    wait = None
                else:
                    wait["held"].append(seq)
                    if recv > wait["cutoff"] or (wait["timed"] and recv == wait["cutoff"]):
                        out.append((wait["seq"], "snapshot", ms, False, False, 1))
                        out += [(s, "diff", ms, False, s == seq, 1) for s in wait["held"]]
                        wait = None
        else:
            out.append((seq, "diff", ms, plain is not None and first != plain + 1, True, 1))
        plain = uid
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_bridging_in_fifty_chunks_equals_a_loop(spark, seed):
    rows = recorded(seed, 600)
    depth = spark.createDataFrame(rows, DEPTH).repartition(5)
    want = replayed(rows)
    for chunk in (36, 10**9):
        got = S.bridge_snapshots(depth, by=(), chunk=chunk).select("seq", "event_type", "time_ms", "has_gap", "dispatch", "sub")
        assert sorted(map(tuple, got.collect())) == want
    assert I.snapshot_timing(depth, (), chunk=36).exceptAll(I.snapshot_timing(depth, (), chunk=10**9)).count() == 0


def test_gap_marks_in_chunks_equal_a_loop(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, None]), rng.randrange(0, 3000), rng.randrange(2), i, rng.choice(["diff"] * 8 + ["snapshot", "resync"]), rng.random() < 0.02) for i in range(900)]
    events = spark.createDataFrame(rows, "session_id int, time_ms long, kind int, seq long, event_type string, has_gap boolean")
    tainted = {(s, ms) for s, ms, _, _, _, gap in rows if gap}
    state, want = {}, []
    for s, ms, _, seq, what, _ in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        if (s, ms) in tainted or what == "resync":
            state[s] = True
        elif what == "snapshot":
            state[s] = False
        want.append((seq, (s, ms) in tainted, state.get(s, True)))
    got = S.gap_state(events, chunk_ms=60).select("seq", "censored", "in_gap")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_last_known_values_cross_empty_chunks_and_groups_of_chunks(spark):
    rows = spark.range(0, 4000, 7).select(F.col("id").alias("seq"), F.when(F.col("id") % 35 == 0, F.col("id")).alias("v"))
    got = scans.with_last(scans.in_chunks(rows, "seq", 10), {"last": F.col("v")}, (), fan=4)
    assert {r["seq"]: r["last"] for r in got.collect()} == {s: (s - 1) // 35 * 35 if s else None for s in range(0, 4000, 7)}


def test_no_window_holds_more_than_a_chunk(spark):
    depth = spark.createDataFrame(recorded(1, 400), DEPTH)
    plan = S.bridge_snapshots(depth, by=(), chunk=60)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window " in line or "Window [" in line]
    assert windows and all("__chunk" in w or "__fan" in w or "__of" in w for w in windows)


def test_accepted_hours_tolerate_named_reasons_only(spark):
    hours = spark.createDataFrame([(0, []), (1, ["no_trade_rows"]), (2, ["no_trade_rows", "depth_decode_error"])], "hour_ms long, rejection_reasons array<string>")
    valid = lambda *names: [r["valid"] for r in I.accepted(hours, names).orderBy("hour_ms").collect()]
    assert valid() == [True, False, False] and valid("no_trade_rows") == [True, True, False]
    with pytest.raises(ValueError, match="no such reasons: x"):
        I.accepted(hours, ["x"])
