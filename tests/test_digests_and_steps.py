"""Digests, resumable steps and the cache of mids."""

import pytest
from pyspark.sql import functions as F

from tidebook.operators import caches, digests
from tidebook.operators.steps import Step, run_steps
from tidebook.sources import files

SHAPE = digests.Shape(chunk=10, fan=4, height=3)
COLS = ["seq", "v"]


def stream(spark, change=None, drop=None, n=600):
    rows = [(k, i, f"v{i}" if i % 9 else None) for k in (1, 2) for i in range(0, n, 2)]
    rows = [(k, i, "other" if (k, i) == change else v) for k, i, v in rows if (k, i) != drop]
    return spark.createDataFrame(rows, "k int, seq long, v string")


def test_digests_see_values_and_order_but_no_partitions(spark):
    a = stream(spark)
    one = {tuple(r) for r in digests.digests(a, COLS, ["k"], shape=SHAPE).collect()}
    assert one == {tuple(r) for r in digests.digests(a.repartition(7), COLS, ["k"], shape=SHAPE).collect()}
    assert len({r[2] for r in one}) == 1 and {r[1] for r in one} == {300}
    other = {r["k"]: r["digest"] for r in digests.digests(stream(spark, (2, 298)), COLS, ["k"], shape=SHAPE).collect()}
    assert {(k, d) for k, _, d in one} & set(other.items()) == {(1, other[1])}
    swapped = a.withColumn("seq", F.when(F.col("seq") == 4, 6).when(F.col("seq") == 6, 4).otherwise(F.col("seq")))
    assert {r["digest"] for r in digests.digests(swapped, ["v"], ["k"], shape=SHAPE).collect()}.isdisjoint(r["digest"] for r in digests.digests(a, ["v"], ["k"], shape=SHAPE).collect())
    with pytest.raises(Exception, match="must lie in"):
        digests.digests(stream(spark, n=700), COLS, ["k"], shape=SHAPE).collect()


@pytest.mark.parametrize(("change", "drop", "want"), [((2, 298), None, {2: 298}), (None, (1, 0), {1: 0}), ((1, 40), (2, 598), {1: 40, 2: 598}), (None, None, {})])
def test_first_difference(spark, change, drop, want):
    got = digests.first_difference(stream(spark), stream(spark, change, drop), COLS, ["k"], shape=SHAPE)
    assert {r["k"]: r["seq"] for r in got.collect()} == want


def chain(log, fail=None, version="1", factor=2):
    def step(name, takes, make, **more):
        def run(spark, inputs):
            log.append(name)
            if name == fail:
                raise RuntimeError(f"{name} broke")
            return make(*[inputs[t] for t in takes])

        return Step(name, run, takes, **more)

    return [
        step("a", ("src",), lambda d: d.filter("id % 2 = 0")),
        step("b", ("a",), lambda d: d.selectExpr(f"id * {factor} as id"), params={"factor": factor}),
        step("c", ("b",), lambda d: d.selectExpr("sign(id) as id"), version=version),
        step("d", ("c", "a"), lambda c, a: c.crossJoin(a.agg(F.count("*").alias("n")))),
        step("e", ("d",), lambda d: d.agg(F.sum("id").alias("s"), F.max("n").alias("n"))),
    ]


def test_only_what_is_not_done_runs_again(spark, tmp_path):
    root, src, log = str(tmp_path), {"src": spark.range(1, 11)}, []
    with pytest.raises(RuntimeError):
        run_steps(spark, root, src, chain(log, fail="c"))
    assert log == ["a", "b", "c"]
    out = run_steps(spark, root, src, chain(log := []))
    assert out.ran == log == ["c", "d", "e"] and tuple(out.tables["e"].first()) == (5.0, 5)
    assert run_steps(spark, root, src, chain([])).ran == []
    assert run_steps(spark, root, src, chain([], version="2")).ran == ["c"]  # its result is the same
    assert run_steps(spark, root, src, chain([], factor=3)).ran == ["b", "c"]  # the signs are the same
    assert run_steps(spark, root, {"src": spark.range(1, 13)}, chain([])).ran == ["a", "b", "c", "d", "e"]
    name, _ = files.listed(spark, place := next(str(p)[:-5] for p in (tmp_path / "d").glob("*.json")))[0]
    files.remove(spark, f"{place}/{name}")
    damaged = run_steps(spark, root, src, chain([])).ran + run_steps(spark, root, {"src": spark.range(1, 13)}, chain([])).ran
    assert damaged == ["d"]


def test_one_late_hour_rewrites_one_partition(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(0, 5 * 3_600_000, 400_000).selectExpr("id % 2 as session_id", "id as time_ms", "id as seq", "100 + id % 7 as bid", "110 + id % 5 as ask")
    late = "time_ms between 7200000 and 8000000"
    assert caches.refresh(rows.filter(f"not ({late})"), path) == 5
    before = {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "mids").glob("*/*.parquet")}
    assert caches.refresh(rows, path) == 1
    after = {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "mids").glob("*/*.parquet")}
    assert {h for h in after if after[h] != before.get(h)} == {"hour_ms=7200000"}
    want = caches.second_mids(rows).select("session_id", "second_ms", "mid")
    assert caches.read(spark, path).exceptAll(want).count() == want.exceptAll(caches.read(spark, path)).count() == 0
    assert caches.refresh(rows, path) == 0
    assert caches.refresh(rows.filter("time_ms < 14400000"), path) == 1
    assert caches.read(spark, path).filter("second_ms >= 14400000").count() == 0
