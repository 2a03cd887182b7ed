"""Quantiles against numpy, and bootstraps against one sequential run of the seeded generator."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tidebook.operators import resampling as R
from tidebook.operators import selection as Q
from tidebook.operators import stats as T

#: The first draws of ``random.Random(7).randrange(10)``.
FIRST = [5, 2, 6, 0, 1, 8, 1, 5]


def test_first_draws_are_fixed():
    rng = random.Random(7)
    assert R.draws(R._generator(None, 7), 10, 8).tolist() == FIRST == [rng.randrange(10) for _ in range(8)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 70_000])
def test_blocks_replay_one_sequential_run(n):
    rng = random.Random(11)
    want = [rng.randrange(n) for _ in range(40 * n if n < 5000 else 3 * n)]
    iterations = len(want) // n
    got = []
    for _, _, some, state in R.block_starts(n, iterations, 11, size=5 * n):
        got += R.draws(R._generator(state, 11), n, some * n).tolist()
    assert got == want


def percentile(values, q):
    v = sorted(values)
    place = q * (len(v) - 1)
    lo = int(place)
    return v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (place - lo)


def test_bootstrap_equals_a_sequential_run(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, w, rng.gauss(0, 1) if rng.random() < 0.9 else None) for k, n in (("a", 31), ("b", 31), ("c", 5), ("d", 1), ("e", 2)) for w in range(n)]
    rows += [("none", 0, None)]
    got = {r["k"]: tuple(r)[1:] for r in T.bootstrap_mean(spark.createDataFrame(rows, "k string, w int, v double").repartition(4), "v", ["k"], ["w"], 700).collect()}
    by = defaultdict(list)
    for k, _, v in rows:
        by[k] += [v] if v is not None else []
    for k, vs in by.items():
        n, mean, low, high = got[k]
        assert n == len(vs)
        if not vs:
            assert (mean, low, high) == (None, None, None)
            continue
        gen = random.Random(7)
        means = [sum(vs[gen.randrange(n)] for _ in range(n)) / n for _ in range(700)] if n > 1 else [sum(vs) / n]
        assert (mean, low, high) == pytest.approx((sum(vs) / n, percentile(means, 0.025), percentile(means, 0.975)), abs=1e-12)


@pytest.mark.parametrize("rare", [False, True])
def test_contrast_equals_a_sequential_run(spark, rare):
    rng = random.Random(3)
    rows = [(c, "low" if (c == 0 if rare else rng.random() < 0.5) else "high", rng.gauss(0, 1)) for c in range(12) for _ in range(4)]
    got = T.cluster_contrast(spark.createDataFrame(rows, "c int, g string, v double"), "c", "g", "v", "low", "high", 400).first()
    sums = [[sum(v for c, g, v in rows if (c, g) == (k, "low")), sum((c, g) == (k, "low") for c, g, _ in rows), sum(v for c, g, v in rows if (c, g) == (k, "high")), sum((c, g) == (k, "high") for c, g, _ in rows)] for k in range(12)]
    gen, stats, undefined = random.Random(7), [], 0
    for _ in range(400):
        a, na, b, nb = np.sum([sums[gen.randrange(12)] for _ in range(12)], axis=0)
        if na and nb:
            stats.append(b / nb - a / na)
        else:
            undefined += 1
    assert got["undefined_resamples"] == undefined and (undefined > 0) == rare
    assert got["status"] == ("inconclusive" if rare else "available")
    if not rare:
        assert (got["ci_low"], got["ci_high"]) == pytest.approx((percentile(stats, 0.025), percentile(stats, 0.975)), abs=1e-12)


def test_quantiles_of_all_groups(spark):
    rng = random.Random(4)
    rows = [(None if i % 7 == 0 else i % 3, rng.choice([0.0, 0.0, 0.0, None, float(rng.randrange(50)), -1.5])) for i in range(900)] + [(9, 4.0), (10, None)]
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {r["k"]: (r["n"], r["quantiles"]) for r in Q.exact_quantiles(spark.createDataFrame(rows, "k int, v double").repartition(5), "v", probs, ["k"]).collect()}
    by = defaultdict(list)
    for k, v in rows:
        by[k] += [v] if v is not None else []
    assert got.keys() == {k for k, v in by.items() if v}
    for k, (n, q) in got.items():
        assert n == len(by[k]) and q == pytest.approx(np.quantile(by[k], probs).tolist())
    whole = Q.exact_quantiles(spark.createDataFrame(rows, "k int, v double"), "v", [0.25]).collect()
    assert len(whole) == 1 and whole[0]["quantiles"] == pytest.approx([np.quantile([v for v in sum(by.values(), [])], 0.25)])
    assert Q.exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).count() == 0
