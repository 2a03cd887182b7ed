"""Bootstraps in many tasks, with the draws of one seeded generator.

Python's generator turns each 32-bit output into an index by its top bits and passes over those
that are too large, so where draw number k begins can't be computed. One quick pass per
sample size finds the generator's state at the start of every block of resamples; a block is
then a row (size, block, state), and each task replays its blocks. All draws equal those of
one run in sequence.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from random import Random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Draws of a block; a block is one resample at least.
BLOCK = 1 << 20
BLOCKS = "n long, block long, resamples long, state binary"


def _generator(state: bytes | None, seed: int) -> np.random.MT19937:
    """A generator that goes on from ``state``, or begins as ``random.Random(seed)`` does."""
    bits = np.random.MT19937()
    words = np.frombuffer(state, dtype="<u4") if state else np.array(Random(seed).getstate()[1], dtype=np.uint32)
    bits.state = {"bit_generator": "MT19937", "state": {"key": words[:-1].astype(np.uint64), "pos": int(words[-1])}}
    return bits


def _state(bits: np.random.MT19937) -> bytes:
    state = bits.state["state"]
    return np.append(np.asarray(state["key"], dtype="<u4"), np.uint32(state["pos"])).astype("<u4").tobytes()


def draws(bits: np.random.MT19937, n: int, count: int) -> np.ndarray:
    """The next ``count`` values of ``randrange(n)``; the generator stands behind the last one used."""
    shift = 32 - n.bit_length()
    out, have = np.empty(count, dtype=np.int64), 0
    while have < count:
        before = bits.state
        raw = bits.random_raw(max(16, int((count - have) * 1.05 * (1 << n.bit_length()) / n))) >> shift
        fits = np.flatnonzero(raw < n)[: count - have]
        out[have : have + len(fits)] = raw[fits]
        have += len(fits)
        if have == count:  # go back to just behind the last one
            bits.state = before
            bits.random_raw(int(fits[-1]) + 1)
    return out


def block_starts(n: int, iterations: int, seed: int, size: int = BLOCK) -> Iterator[tuple[int, int, int, bytes]]:
    """Rows of ``BLOCKS`` for samples of ``n``."""
    bits, each = _generator(None, seed), max(1, size // n)
    for block, at in enumerate(range(0, iterations, each)):
        some = min(each, iterations - at)
        yield n, block, some, _state(bits)
        draws(bits, n, some * n)


def resampled(samples: DataFrame, keys: Sequence[str], iterations: int, seed: int, statistic, size: int = BLOCK) -> DataFrame:
    """keys, stat: ``statistic`` of every resample. ``samples``: keys, n, data (an array of n values or rows, in order).

    ``statistic(data, picks)`` takes the sample's array and a matrix of indices, one resample a row; None is NaN.
    """
    spark = samples.sparkSession

    def starts(batches):
        import pandas as pd

        for b in batches:
            for n in b["n"]:
                for row in block_starts(int(n), iterations, seed, size):
                    yield pd.DataFrame([row], columns=["n", "block", "resamples", "state"])

    blocks = samples.select("n").filter("n > 0").distinct().mapInPandas(starts, BLOCKS)
    fields = [samples.schema[k] for k in keys]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "stat double"])

    def run(batches):
        import pandas as pd

        for b in batches:
            for row in b.to_dict("records"):
                n = int(row["n"])
                data = np.array([list(x) if not np.isscalar(x) else x for x in row["data"]], dtype=float)
                picks = draws(_generator(bytes(row["state"]), seed), n, int(row["resamples"]) * n).reshape(-1, n)
                yield pd.DataFrame({**{k: [row[k]] * len(picks) for k in keys}, "stat": statistic(data, picks)})

    parallel = spark.sparkContext.defaultParallelism
    todo = samples.join(blocks, "n").select(*keys, "n", "data", "resamples", "state", F.monotonically_increasing_id().alias("__no"))
    return todo.repartition(parallel, "__no").drop("__no").mapInPandas(run, out)
