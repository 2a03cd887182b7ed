"""Language ID by nearest centroid.

A text is lower-cased, everything but letters becomes a word boundary, and its
character 1- to 4-grams are hashed into ``DIMS`` buckets. Vectors are log-scaled counts
times inverse document frequency, of unit length. Each language has up to
``CENTROIDS`` centroids, found by seeded spherical k-means on its training texts;
a text gets the language of the centroid with the greatest cosine. It is rejected
if its distance is far beyond what training texts of this language and of about its
length show to centroids that were fitted without them, or if it has no letter.

The model is fitted on a bounded sample: at most ``SAMPLE`` labelled rows of each
language (all, if fewer), chosen by a hash of the id; a language's sample is cut at
the power of two of the hash that keeps it within the bound. The driver fits on
hashed vectors of these rows alone. Everything is predicted.

Defined results: null text, or one without letters, is ``und`` with score 0; equal
cosines go to the first language in code-point order; a row without an id counts
as held out; without training rows every text is ``und``; repeated rows get equal
predictions; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SLICE_ROWS, give_back, in_arrow, packed, small_batches

DIMS = 1 << 13
GRAMS = (1, 2, 3, 4)
SAMPLE = 384
CENTROIDS = 4
UNKNOWN = "und"
SEED = 17
#: A text is rejected below this share of a low quantile of the cosines of training texts of its language and about its length.
SLACK = 0.5
QUANTILE = 0.1
#: With fewer such texts, those of all languages count.
ENOUGH = 8
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(buckets, counts, letters) of a whole text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    letter = _letters()[points]
    n = int(letter.sum())
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0), 0
    c = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one boundary after each word
    c = np.concatenate([np.array([32], dtype=np.uint32), c[keep], np.array([32], dtype=np.uint32)])
    total = np.zeros(DIMS, dtype=np.int64)
    h = c * _MIX[0]
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    for g in GRAMS:
        if g > 1:
            if len(c) < g:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MIX[1] + c[g - 1 :] * _MIX[2]
        total += np.bincount((h * _MIX[0]) >> shift, minlength=DIMS)
    at = np.flatnonzero(total)
    return at, total[at].astype(np.float64), n


def _vector(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1.0 + np.log(counts)) * idf[at]
    return w / max(1e-12, float(np.sqrt(w @ w)))


def held_out(id_col: str, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """lang, text of at most ``sample`` labelled rows per language that aren't held out."""
    ranked = F.xxhash64(F.col(id_col).cast("string"), F.lit(SEED))
    # zeros: trailing zero bits of the hash, so half of the rows has one more than any number of them
    zeros = F.length(F.regexp_extract(F.bin(F.bitwise_not(ranked)), "1*$", 0))
    usable = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), zeros.alias("zeros")
    )
    seen: dict[str, dict[int, int]] = defaultdict(dict)
    for lang, z, n in usable.groupBy("lang", "zeros").count().collect():
        seen[lang][z] = n
    rule = {}
    for lang, by in seen.items():
        least, total = 65, 0
        for z in sorted(by, reverse=True):
            total += by[z]
            if total > sample:
                break
            least = z
        rule[lang] = least
    if not rule:
        return usable.limit(0).select("lang", "text")
    rules = docs.sparkSession.createDataFrame(sorted(rule.items()), "of string, least int")
    # one row per language, of which the model holds centroids
    return usable.join(F.broadcast(rules), (F.col("lang") == F.col("of")) & (F.col("zeros") >= F.col("least"))).select("lang", "text")


class Model:
    """Languages, their centroids, inverse document frequencies and least cosines by language and length."""

    def __init__(self, samples: list[tuple[str, np.ndarray, np.ndarray, int]], centroids: int = CENTROIDS):
        samples = [s for s in samples if s[3]]
        df = np.zeros(DIMS)
        for _, at, _, _ in samples:
            df[at] += 1
        self.idf = np.log((1.0 + len(samples)) / (1.0 + df)) + 1.0
        self.langs: list[str] = []
        rows = []
        of = defaultdict(list)
        for lang, at, counts, n in samples:
            of[lang].append((at, counts, n))
        seen: dict[str, dict[int, list[float]]] = {}
        for lang in sorted(of):  # one language's dense vectors at a time
            dense = np.zeros((len(of[lang]), DIMS), dtype=np.float32)
            for row, (at, counts, _) in zip(dense, of[lang]):
                row[at] = _vector(at, counts, self.idf)
            for c in _cluster(dense, centroids):
                self.langs.append(lang)
                rows.append(c.astype(np.float64))
            seen[lang] = defaultdict(list)
            for half in (0, 1) if len(dense) > 1 else ():
                others = _cluster(dense[1 - half :: 2], centroids)
                for cos, (_, _, n) in zip((dense[half::2] @ others.T).max(axis=1), of[lang][half::2]):
                    seen[lang][n.bit_length()].append(float(cos))
            del dense
        self.rows = np.stack(rows, axis=1) if rows else np.zeros((DIMS, 0))
        self.least = _least(seen)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        at, counts, n = grams(text or "")
        if not n or not self.langs:
            return UNKNOWN, 0.0, True
        cos = _vector(at, counts, self.idf) @ self.rows[at]
        i = int(cos.argmax())
        score = float(min(1.0, max(0.0, cos[i])))
        return self.langs[i], score, score < self.least[self.langs[i]][min(32, n.bit_length())]


def _least(seen: dict[str, dict[int, list[float]]]) -> dict[str, np.ndarray]:
    """The least cosines by language and length class; a class without enough texts of any language has those of the nearest that has."""

    def around(b: int, langs: list[str]) -> list[float]:
        return [c for lang in langs for near in (b - 1, b, b + 1) for c in seen[lang].get(near, ())]

    many = [len(around(b, list(seen))) for b in range(33)]
    filled = [b for b in range(33) if many[b] >= min(ENOUGH, max(many)) > 0]
    least = {lang: np.zeros(33) for lang in seen}
    for lang in seen:
        for b in range(33) if filled else ():
            near = min(filled, key=lambda x: (abs(x - b), x))
            own = around(near, [lang])
            least[lang][b] = SLACK * np.quantile(own if len(own) >= ENOUGH else around(near, list(seen)), QUANTILE)
    return least


def _cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, seeded by the vectors farthest from those chosen so far."""
    mean = vectors.mean(axis=0)
    chosen = [int((vectors @ mean).argmax())]
    while len(chosen) < min(k, len(vectors)):
        near = (vectors @ vectors[chosen].T).max(axis=1)
        chosen.append(int(near.argmin()))
    centers = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centers.T).argmax(axis=1)
        centers = np.stack([vectors[own == i].mean(axis=0) if (own == i).any() else centers[i] for i in range(len(centers))])
        centers /= np.maximum(1e-12, np.linalg.norm(centers, axis=1, keepdims=True))
    return centers


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    rows = training_rows(docs, id_col, text_col, lang_col, sample)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0].astype("<i2").tobytes() for f in found], pa.binary()),
                    pa.array([f[1].astype("<f4").tobytes() for f in found], pa.binary()),
                    pa.array([f[2] for f in found], pa.int64()),
                ],
                ["lang", "at", "counts", "n"],
            )

    got = in_arrow(rows, vectors, "lang string, at binary, counts binary, n long").collect()
    samples = [(r[0], np.frombuffer(r[1], "<i2"), np.frombuffer(r[2], "<f4"), r[3]) for r in got]
    samples.sort(key=lambda s: (s[0], s[3], s[1].tobytes(), s[2].tobytes()))
    return Model(samples)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """row (the columns of ``docs`` as a struct), lang, score and rejected of every row. Python sees the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = (("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()))

    def label(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        for all_texts in texts:
            found = [own.predict(t) for at in range(0, len(all_texts), SLICE_ROWS) for t in all_texts.slice(at, SLICE_ROWS).to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(kinds)], [k for k, _ in kinds])
        give_back()

    small_batches(docs.sparkSession)
    label = F.arrow_udf("lang string, score double, rejected boolean")(label)
    found = docs.select(packed(docs).alias("row"), label(F.col(f"`{text_col}`")).alias("p"))
    return found.select("row", "p.lang", "p.score", "p.rejected")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row. Only the text counts in a prediction."""
    model = fit(docs, id_col, text_col, lang_col, sample)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held_out(id_col).alias("held_out"))
    return predict(rows, model, "text").select("row.doc_id", "row.held_out", F.col("lang").alias("lang_pred"), "score", "rejected")
