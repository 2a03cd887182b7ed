"""Main-text extraction by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block is a vector: its hashed tag path
(elements with the words of their class, id and role), hashed words, and a few
proportions. A bidirectional LSTM in numpy reads the whole sequence and labels every
block as article or not, so that a block's neighbours on either side count.

The labeller is trained here, once per driver process, on synthetic pages whose layouts
come from a seeded generator (``training_page``); no page of the input is used. It is
sent to the executors (about 200 KB), which read pages of similar length in batches.

Defined results: null html is an empty page; a page without article blocks gives an
empty text; repeated rows give equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SLICE_ROWS, give_back, small_batches
from .html_blocks import Block, blocks_of

PATH_DIMS = 224
WORD_DIMS = 16
DIMS = PATH_DIMS + WORD_DIMS + 6
HIDDEN = 16
PAGES = 1600
EPOCHS = 6
SEED = 5
#: Blocks that are labelled at once, and whose vectors are held at once.
BLOCKS, STEP = 20_000, 2048


@lru_cache(maxsize=50_000)
def _bucket(name: str, dims: int) -> int:
    return crc32(name.encode("utf-8", "surrogatepass")) % dims


def features(blocks: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """Vectors of the page's blocks ``first`` to ``last`` (exclusive)."""
    last = len(blocks) if last is None else min(last, len(blocks))
    x = np.zeros((last - first, DIMS), dtype=np.float32)
    for i in range(first, last):
        b, row = blocks[i], x[i - first]
        for name in b.path:
            row[_bucket(name, PATH_DIMS)] = 1.0
        words = b.text.split()
        hashed = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.int64, count=len(words))
        row[PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.bincount(hashed % WORD_DIMS, minlength=WORD_DIMS) / len(words)
        ends = sum(w[-1] in ".!?" for w in words)
        row[-6:] = (np.log1p(len(b.text)) / 8, np.log1p(len(words)) / 6, b.linked, ends / len(words), i / len(blocks), 1.0)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one logistic output per block."""

    def __init__(self, dims: int = DIMS, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"W{d}"] = rng.normal(0, 0.15, (dims, 4 * hidden)).astype(np.float32)
            self.p[f"U{d}"] = rng.normal(0, 0.25, (hidden, 4 * hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, dtype=np.float32)
            bias[hidden : 2 * hidden] = 1.0  # remember at first
            self.p[f"c{d}"] = bias
        self.p["o"] = rng.normal(0, 0.3, 2 * hidden).astype(np.float32)
        self.p["z"] = np.zeros(1, dtype=np.float32)

    def _walk(self, d: str, pre: np.ndarray, mask: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States of direction ``d`` from what the inputs add to the gates; ``tape`` gets what the gradients need."""
        steps, batch, _ = pre.shape
        n = self.hidden
        h = np.zeros((batch, n), dtype=np.float32)
        c = np.zeros((batch, n), dtype=np.float32)
        out = np.zeros((steps, batch, n), dtype=np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = pre[t] + h @ self.p[f"U{d}"]
            gates = _sigmoid(a[:, : 3 * n])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            g = np.tanh(a[:, 3 * n :])
            m = mask[t][:, None]
            new_c = np.where(m, f * c + i * g, c)
            th = np.tanh(new_c)
            new_h = np.where(m, o * th, h)
            if tape is not None:
                tape.append((t, h, c, i, f, o, g, th, m))
            h, c = new_h, new_c
            out[t] = h
        return out

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        tape: list = []
        return self._walk(d, x @ self.p[f"W{d}"] + self.p[f"c{d}"], mask, tape), tape

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run("f", x, mask)[0], self._run("b", x, mask)[0]], axis=2)
        return _sigmoid(both @ self.p["o"] + self.p["z"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n = self.hidden
        runs = {d: self._run(d, x, mask) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        off = (_sigmoid(both @ self.p["o"] + self.p["z"]) - y) * mask / max(1, mask.sum())
        grads = {"o": np.einsum("tb,tbh->h", off, both), "z": np.array([off.sum()], dtype=np.float32)}
        for d, part in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
            direct = off[:, :, None] * self.p["o"][part]
            pre = np.zeros((x.shape[0], x.shape[1], 4 * n), dtype=np.float32)
            grads[f"U{d}"] = np.zeros_like(self.p[f"U{d}"])
            dh = np.zeros((x.shape[1], n), dtype=np.float32)
            dc = np.zeros((x.shape[1], n), dtype=np.float32)
            for t, h, c, i, f, o, g, th, m in reversed(runs[d][1]):
                dh = dh + direct[t]
                on = m.astype(np.float32)
                do = dh * th * on
                dcell = dc + dh * o * (1 - th * th) * on
                a = np.concatenate(
                    [dcell * g * i * (1 - i), dcell * c * f * (1 - f), do * o * (1 - o), dcell * i * (1 - g * g)], axis=1
                ) * on
                pre[t] = a
                grads[f"U{d}"] += h.T @ a
                dh = np.where(m, a @ self.p[f"U{d}"].T, dh)
                dc = np.where(m, dcell * f, dc)
            grads[f"W{d}"] = np.tensordot(x, pre, axes=([0, 1], [0, 1]))
            grads[f"c{d}"] = pre.sum(axis=(0, 1))
        return grads

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What the vectors of blocks add to the gates of both directions."""
        return np.concatenate([x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"], axis=1)

    def label(self, pages: list[np.ndarray], batch: int = 128) -> list[np.ndarray]:
        """Which blocks of each page (its ``gates``) are article."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        n = self.hidden
        while order:
            longest = len(pages[order[-1]])
            take = max(1, min(batch, 50_000 // longest, len(order)))
            some, order = order[-take:], order[:-take]
            pre, mask = padded([pages[i] for i in some])
            score = np.zeros(mask.shape, dtype=np.float32)
            for k, d in enumerate("fb"):
                score += self._walk(d, pre[:, :, 4 * n * k : 4 * n * (k + 1)], mask) @ self.p["o"][n * k : n * (k + 1)]
            for b, i in enumerate(some):
                out[i] = score[: len(pages[i]), b] + self.p["z"] >= 0
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), pages[0].shape[1]), dtype=np.float32)
    mask = np.zeros((steps, len(pages)), dtype=bool)
    for b, p in enumerate(pages):
        x[: len(p), b], mask[: len(p), b] = p, True
    return x, mask


#: Names that pages give to their parts.
CLUTTER = {
    "menu": ("nav|div|ul", "nav navbar menu navigation breadcrumb breadcrumbs topnav links toc"),
    "header": ("header|div", "header masthead banner site top branding logo"),
    "footer": ("footer|div", "footer site bottom copyright legal colophon"),
    "sidebar": ("aside|div|section", "sidebar aside widget related popular recommended trending tags share social"),
    "notice": ("div|section|p", "notice cookie consent alert gdpr privacy warning message popup modal overlay"),
    "advert": ("div|aside|ins", "ad ads advert advertisement sponsored promo promotion banner"),
    "form": ("form|div", "form newsletter signup subscribe search login contact"),
    "comments": ("section|div|ol", "comments comment replies discussion responses thread respond"),
}
ARTICLE = ("article|main|div|section|td", "article content post entry main story body text")


def training_page(rng: random.Random) -> list[tuple[str, int]]:
    """HTML pieces of a made-up page with their labels; label 1 is article text."""
    syllables = ["".join(rng.choice("aeiouäéñ" if i % 2 else "bcdfglmnprstv") for i in range(rng.randint(2, 4))) for _ in range(40)]

    def words(low: int, high: int) -> str:
        n = rng.randint(low, high)
        noise = rng.choice(["", "", "", "!!", "***", "%%%", " |"])
        ws = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) + noise for _ in range(n)]
        return (" ".join(ws).capitalize() if rng.random() < 0.9 else " ".join(ws).upper()) + rng.choice([".", ".", "", "?"])

    def opened(kind: tuple[str, str], plain: float) -> tuple[str, str]:
        tag = rng.choice(kind[0].split("|"))
        names = kind[1].split()
        bare = tag in ("nav", "header", "footer", "aside", "form", "article", "main") and rng.random() < plain
        key = rng.choice(["class", "class", "id"])
        value = rng.choice(names) + (rng.choice(["", "-" + rng.choice(names), " " + rng.choice(names), "-wrap", "-box"]))
        return (f"<{tag}>" if bare else f'<{tag} {key}="{value}">'), f"</{tag}>"

    out: list[tuple[str, int]] = []

    def clutter(kind: str) -> None:
        a, b = opened(CLUTTER[kind], 0.6)
        out.append((a, 0))
        if kind in ("menu", "footer", "sidebar", "header") and rng.random() < 0.7:
            if rng.random() < 0.3:
                out.append((f"<h3>{words(1, 3)}</h3>", 0))
            link = [f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(rng.randint(1, 8))]
            out.append(("<ul>", 0))
            out.extend((x, 0) for x in link)
            out.append(("</ul>", 0))
        if kind == "form":
            out.append((f"<label>{words(1, 4)}</label><input type=text>", 0))
            out.append((f"<button>{words(1, 2)}</button>", 0))
            if rng.random() < 0.3:
                out.append((f"<select><option>{words(1, 2)}<option>{words(1, 2)}</select>", 0))
        if kind == "comments":
            for _ in range(rng.randint(1, 5)):
                out.append((rng.choice([f'<div class="comment"><p>{words(3, 60)}</p></div>', f"<li><p>{words(3, 60)}</p></li>"]), 0))
        if kind in ("notice", "advert", "footer", "header", "sidebar") and rng.random() < 0.85:
            text = rng.choice(["", "&copy; "]) * (kind == "footer") + words(2, 40)
            out.append((rng.choice([text, f"<p>{text}</p>", f"<div>{text}</div>"]), 0))
        out.append((b, 0))

    def article() -> None:
        a, b = opened(ARTICLE, 0.7)
        out.append((a, 1))
        inner = rng.random() < 0.25
        if inner:
            out.append((f'<div class="{rng.choice("entry content post body text story".split())}">', 1))
        if rng.random() < 0.8:
            out.append((f"<h1>{words(2, 12)}</h1>", 1))
        for _ in range(rng.randint(1, 12)):
            r = rng.random()
            text = words(1, 8) if rng.random() < 0.25 else words(8, 120)
            if r < 0.68:
                out.append((rng.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p><a href=x>{words(1, 3)}</a> {text}</p>"]), 1))
            elif r < 0.74:
                out.append((f"<h{rng.randint(2, 4)}>{words(1, 7)}</h2>", 1))
            elif r < 0.8:
                out.extend((x, 1) for x in ["<ul>", *[f"<li>{words(2, 20)}</li>" for _ in range(rng.randint(2, 5))], "</ul>"])
            elif r < 0.84:
                out.append((f"<blockquote>{text}</blockquote>", 1))
            elif r < 0.87:
                out.append((f"<pre>{text}</pre>", 1))
            elif r < 0.9:
                out.append((f"<table><tr><td>{words(1, 5)}<td>{words(1, 5)}</table>", 1))
            elif r < 0.92:
                out.append((f"<figure><img src=x><figcaption>{words(2, 12)}</figcaption></figure>", 1))
            else:
                clutter(rng.choice(["advert", "sidebar", "form", "notice", "advert"]))
        if inner:
            out.append(("</div>", 1))
        if rng.random() < 0.15:
            clutter("comments")
        out.append((b, 1))

    out.append((f"<html><head><title>{words(2, 10)}</title></head><body>", 0))
    wrapped = rng.random() < 0.3
    if wrapped:
        out.append((f'<div {rng.choice(["class", "id"])}="{rng.choice("page wrapper container layout site row".split())}">', 0))
    for kind in rng.sample(["header", "menu", "notice", "advert", "form", "sidebar"], rng.randint(0, 4)):
        clutter(kind)
    if rng.random() < 0.97:
        article()
    for kind in rng.sample(["comments", "sidebar", "advert", "form", "notice", "menu"], rng.randint(0, 3)):
        clutter(kind)
    if rng.random() < 0.85:
        clutter("footer")
    out.append((("</div>" if wrapped else "") + "</body></html>", 0))
    return out


def labelled_blocks(pieces: list[tuple[str, int]]) -> tuple[list[Block], np.ndarray]:
    """Blocks of the page with their labels; marks in the text carry these through the parser."""
    marks = {"\ue000": 0, "\ue001": 1}
    source = []
    for piece, label in pieces:
        mark = "\ue001" if label else "\ue000"
        # a mark before each run of text
        source.append("".join(mark + part if part and not part.startswith("<") else part for part in re.split(r"(<[^>]*>)", piece)))
    blocks = blocks_of("".join(source))
    labels = np.array([marks[next(c for c in b.text if c in marks)] for b in blocks], dtype=np.float32)
    for b in blocks:
        b.text = re.sub("\\s*[\ue000\ue001]", "", b.text).strip() or "-"
    return blocks, labels


@lru_cache(maxsize=1)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The labeller after ``epochs`` of Adam over made-up pages; the same in every process."""
    rng = random.Random(seed)
    made = []
    for _ in range(pages):
        blocks, labels = labelled_blocks(training_page(rng))
        if blocks:
            made.append((features(blocks), labels))
    net = Labeller(seed=seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    size = 32
    for epoch in range(epochs):
        made.sort(key=lambda m: len(m[0]) + rng.random() * 6)
        batches = [made[i : i + size] for i in range(0, len(made), size)]
        rng.shuffle(batches)
        rate = 0.012 * (1 - epoch / epochs) + 0.001
        for some in batches:
            x, mask = padded([f for f, _ in some])
            y = np.zeros(mask.shape, dtype=np.float32)
            for b, (_, labels) in enumerate(some):
                y[: len(labels), b] = labels
            grads = net.gradients(x, mask, y)
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
            step += 1
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(1e-9, norm))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def read_pages(net: Labeller, pages: list[str]) -> Iterator[tuple[str, int]]:
    """(text, number of blocks) of each page. ``BLOCKS`` blocks or one page are labelled at once, and vectors are never held for more than ``STEP`` blocks."""
    held: list[list[Block]] = []
    inputs: list[np.ndarray] = []

    def done() -> Iterator[tuple[str, int]]:
        for blocks, ok in zip(held, net.label(inputs)):
            yield " ".join(b.text for b, x in zip(blocks, ok) if x), len(blocks)
        held.clear()
        inputs.clear()

    for page in pages:
        blocks = blocks_of(page)
        held.append(blocks)
        parts = [net.gates(features(blocks, at, at + STEP)) for at in range(0, len(blocks), STEP)]
        inputs.append(np.concatenate(parts) if parts else np.zeros((0, 8 * net.hidden), dtype=np.float32))
        if sum(map(len, held)) >= BLOCKS:
            yield from done()
    yield from done()


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """row (the columns of ``pages`` without the html as a struct), text (the article) and n_blocks. Python sees the html alone."""
    keep = [c for c in pages.columns if c != html_col]
    sent = pages.sparkSession.sparkContext.broadcast(trained())

    def read(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = sent.value
        for column in columns:
            found = [x for at in range(0, len(column), SLICE_ROWS) for x in read_pages(net, [h or "" for h in column.slice(at, SLICE_ROWS).to_pylist()])]
            yield pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int32())], ["text", "n_blocks"])
        give_back()

    small_batches(pages.sparkSession)
    read = F.arrow_udf("text string, n_blocks int")(read)
    found = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), read(F.col(f"`{html_col}`")).alias("x"))
    return found.select("row", "x.text", "x.n_blocks")
