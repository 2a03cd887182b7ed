"""Fast exact ids of a public word-level BPE vocabulary.

The ``tokenizers`` library defines the result. As that vocabulary lower-cases,
drops white space and never merges across it, the ids of a text are those of
its white-space-separated chunks, one after the other. So each distinct chunk is
encoded once per worker and looked up from then on. New chunks are encoded
together by a ``tiktoken`` engine built from the same file's merges (a merge's
rank is its id, the end of a word is one marker byte). Whatever is outside the
plain range (characters from U+0250 on, control characters that libraries split
differently, special-token strings) goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cached_property, lru_cache

import numpy as np

#: Fixed value: the vocabulary file's own pre-tokenizer pattern.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for ASCII, which the standard library cuts faster.
ASCII_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+"
END = "</w>"
#: Texts with these are encoded whole by ``tokenizers``; ``SPECIAL`` is only looked for after its first two characters.
WHOLE = re.compile("[\x00\x1c-\x1f\x85Σ]")
SPECIAL = re.compile("<\\|(?:startoftext|endoftext)\\|>")
RARE = re.compile("[^\x01-ɏ]")
MAX_CHUNKS = 100_000
#: Characters that are handled at once.
BATCH_CHARS = 400_000


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    def __init__(self, path: str):
        import regex
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of, vocab = _byte_of(), model["vocab"]

        def raw(token: str) -> bytes:
            body, end = (token[: -len(END)], b"\0") if token.endswith(END) else (token, b"")
            return bytes(byte_of[c] for c in body) + end

        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        made = set(merged)
        alone = [t for t in vocab if t not in made]
        # a character that ends a word is one symbol: those pairs merge first
        tokens = sorted(alone, key=lambda t: (not t.endswith(END), vocab[t])) + merged
        ranks: dict[bytes, int] = {}
        for t in tokens:
            ranks.setdefault(raw(t), len(ranks))
        if len(ranks) != len(tokens):
            raise ValueError(f"{path} isn't a word-level BPE vocabulary")
        self.engine = tiktoken.Encoding("word_bpe", pat_str="[^\\x00]*\\x00", mergeable_ranks=ranks, special_tokens={})
        self.id_of = np.array([vocab[t] for t in tokens], dtype=np.uint32)
        self.ends = np.array([t.endswith(END) for t in tokens])
        self.words = regex.compile(PRE_TOKENS + "| ").findall
        self.ascii_words = re.compile(ASCII_TOKENS + "| ").findall
        self.forget()

    @cached_property
    def whole(self):
        """The library's own tokenizer, loaded for the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        """Empty the table of chunks and let the library's tokenizer go; a worker that waits for other tasks needn't hold them."""
        self.__dict__.pop("whole", None)
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.start = np.zeros(1024, dtype=np.int64)
        self.count = np.zeros(1024, dtype=np.int64)
        self.uses = np.zeros(1024, dtype=np.int64)
        self.flat = np.zeros(4096, dtype=np.uint32)
        self.used = 0

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunks at ``at`` one after the other, where each ends)."""
        count = self.count[at]
        ends = np.cumsum(count)
        n = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(n) + np.repeat(self.start[at] - (ends - count), count)], ends

    def _make_room(self) -> None:
        """A full table keeps the half that was used most; most chunks of a text occur nowhere else."""
        chunks, uses = list(self.at), self.uses[: len(self.at)]
        keep = np.argsort(-uses, kind="stable")[: MAX_CHUNKS // 2]
        keep = keep[uses[keep] > 1]
        ids = self._ids(keep)[0]
        kept, counts, uses = [chunks[i] for i in keep.tolist()], self.count[keep], uses[keep]
        self._clear()
        if kept:
            self._add(kept, counts, ids)
            self.uses[: len(kept)] = uses // 2

    def _add(self, chunks: list[str], counts: np.ndarray, ids: np.ndarray) -> None:
        n, m = len(self.at), len(chunks)
        while n + m > len(self.start):
            self.start, self.count, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.uses))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.start[n : n + m] = self.used + np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.count[n : n + m] = counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.at.update(zip(chunks, range(n, n + m)))

    def _learn(self, chunks: list[str]) -> None:
        plain = [c for c in chunks if c.isascii()]  # without NUL, for which a text is encoded whole
        self._learn_plain(plain, self.ascii_words)
        if len(plain) == len(chunks):
            return
        others = [c for c in chunks if not c.isascii()]
        self._learn_plain([c for c in others if not RARE.search(c)], self.words)
        for c in others:
            if RARE.search(c):
                ids = self.whole.encode(c, add_special_tokens=False).ids
                self._add([c], np.array([len(ids)]), np.array(ids, dtype=np.uint32))

    def _learn_plain(self, plain: list[str], words) -> None:
        if plain:
            # no word crosses white space, so all chunks are cut at once; the blanks between them tell which is whose
            cut = "\0".join(words(" ".join(plain))) + "\0"
            ranks = np.asarray(self.engine.encode_ordinary(cut.replace(" \0", "")), dtype=np.int64)
            raw = np.frombuffer(cut.encode(), dtype=np.uint8)
            ends = np.flatnonzero(raw == 0)
            blanks = np.flatnonzero(raw == 32)
            upto = np.append(np.searchsorted(ends, blanks) - np.arange(len(blanks)), len(ends) - len(blanks))
            last = np.flatnonzero(self.ends[ranks])[upto - 1]  # the last id of each chunk
            self._add(plain, np.diff(last, prepend=-1), self.id_of[ranks])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids (uint32) of each text."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(texts)
        some: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if WHOLE.search(t) or "<|" in t and SPECIAL.search(t):
                out[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
                continue
            some.append(i)
            size += len(t)
            if size >= BATCH_CHARS or i == len(texts) - 1:
                self._encode(texts, some, out)
                some, size = [], 0
        if some:
            self._encode(texts, some, out)
        return out

    def _encode(self, texts: list[str], some: list[int], out: list[np.ndarray]) -> None:
        if len(self.at) > MAX_CHUNKS:
            self._make_room()
        chunks = [unicodedata.normalize("NFC", texts[i]).lower().split() for i in some]
        flat = [c for cs in chunks for c in cs]
        if new := set(flat).difference(self.at):
            self._learn(list(new))
        at = np.fromiter(map(self.at.__getitem__, flat), dtype=np.int64, count=len(flat))
        self.uses[: len(self.at)] += np.bincount(at, minlength=len(self.at))
        ids, ends = self._ids(at)
        cut = np.concatenate([[0], ends])[np.cumsum([0, *map(len, chunks)])]
        for k, i in enumerate(some):
            out[i] = ids[cut[k] : cut[k + 1]]


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One encoder per worker and file."""
    return WordBpe(path)
