"""From HTML to the sequence of its text blocks, with the tag path that leads to each."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements that don't end a block, that have no content, and whose content isn't text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style"
#: An open element ends where one of these begins.
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<svg\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?</svg\s*>"
    rf"|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*>|<[!?/][^>]*>",
    re.S | re.I,
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Za-z]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: float


def _names(tag: str, more: str) -> tuple[str, ...]:
    found = [tag]
    if more and "=" in more:
        for key, *values in NAMES.findall(more):
            for part in PARTS.findall("".join(values)):
                found.append(f"{key[0].lower()}.{part.lower()}")
    return tuple(found)


def blocks_of(page: str) -> list[Block]:
    """Non-empty blocks in page order: references decoded, white space single, trimmed."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    in_link = linked = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            total = sum(len(p) for p in parts)
            out.append(Block(text, tuple(n for _, names in stack for n in names), min(1.0, linked / max(1, total))))
        parts.clear()
        linked = 0

    for m in MARKUP.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = 0 if m["end"] else 1
        if tag in INLINE:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        flush()
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        else:
            while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                stack.pop()
            if tag not in VOID and not m["more"].endswith("/"):
                stack.append((tag, _names(tag, m["more"])))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out
