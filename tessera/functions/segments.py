"""Splitting one text in Python: sentences, separators, merging, and fitting to a number of tokens."""

from __future__ import annotations

import re

from tessera.functions.text import CHARS_PER_TOKEN

_TITLES = frozenset("mr mrs ms dr prof jr sr st mt ave blvd co corp inc ltd al ca etc vs".split())
_LATIN = ("cf", "viz", "e.g", "i.e")
_ENDS = re.compile(r"[.?!]+")
_SEEN = re.compile(r"[^ \t]")


def _goes_on(sentence: str, rest: str) -> bool:
    """Whether a single full stop at the end of sentence does not end it; rest is the character that follows."""
    if not sentence.endswith(".") or sentence.endswith(".."):
        return False
    word = next(iter(reversed(sentence.rstrip(".,").split(" "))), "").rstrip(",;")
    low = word.lower()
    if low in _TITLES or any(low.startswith(x) for x in _LATIN if low):
        return True
    if len(word) == 1 and (word.isupper() or any(x.startswith(low + ".") and rest.lower().startswith(x[2:]) for x in _LATIN)):
        return True
    return sentence[-2:-1].isnumeric() and rest[:1].isnumeric()


def sentences(text: str) -> list[str]:
    """Sentences by . ? and !, but for abbreviations, initials and decimals."""
    text, out, start, at = text.strip(), [], 0, 0
    while m := _ENDS.search(text, at):
        at = m.end()
        follows = _SEEN.search(text, at)  # not all of the rest, which would make long texts quadratic
        rest = follows.group() if follows else ""
        if rest and _goes_on(text[start:at], rest):
            continue
        if part := text[start:at].strip(" \t"):
            out.append(part)
        while at < len(text) and text[at].isspace():
            at += 1
        start = at
    if part := text[start:].strip(" \t"):
        out.append(part)
    return out


def paragraphs(text: str) -> list[str]:
    lines = text.strip().replace("\r\n", "\n").replace("\r", "\n")
    return [p for p in map(str.strip, re.split(r"\n\s*\n+", lines)) if p]


def by_separators(text: str, separators: list[str]) -> list[str]:
    """Parts by the first separator that gives more than one that is not empty; else the whole."""
    if not (text := text.strip()):
        return []
    for s in filter(None, separators):
        pieces = text.split(s)
        parts = [p for p in (x.strip(" \t") for x in pieces) if p]
        if len(parts) > 1:
            return parts
        if len(pieces) > 1 and not parts:
            return []
    return [text]


def merge_small(parts: list[str], min_length: int, separator: str = " ") -> list[str]:
    """Neighbours joined until each has min_length; what is left over goes to the last."""
    if min_length <= 0:
        return list(parts)
    out, held = [], ""
    for p in parts:
        held = f"{held}{separator}{p}" if held else p
        if len(held) >= min_length:
            out.append(held)
            held = ""
    if held:
        out[-1:] = [f"{out[-1]}{separator}{held}"] if out else [held]
    return out


def pieces(text: str, size: int) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def token_count(text: str, model: str = "simple") -> int:
    return max(1, int(len(text) / CHARS_PER_TOKEN[model])) if text else 0


def split_to_fit(text: str, max_tokens: int, overlap: int = 0, model: str = "simple") -> list[str]:
    """Runs of words of at most max_tokens each; with an overlap, windows of characters moved to word limits."""
    if not text or max_tokens <= 0:
        return []
    if token_count(text, model) <= max_tokens:
        return [text]
    overlap, rate = max(0, min(overlap, max_tokens - 1)), CHARS_PER_TOKEN[model]
    most = int(max_tokens * rate)
    if overlap:
        return _windows(text, most, int((max_tokens - overlap) * rate))
    out, held = [], ""
    for word in text.split(" "):
        longer = f"{held} {word}" if held else word
        if token_count(longer, model) <= max_tokens:
            held = longer
            continue
        if held:
            out.append(held.strip(" \t"))
        held = word
        if token_count(word, model) > max_tokens:
            *full, held = pieces(word, most)
            out += full
    return out + [held.strip(" \t")] if held.strip(" \t") else out


def _windows(text: str, size: int, stride: int) -> list[str]:
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text) and (space := text.rfind(" ", max(start, end - 20), end)) >= 0:
            end = space
        if part := text[start:end].strip(" \t"):
            out.append(part)
        to = start + stride
        if to >= len(text):
            break
        if text[to] == " ":
            nxt = to + 1
        else:
            space = text.rfind(" ", start, to)
            nxt = space + 1 if space >= 0 else to
        # a word longer than the stride would hold the window in place
        start = nxt if nxt > start else to
    return out
