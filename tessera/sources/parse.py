"""Parsing of one file's bytes or text into content and metadata, in Python."""

from __future__ import annotations

import functools
import html.entities
import html.parser
import json
import re
from typing import Any

BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
EXCLUDED = tuple("aside footer header nav script style".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())


def encoding_of(data: bytes) -> str:
    for mark, name in BOMS:
        if data.startswith(mark):
            return name
    try:
        data.decode()
        return "utf-8"
    except UnicodeDecodeError:
        return "latin-1"


def decode(data: bytes) -> str:
    """By byte order mark, else UTF-8, else Latin-1; without the mark."""
    return data.decode(encoding_of(data), "replace").removeprefix("﻿")


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """Key and value lines between --- lines at the start, and the body, which is trimmed only if there are any."""
    lines = text.split("\n")
    lines = [line.rstrip("\r") for line in lines]
    if lines[0].strip() != "---":
        return {}, text
    end = next((i for i, line in enumerate(lines[1:], 1) if line.strip() == "---"), None)
    if end is None:
        return {}, text
    pairs = (line.split(":", 1) for line in lines[1:end] if ":" in line)
    found = {k.strip(): v.strip() for k, v in pairs}
    return {k: v for k, v in found.items() if k and v}, "\n".join(lines[end + 1 :]).strip()


@functools.cache
def _selector(text: str) -> tuple[str, str, tuple[str, ...]] | None:
    """Name, id and classes that a selector asks for; None if it asks for anything else."""
    m = re.fullmatch(r"(\w+)?(?:#([\w-]+))?((?:\.[\w-]+)*)", text)
    return (m[1] or "", m[2] or "", tuple(c for c in m[3].split(".") if c)) if m else None


def matches(selector: str, tag: str, attrs: dict[str, str | None]) -> bool:
    if (asked := _selector(selector)) is None:
        return False
    name, id_, classes = asked
    if name and name != tag or id_ and attrs.get("id") != id_:
        return False
    return not classes or set(classes) <= set((attrs.get("class") or "").split())


class _Page(html.parser.HTMLParser):
    """Open elements with whether each is excluded; how many of them are, and are a title, body or head, is counted."""

    def __init__(self, selectors: tuple[str, ...], excluded: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.selectors = selectors
        self.names = frozenset(e for e in excluded if (_selector(e) or ("", "", ()))[1:] == ("", ()))
        self.excluded = tuple(e for e in excluded if e not in self.names)
        self.title: list[str] = []
        self.meta: list[tuple[str | None, str | None, str]] = []
        self.open: list[tuple[str, bool]] = []
        self.within = {"title": 0, "body": 0, "head": 0}
        self.hidden = 0
        self.parts: dict[str, list[list[str]]] = {s: [] for s in selectors}
        self.live: list[tuple[int, list[str]]] = []
        self.body: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        if tag == "meta" and given.get("content"):
            self.meta.append((given.get("name"), given.get("property"), given["content"] or ""))
        self._gap(tag)
        if tag in _VOID:
            return
        out = tag in self.names or any(matches(s, tag, given) for s in self.excluded)
        self.open.append((tag, out))
        self.hidden += out
        if tag in self.within:
            self.within[tag] += 1
        if not self.hidden:
            for s in self.selectors:
                if matches(s, tag, given):
                    self.parts[s].append([])
                    self.live.append((len(self.open), self.parts[s][-1]))

    def handle_endtag(self, tag: str) -> None:
        self._gap(tag)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for name, out in self.open[i:]:
                    self.hidden -= out
                    if name in self.within:
                        self.within[name] -= 1
                del self.open[i:]
                self.live = [x for x in self.live if x[0] <= i]
                break

    def _gap(self, tag: str) -> None:
        if tag in _BLOCK:
            self.body.append(" ")
            for _, out in self.live:
                out.append(" ")

    def handle_data(self, data: str) -> None:
        if self.within["title"] and not self.within["body"]:
            self.title.append(data)
        elif not self.hidden and not self.within["head"]:
            self.body.append(data)
            for _, out in self.live:
                out.append(data)


def _plain(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")


def _closed(m: re.Match[str]) -> str:
    return m[0] if m[1] and (m[1][0] == "#" or m[1] in html.entities.html5) else "&amp;" + m[0][1:]


def page(text: str, selectors: tuple[str, ...] = (), excluded: tuple[str, ...] = EXCLUDED, unclosed: bool = True) -> tuple[str, dict[str, Any]]:
    """Content and metadata (title, author, custom) of an HTML page.

    unclosed: whether a character reference without its semicolon counts, as in browsers; if not, it stays as it is.
    """
    p = _Page(selectors, excluded)
    p.feed(text if unclosed else _REFERENCE.sub(_closed, text))
    p.close()
    found: dict[str, Any] = {"title": _plain(p.title) or None, "author": None, "custom": {}}
    for name, prop, content in p.meta:
        if name:
            if name.lower() == "author":
                found["author"] = content
            else:
                found["custom"]["description" if name.lower() == "description" else name] = content
        if prop:
            found["custom"][prop] = content
    if selectors:
        return " ".join(filter(None, (_plain(x) for s in selectors for x in p.parts[s]))), found
    return _plain(p.body), found


_ABSENT = object()


def at_path(value: Any, path: str) -> Any:
    """What lies at a dotted path of keys and indexes; raises KeyError if nothing does."""
    for key in filter(None, path.split(".")):
        if isinstance(value, dict) and key in value:
            value = value[key]
        elif isinstance(value, list) and re.fullmatch(r"[+-]?\d+", key) and 0 <= int(key) < len(value):
            value = value[int(key)]
        else:
            raise KeyError(path)
    return value


def as_text(value: Any) -> str:
    if isinstance(value, str):
        return value
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, int | float) else json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False)


def json_document(value: Any, content: str | None = None, metadata: tuple[str, ...] = ()) -> tuple[str, dict[str, Any]]:
    """Content at a path, and metadata at others; a missing content raises, missing metadata is left out."""
    found: dict[str, Any] = {"title": None, "author": None, "source": None, "custom": {}}
    for path in metadata:
        try:
            got = as_text(at_path(value, path))
        except KeyError:
            continue
        name = path.rsplit(".", 1)[-1]
        if name in ("title", "author", "source"):
            found[name] = got
        else:
            found["custom"][name] = got
    return as_text(at_path(value, content) if content else value), found
