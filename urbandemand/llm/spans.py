"""Spans in a text: base patterns, merging and their text forms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

Span = tuple[int, int, str]


def joined(spans: Iterable[Span], order: dict[str, int]) -> str:
    """``kind:start:end`` by start and then by the kinds' order, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def apart(found: Iterable[Span], taken: Iterable[Span]) -> list[Span]:
    """Those of ``found`` that meet neither ``taken`` nor an earlier one of them."""
    kept: list[Span] = []
    blocked = sorted((s, e) for s, e, _ in taken)
    at = 0
    upto = -1
    for start, end, kind in sorted(found, key=lambda s: (s[0], -s[1])):
        if start < upto:
            continue
        while at < len(blocked) and blocked[at][1] <= start:
            at += 1
        if any(s < end for s, e in blocked[at : at + 1]) or any(s < end and e > start for s, e in blocked[at : at + 8]):
            continue
        kept.append((start, end, kind))
        upto = end
    return kept


def redacted(text: str, spans: Iterable[Span]) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
