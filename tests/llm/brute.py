"""Brute-force forms of the contracts, text by text."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def shingles(text: str | None) -> frozenset:
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(rows: list[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple[int, int]]:
    """doc_id -> (size of the set, component), by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def repeats(rows: list[tuple[int, str | None]], k: int = 100) -> dict[int, tuple[int, int, int, str]]:
    seen: set[bytes] = set()
    out = {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for at in range(len(b) - k + 1):
            g = b[at : at + k]
            if g in seen:
                gone[at : at + k] = b"\1" * k
            else:
                seen.add(g)
        kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    s = text or ""
    w = WORD.findall(s)
    lines = [x for x in s.split("\n") if WORD.search(x)]
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(s.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)
