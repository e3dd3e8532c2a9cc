"""Texts as arrays of code points: NFKC, lower case and a letter-or-digit test at array speed."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: Marks a code point that must go through the exact path (it may join with its neighbours or become several).
SLOW = np.uint32(0xFFFFFFFF)
LIMIT = 0x10000


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def exact(text: str) -> np.ndarray:
    """Letters and digits of the text after NFKC and lower-casing, without the table."""
    return points("".join(filter(str.isalnum, unicodedata.normalize("NFKC", text).lower())))


@lru_cache(1)
def table() -> np.ndarray:
    """For code points below LIMIT: the folded letter or digit, 0 for what is dropped, SLOW where a single one can't be told."""
    out = np.zeros(LIMIT + 1, np.uint32)
    out[LIMIT] = SLOW
    for i in range(LIMIT):
        c = chr(i)
        if unicodedata.combining(c) or unicodedata.category(c)[0] == "M" or 0x1100 <= i < 0x1200 or c in "ΣϹ":  # final sigma depends on what follows
            out[i] = SLOW
            continue
        t = unicodedata.normalize("NFKC", c).lower()
        if len(t) == 1:
            out[i] = ord(t) if t.isalnum() else 0
        else:
            out[i] = SLOW if any(x.isalnum() for x in t) or any(unicodedata.combining(x) for x in t) else 0
    out[0xFF9E : 0xFFA0] = SLOW  # half-width voiced marks join with the letter before
    return out


def fold(text: str | None) -> np.ndarray:
    """`exact`, through the table where that gives the same."""
    if not text:
        return np.empty(0, np.uint32)
    a = table()[np.minimum(points(text), LIMIT)]
    return exact(text) if (a == SLOW).any() else a[a != 0]


def fold_all(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """`fold` of every text, one after another, and where each starts (one more entry: the end)."""
    raw = "".join(t or "" for t in texts)
    a = table()[np.minimum(points(raw), LIMIT)]
    ends = np.cumsum(np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts)))
    slow = np.unique(np.searchsorted(ends, np.flatnonzero(a == SLOW), side="right"))
    kept = np.concatenate(([0], np.cumsum(a != 0)))
    starts = kept[np.concatenate(([0], ends))]
    a = a[a != 0]
    if not len(slow):
        return a, starts
    parts = [a[s:e] for s, e in zip(starts[:-1], starts[1:])]
    for k in slow:
        parts[k] = exact(texts[k])
    return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
