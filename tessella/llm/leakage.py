"""Evaluation texts leaking into training text (problem 7).

Letters and digits (after NFKC and lower-casing) of every corpus text and every test passage are cut into windows, which get
64-bit SimHash fingerprints over weighted character shingles (weights: counts). Fingerprints within Hamming distance `radius`
are found by a multi-index of `radius + 1` blocks: two such fingerprints agree in at least one whole block. Candidates are
verified by the exact weighted-shingle similarity of the two windows.

* `find_near` takes windows as long as the passages (in classes of nearly equal length) and reports the passages that occur as
  a whole, also with some letters changed, left out or put in.
* `find_leaks` wants parts of a passage as well, which no window of the passage's size resembles. It cuts a passage at every
  position and a text at every `run - window + 1` positions into windows of `window` characters, so that any common run of `run`
  characters holds an aligned window of the text that equals some window of the passage, and verifies
  candidates further by the length of the exact common run around them.

The passages are a stated query set, held against all rows in blocks of at most `block_chars` characters; a pass over the
corpus folds each text once and tries up to `PASS_BLOCKS` blocks, which are broadcast once, so what is sent to the executors
stays bounded. The corpus is never shuffled, collected, joined or sampled.

Defined results: null, empty or too short texts and passages match nothing; repeated rows give the
pair once; of several places the greatest similarity counts; columns other than the named ones are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.codepoints import fold, fold_all

RUN, WINDOW, SHINGLE, RADIUS, SIMILARITY = 40, 24, 3, 3, 0.8
#: Item-sized windows: the radius, the ratio of neighbouring window sizes, the shortest size, steps for each window.
NEAR_RADIUS, GROWTH, SHORTEST, STEPS = 11, 1.12, 24, 8
BLOCK_CHARS, PASS_BLOCKS = 2_000_000, 4
#: Item-sized windows are counted in 16 bits; longer passages are refused.
LONGEST = 60_000
#: Characters (and windows) of corpus text that are fingerprinted at once (bounds the memory of a worker).
SLICE = 400_000
#: The bits of a byte as eight bytes of 0 or 1.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def fingerprints(a: np.ndarray, starts: np.ndarray, window: int, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of the windows of `a` at `starts`."""
    if not len(starts):
        return np.empty(0, np.uint64)
    per = window - shingle + 1
    n = len(a) - shingle + 1
    h = np.zeros(n, np.uint64)
    for k in range(shingle):
        h = h * np.uint64(0x10001F) + a[k : n + k]
    parts = _mix(h).view(np.uint8).reshape(-1, 8)
    out = np.empty((len(starts), 8), np.uint8)
    for b in range(8):
        # eight counters of a byte each in one number; a window has fewer than 256 shingles
        lanes = _LANES[parts[:, b]]
        total = lanes[starts]
        for k in range(1, per):
            total += lanes[k:][starts]
        out[:, b] = np.packbits(total.view(np.uint8).reshape(-1, 8) > per // 2, axis=1)[:, 0]
    return out.view(np.uint64).ravel()


def window_starts(bounds: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of the windows at 0, stride, 2 * stride, ... of each text between two bounds."""
    count = np.maximum(0, (np.diff(bounds) - window) // stride + 1)
    count[np.diff(bounds) < window] = 0
    text = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, bounds[:-1][text] + step * stride


class MultiIndex:
    """Fingerprints by each of their `radius + 1` blocks."""

    def __init__(self, fp: np.ndarray, radius: int):
        self.fp, self.radius, self.blocks = fp, radius, radius + 1
        self.width = 64 // self.blocks
        self.tables = []
        for b in range(self.blocks):
            v = self.block(self.fp, b)
            order = np.argsort(v, kind="stable")
            first = np.searchsorted(v[order], np.arange((1 << self.width) + 1))
            self.tables.append((order.astype(np.int32), first.astype(np.int64)))

    def block(self, fp: np.ndarray, b: int) -> np.ndarray:
        return ((fp >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def near(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in fp, window of the index) with Hamming distance of at most the radius."""
        found = []
        for b, (order, first) in enumerate(self.tables):
            v = self.block(fp, b)
            count = first[v + 1] - first[v]
            who = np.repeat(np.arange(len(fp)), count)
            if not len(who):
                continue
            step = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
            win = order[np.repeat(first[v], count) + step]
            close = np.bitwise_count(fp[who] ^ self.fp[win]) <= self.radius
            found.append(who[close].astype(np.int64) * len(self.fp) + win[close])
        both = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return both // max(1, len(self.fp)), both % max(1, len(self.fp))


class Index(MultiIndex):
    """All windows of one size of a block of passages."""

    def __init__(self, ids: list[int], texts: list[np.ndarray], window: int, radius: int):
        self.ids, self.window = ids, window
        bounds = np.cumsum([0, *map(len, texts)])
        self.of, starts = window_starts(bounds, window, 1)
        self.at = starts - bounds[:-1][self.of]
        self.texts = [t.tobytes() for t in texts]
        super().__init__(fingerprints(np.concatenate([np.empty(0, np.uint32), *texts]), starts, window), radius)


def shingle_hashes(a: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    n = max(0, len(a) - shingle + 1)
    h = np.zeros(n, np.uint64)
    for k in range(shingle):
        h = h * np.uint64(0x10001F) + a[k : n + k]
    return _mix(h)


def bit_sums(a: np.ndarray) -> np.ndarray:
    """Row i: how often each bit is set in the hashes of the shingles that begin before i, modulo 2 ** 16."""
    h = shingle_hashes(a)
    out = np.zeros((len(h) + 1, 64), np.uint16)
    np.cumsum(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.uint16, out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """SimHash of a[start:stop] for all spans (of fewer than 2 ** 16 characters), from `bit_sums`."""
    ends = stops - SHINGLE + 1
    half = ((ends - starts) // 2).astype(np.uint16)[:, None]
    return np.packbits(sums[ends] - sums[starts] > half, axis=1).view(np.uint64).ravel()


class Sized:
    """The passages of a block by size: class k holds those of at least SHORTEST * GROWTH ** k characters, below the next class."""

    def __init__(self, ids: list[int], texts: list[np.ndarray], radius: int):
        self.ids, self.texts = ids, texts
        size = np.array([len(t) for t in texts])
        if size.size and size.max() >= LONGEST:
            raise ValueError(f"a passage has fewer than {LONGEST} letters and digits")
        level = np.floor(np.log(np.maximum(size, SHORTEST) / SHORTEST) / np.log(GROWTH) + 1e-9).astype(int)
        self.classes = []
        for k in np.unique(level[size >= SHORTEST]):
            which = np.flatnonzero((level == k) & (size >= SHORTEST))
            fp = np.concatenate([spans(bit_sums(texts[i]), np.array([0]), np.array([len(texts[i])])) for i in which])
            self.classes.append((int(size[which].mean()), which, MultiIndex(fp, radius)))
        self.widest = max((w for w, _, _ in self.classes), default=0)


def weighted_similarity(a: bytes, b: bytes, shingle: int = SHINGLE) -> float:
    """Weighted Jaccard of the shingle counts of two windows (4 bytes a character)."""
    x, y = (Counter(s[i : i + 4 * shingle] for i in range(0, len(s) - 4 * shingle + 1, 4)) for s in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def _run(text: bytes, i: int, item: bytes, j: int, window: int) -> int:
    """Length in characters of the longest common run that touches the two windows at i and j, aligned."""
    best = 0
    lo = -min(i, j)
    hi = min((len(text) >> 2) - i, (len(item) >> 2) - j)
    x = np.frombuffer(text, np.uint32)[i + lo : i + hi] == np.frombuffer(item, np.uint32)[j + lo : j + hi]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], x.view(np.int8), [0]))))
    for s, e in zip(edge[::2], edge[1::2]):
        if s < window - lo and e > -lo:
            best = max(best, int(e - s))
    return best


def leaks(texts: list[str | None], index: Index, run: int, similarity: float) -> list[tuple[int, int]]:
    """Distinct (position in texts, item id) with a common run of at least `run` characters."""
    w = index.window
    out: set[tuple[int, int]] = set()
    lo = 0
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and (held < SLICE or hi == lo):
            held += len(texts[hi] or "")
            hi += 1
        a, bounds = fold_all(texts[lo:hi])
        doc, start = window_starts(bounds, w, run - w + 1)
        for s in range(0, len(start), SLICE):  # a very long text goes in parts
            first = int(start[s])
            last = int(start[min(s + SLICE, len(start)) - 1]) + w
            who, win = index.near(fingerprints(a[first:last], start[s : s + SLICE] - first, w))
            for p, q in zip((who + s).tolist(), win.tolist()):
                k, t = int(doc[p]), int(index.of[q])
                if (lo + k, index.ids[t]) in out:
                    continue
                i, j = int(start[p]), int(index.at[q])
                item = index.texts[t]
                if weighted_similarity(a[i : i + w].tobytes(), item[4 * j : 4 * (j + w)]) >= similarity:
                    # the run may reach as far as the passage does
                    left, right = max(int(bounds[k]), i - len(item) // 4), min(int(bounds[k + 1]), i + w + len(item) // 4)
                    if _run(a[left:right].tobytes(), i - left, item, j, w) >= run:
                        out.add((lo + k, index.ids[t]))
        lo = hi
    return sorted(out)


def aligned_similarity(text: np.ndarray, around: int, reach: int, passage: np.ndarray) -> float:
    """The similarity of the passage to as many characters of the text, put where most of their shingles meet, near `around`."""
    lo = max(0, around - reach)
    part, own = shingle_hashes(text[lo : around + len(passage) + reach]), shingle_hashes(passage)
    order = np.argsort(own, kind="stable")
    at = np.minimum(np.searchsorted(own[order], part), len(own) - 1)
    meet = own[order][at] == part
    if not meet.any():
        return 0.0
    shift = np.flatnonzero(meet) - order[at[meet]]
    start = max(0, lo + int(np.bincount(shift - shift.min()).argmax()) + int(shift.min()))
    return weighted_similarity(text[start : start + len(passage)].tobytes(), passage.tobytes())


def near(texts: list[str | None], index: Sized, similarity: float) -> dict[tuple[int, int], float]:
    """(position in texts, item id): the greatest similarity of a passage of the item to a part of the text, if it reaches `similarity`."""
    out: dict[tuple[int, int], float] = {}
    lo = 0
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and (held < SLICE or hi == lo):
            held += len(texts[hi] or "")
            hi += 1
        a, bounds = fold_all(texts[lo:hi])
        for seg in range(0, len(a), SLICE // 4):  # bounds the memory of the sums
            part = a[seg : seg + SLICE // 4 + index.widest]
            sums = bit_sums(part) if len(part) >= SHINGLE else None
            for window, which, multi in index.classes if sums is not None else ():
                short = int(window * similarity)  # the end of a text, or a short text, may be a whole passage with some letters left out
                doc, start = window_starts(bounds, short, max(1, window // STEPS))
                mine = (start >= seg) & (start < seg + SLICE // 4)
                doc, start = doc[mine], start[mine]
                stop = np.minimum(start + window, bounds[1:][doc])
                who, win = multi.near(spans(sums, start - seg, stop - seg))
                for p, q in zip(who.tolist(), win.tolist()):
                    k, passage = int(doc[p]), index.texts[which[q]]
                    text = a[bounds[k] : bounds[k + 1]]
                    key = (lo + k, index.ids[which[q]])
                    found = aligned_similarity(text, int(start[p] - bounds[k]), window // STEPS, passage)
                    if found >= similarity and found > out.get(key, 0.0):
                        out[key] = found
        lo = hi
    return out


_BUILT: dict[str, list] = {}


def _built(name: str, shared, make: Callable) -> list:
    """The indexes of the blocks of a broadcast with a unique name, made once in each Python worker; only the latest are kept."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = [make(ids, texts) for ids, texts in shared.value]
    return _BUILT[name]


def _passes(items: DataFrame, item_id: str, fields: list[str], block_chars: int) -> Iterator[list[tuple[list[int], list[np.ndarray]]]]:
    """The folded passages of a stated query set, in blocks; at most PASS_BLOCKS blocks at a time."""
    passages = items.select(F.col(item_id).alias("i"), F.explode(F.array(*fields)).alias("t")).filter(F.col("t").isNotNull() & F.col("i").isNotNull())
    size = passages.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-size * 2 // block_chars))
    for first in range(0, blocks, PASS_BLOCKS):
        some = []
        for b in range(first, min(blocks, first + PASS_BLOCKS)):
            rows = passages.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).distinct().collect()
            some.append(([r.i for r in rows], [fold(r.t) for r in rows]))
        yield some


def _over_corpus(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, fields: list[str], block_chars: int, make: Callable, search: Callable, extra: str) -> DataFrame:
    """Rows (doc_id, item_id, extra) of `search(texts, index)` for all texts and all blocks of passages."""
    names = [doc_id, item_id, *([extra.split()[0]] if extra else [])]
    schema = f"`{doc_id}` {corpus.schema[doc_id].dataType.simpleString()}, `{item_id}` {items.schema[item_id].dataType.simpleString()}{', ' + extra if extra else ''}"
    column = corpus.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).filter(F.col("t").isNotNull())  # a short text may hold a run after NFKC
    parts = []
    for some in _passes(items, item_id, fields, block_chars):
        shared, name = corpus.sparkSession.sparkContext.broadcast(some), uuid4().hex

        def work(batches: Iterator[pd.DataFrame], shared=shared, name=name) -> Iterator[pd.DataFrame]:
            indexes = _built(name, shared, make)
            for pdf in batches:
                texts, ids = pdf["t"].tolist(), pdf["d"].to_numpy()
                for index in indexes:
                    found = search(texts, index)
                    if found:
                        yield pd.DataFrame([(ids[k], *rest) for k, *rest in found], columns=names)

        parts.append(column.mapInPandas(work, schema))
    return reduce(DataFrame.unionByName, parts)


def find_leaks(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, fields: list[str], run: int = RUN, window: int = WINDOW, radius: int = RADIUS, similarity: float = SIMILARITY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row (doc_id, item_id) for each text that shares `run` consecutive letters or digits with a field of an item."""
    if not 2 * SHINGLE <= window <= min(run, 250):
        raise ValueError("a window must hold some shingles and not exceed the run")
    make = lambda ids, texts: Index(ids, texts, window, radius)
    search = lambda texts, index: leaks(texts, index, run, similarity)
    return _over_corpus(corpus, doc_id, text, items, item_id, fields, block_chars, make, search, "").distinct()


def find_near(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, fields: list[str], radius: int = NEAR_RADIUS, similarity: float = SIMILARITY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row (doc_id, item_id, similarity) for each text that holds a whole passage of an item, unchanged or nearly so."""
    make = lambda ids, texts: Sized(ids, texts, radius)
    search = lambda texts, index: [(k, i, s) for (k, i), s in near(texts, index, similarity).items()]
    rows = _over_corpus(corpus, doc_id, text, items, item_id, fields, block_chars, make, search, "similarity double")
    return rows.groupBy(doc_id, item_id).agg(F.max("similarity").alias("similarity"))
