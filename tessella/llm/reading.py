"""Reading level of each document (problem 8).

One smoothed unigram language model per grade, trained on the labelled documents; a document gets the
grade with the greatest posterior likelihood. Terms are Latin words and pairs of neighbouring Han
characters, hashed into `2 ** bits` slots; all of it is computed on arrays of code points, a batch of
documents at a time, over the whole texts.

The labelled rows are bounded by `max_labels` (the least hashes of the id are taken beyond it), so the
model is bounded too: at most `grades * 2 ** bits` numbers.

Defined results: null or empty texts and texts of fewer than `min_terms` terms (placeholders) have no
prose and get grade null; ties go to the lower grade; terms unknown to all grades do not count; without
labels every grade is null; repeated rows are graded alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, ALPHA, MIN_TERMS, MAX_LABELS = 20, 0.1, 6, 20_000
_B = np.uint64(0x5851F42D4C957F2D)
_B_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def terms(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of every term of the texts."""
    joined = "\n".join(t.lower() if t else "" for t in texts)
    a = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t.lower()) if t else 0 for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)
    shift = np.uint64(64 - bits)
    han = ((a >= 0x4E00) & (a <= 0x9FFF)) | ((a >= 0x3400) & (a <= 0x4DBF)) | ((a >= 0x20000) & (a <= 0x3FFFF))
    pair = np.flatnonzero(han[:-1] & han[1:])
    x = a.astype(np.uint64)
    pair_slot = ((x[pair] * np.uint64(0x1FFFFF) + x[pair + 1] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> shift
    latin = ((a >= 0x61) & (a <= 0x7A)) | ((a >= 0xDF) & (a <= 0x24F) & (a != 0xF7))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], latin.view(np.int8), [0]))))
    s, e = edge[::2], edge[1::2]
    if len(s):
        # polynomial prefix hashes modulo 2 ** 64: the hash of a word is a difference, moved to power 0
        power = np.full(len(a) + 1, _B, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        inverse = np.full(len(a) + 1, _B_INVERSE, np.uint64)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * power[:-1], dtype=np.uint64)))
        word_slot = (((prefix[e] - prefix[s]) * inverse[s] + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93)) >> shift
    else:
        word_slot = np.empty(0, np.uint64)
    at, slot = np.concatenate((pair, s)), np.concatenate((pair_slot, word_slot)).astype(np.int64)
    return np.searchsorted(ends, at, side="right"), slot


def train(documents: DataFrame, labels: DataFrame, key: str, text: str, grade: str, bits: int = BITS, alpha: float = ALPHA, max_labels: int = MAX_LABELS) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(grades, slots seen, log-probabilities [slot, grade]). Counting is distributed; labels are broadcast, at most `max_labels`."""
    known = labels.filter(F.col(grade).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(grade).cast("int").alias("__g"))
    known = known.orderBy(F.xxhash64(key), key).limit(max_labels)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            doc, slot = terms(pdf["t"].tolist(), bits)
            code, n = np.unique(pdf["g"].to_numpy(np.int64)[doc] << bits | slot, return_counts=True)
            yield pd.DataFrame({"g": (code >> bits).astype(np.int32), "s": code & ((1 << bits) - 1), "n": n})

    seen = documents.join(F.broadcast(known), key).select(F.col("__g").alias("g"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    counts = seen.mapInPandas(count, "g int, s long, n long").groupBy("g", "s").agg(F.sum("n").alias("n")).toPandas()
    grades = sorted(int(g) for g in counts["g"].unique())
    slots = np.sort(counts["s"].unique()).astype(np.int64)
    n = np.zeros((len(slots), len(grades)))
    n[np.searchsorted(slots, counts["s"]), np.searchsorted(grades, counts["g"])] = counts["n"]
    return grades, slots, np.log((n + alpha) / (n.sum(0) + alpha * max(1, len(slots)))).astype(np.float32)


def grade_documents(documents: DataFrame, labels: DataFrame, key: str, text: str, grade: str, bits: int = BITS, alpha: float = ALPHA, min_terms: int = MIN_TERMS, max_labels: int = MAX_LABELS) -> DataFrame:
    """(key, grade, probability of the grade, terms) of every document."""
    grades, slots, logp = train(documents, labels, key, text, grade, bits, alpha, max_labels)
    shared = documents.sparkSession.sparkContext.broadcast((slots, logp))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, logp = shared.value
        where = np.full(1 << bits, len(slots), np.int32)
        where[slots] = np.arange(len(slots))
        table = np.vstack((logp, np.zeros((1, len(grades)), np.float32)))
        for pdf in batches:
            m = len(pdf)
            doc, slot = terms(pdf["t"].tolist(), bits)
            row = where[slot]
            total = np.stack([np.bincount(doc, table[row, g], m) for g in range(len(grades))], 1) if grades else np.zeros((m, 1))
            count = np.bincount(doc, minlength=m)
            best = total.argmax(1)
            p = np.exp(total - total.max(1, keepdims=True))
            p = p.max(1) / p.sum(1)
            prose = (count >= min_terms) & bool(grades)
            level = pd.array(np.array(grades or [0])[best], dtype="Int32")
            level[~prose] = pd.NA
            yield pd.DataFrame({key: pdf["k"], grade: level, "probability": np.where(prose, p, np.nan), "terms": count})

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {kind}, `{grade}` int, probability double, terms long")
