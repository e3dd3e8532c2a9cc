"""Filling fixed-capacity containers with texts (problem 6).

Sizes are tokens of a public tokenizer. The packing plan is made from the histogram of sizes alone
(at most `capacity` bins, whatever the number of texts): shallow combinations of sizes that fill a window
below the capacity are enumerated, non-negative least squares solves how often each is to be repeated
so that together they use up the histogram, the counts are rounded down, and the rest is packed
greedily, the largest size first, each time into the best fitting space.

Texts then find their container by their rank among the texts of their size. Ranks are taken per
(size, salt) and shifted by the counts of the salts before, so that a size shared by a third of all
texts is no hot group.

Defined results: a text of more than `capacity` tokens is cut into full containers and a rest; null and
empty texts have size 0 and lie in container 0 at offset 0, where they take no room; repeated rows are
packed as texts of their own, numbered by `copy`; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.session import broadcast_if_small, cut

CAPACITY, WINDOW_SLACK, DEPTH = 2048, 16, 4
#: Fixed value: how the public byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows that one (size, salt) group should hold at most, by count of all rows.
SALT_ROWS = 1_000_000


@lru_cache(2)
def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """(key, tokens) of every row; tokenizer: the file of a byte-level vocabulary."""
    with open(tokenizer, "rb") as f:
        vocabulary = f.read()
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(shared.value).encode_ordinary
        for pdf in batches:
            sizes = [len(encode(t.encode("utf-8", "replace").decode())) if t else 0 for t in pdf["t"]]
            yield pd.DataFrame({key: pdf["k"], "tokens": np.array(sizes, dtype=np.int64)})

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, tokens long")


def combinations(sizes: np.ndarray, capacity: int, slack: int = WINDOW_SLACK, depth: int = DEPTH, branch: int = 12) -> np.ndarray:
    """Rows of up to `depth` sizes (descending, 0-padded) whose sum lies in [capacity - slack, capacity].

    Inner sizes are taken from `branch` evenly spaced ones below the first, the last one is what fits best."""
    have = np.zeros(capacity + 1, bool)
    have[sizes] = True
    below = np.maximum.accumulate(np.where(have, np.arange(capacity + 1), 0))  # the greatest size not above
    out, partial = [], [(int(s),) for s in sizes]
    for d in range(1, depth + 1):
        kept = []
        for p in partial:
            room = capacity - sum(p)
            if 0 <= room <= slack:
                out.append(p)
            elif d < depth and room > 0:
                last = int(below[min(room, p[-1])])
                if last and room - last <= slack:
                    out.append((*p, last))
                if d < depth - 1:
                    inner = sizes[sizes <= min(room, p[-1])]
                    inner = inner[np.unique(np.linspace(0, len(inner) - 1, min(len(inner), branch if d == 1 else 4)).astype(int))] if len(inner) else inner
                    kept += [(*p, int(s)) for s in inner]
        partial = kept
    rows = sorted(set(out))
    table = np.zeros((len(rows), depth), np.int64)
    for i, r in enumerate(rows):
        table[i, : len(r)] = r
    return table


def nnls(columns: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """x >= 0 with A x close to the histogram, A's columns being the combinations; accelerated projected gradient."""
    if not len(columns):
        return np.zeros(0)
    flat, used = columns.ravel(), columns > 0
    each = np.where(used, 1.0, 0.0)
    degree = np.bincount(flat, each.ravel(), len(histogram))
    lipschitz = columns.shape[1] * max(1.0, degree[1:].max() * columns.shape[1])
    # bins with few texts weigh as much as bins with many: solve for shares of each bin
    x = y = np.zeros(len(columns))
    t = 1.0
    scale = 1.0 / lipschitz
    for _ in range(steps):
        rest = np.bincount(flat, (each * y[:, None]).ravel(), len(histogram)) - histogram
        rest[0] = 0
        new = np.maximum(0, y - scale * (rest[columns] * each).sum(1))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: dict[int, int], capacity: int, slack: int = WINDOW_SLACK, depth: int = DEPTH) -> list[tuple[list[int], int]]:
    """Patterns (sizes of one container, descending) and how many containers of each; they use up the histogram exactly."""
    left = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        left[s] += n
    out: list[tuple[list[int], int]] = []

    def use(pattern: list[int], times: int) -> None:
        sizes, per = np.unique(pattern, return_counts=True)
        times = min(times, int((left[sizes] // per).min()))
        if times > 0:
            left[sizes] -= per * times
            out.append((sorted(pattern, reverse=True), times))

    table = combinations(np.flatnonzero(left[1:]) + 1, capacity, slack, depth)
    x = np.floor(nnls(table, left.astype(float)) + 1e-6).astype(np.int64)
    for i in np.argsort(-x, kind="stable"):
        if x[i] <= 0:
            break
        use([int(s) for s in table[i] if s], int(x[i]))
    # the rest: the largest size, then whatever fits best, as often as it can be repeated
    while left[1:].any():
        room, pattern, spare = capacity, [], left.copy()
        while room > 0:
            fits = np.flatnonzero(spare[1 : room + 1])
            if not len(fits):
                break
            s = int(fits[-1]) + 1
            n = int(min(room // s, spare[s]))
            # take one at a time where it could leave a better fit for others
            n = n if room - n * s == 0 else 1
            pattern += [s] * n
            spare[s] -= n
            room -= s * n
        use(pattern, int(left.max()))
    return out


def _intervals(patterns: list[tuple[list[int], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each (size, first rank): the container of that rank, how many of the size lie in one container, and their first offset."""
    taken = np.zeros(capacity + 1, np.int64)
    rows, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for s, n in sorted(((s, pattern.count(s)) for s in set(pattern)), reverse=True):
            rows.append((s, taken[s], base, n, offset))
            taken[s] += n * times
            offset += s * n
        base += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": a[:, 0] << 44 | a[:, 1], "rank": a[:, 1], "base": a[:, 2], "per": a[:, 3], "offset": a[:, 4]}


def pack(sizes: DataFrame, key: str, capacity: int = CAPACITY, slack: int = WINDOW_SLACK, depth: int = DEPTH) -> DataFrame:
    """(key, copy, piece_no, start, tokens, container, offset) from (key, tokens); every token of every row lies in one container."""
    if not 1 < capacity < 1 << 19:
        raise ValueError("the capacity must be between 2 and 524287")
    spark = sizes.sparkSession
    copies = sizes.select(key, "tokens").groupBy(key, "tokens").agg(F.count("*").alias("n"))
    pieces = copies.select(key, F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("copy"), "tokens").select(
        key, "copy", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("tokens") - 1, F.lit(0)), F.lit(capacity))).alias("piece_no", "start"), F.col("tokens").alias("all")
    )
    items = cut(pieces.select(key, "copy", "piece_no", "start", F.least(F.lit(capacity), F.col("all") - F.col("start")).cast("int").alias("tokens")))
    counted = {int(r.tokens): int(r.n) for r in items.groupBy("tokens").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    rows = sum(counted.values())
    full = counted.get(capacity, 0)
    places = _intervals([*([([capacity], full)] if full else []), *plan({s: n for s, n in counted.items() if 0 < s < capacity}, capacity, slack, depth)], capacity)
    shared = spark.sparkContext.broadcast(places)
    salts = int(min(4096, max(8, -(-rows // SALT_ROWS))))
    salted = items.withColumn("__salt", F.pmod(F.xxhash64(key, "copy", "piece_no"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("tokens", "__salt").agg(F.count("*").alias("n"))
    before = counts.select("tokens", "__salt", F.coalesce(F.sum("n").over(W.partitionBy("tokens").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = salted.join(broadcast_if_small(before), ["tokens", "__salt"]).withColumn(
        "__rank", F.col("__before") + F.row_number().over(W.partitionBy("tokens", "__salt").orderBy(key, "copy", "piece_no")) - 1
    )

    @F.pandas_udf("container long, offset int")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = shared.value
        s, r = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        if not len(p["key"]):
            return pd.DataFrame({"container": np.zeros(len(s), np.int64), "offset": np.zeros(len(s), np.int32)})
        i = np.maximum(0, np.searchsorted(p["key"], s << 44 | r, side="right") - 1)
        step = r - p["rank"][i]
        container = np.where(s == 0, 0, p["base"][i] + step // p["per"][i])
        offset = np.where(s == 0, 0, p["offset"][i] + step % p["per"][i] * s)
        return pd.DataFrame({"container": container, "offset": offset.astype(np.int32)})

    return ranked.withColumn("__at", place("tokens", "__rank")).select(key, "copy", "piece_no", "start", "tokens", "__at.container", "__at.offset")
