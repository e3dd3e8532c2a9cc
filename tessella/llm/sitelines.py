"""Lines repeated across one site's documents (problem 4).

Lines are the parts of a text between line feeds. A line's identifier is a 64-bit hash of its letters
and digits after NFKC and lower-casing, every run of digits read alike; lines without any are ignored.
PrefixSpan over the identifier sequences of each source's documents finds the sequences (single lines
first) that enough distinct documents of the source hold, and every occurrence of a frequent sequence
is deleted from the documents.

* `line_table` normalises at array speed; one row per text, with an array of identifiers.
* `frequent_lines` is the first PrefixSpan step: support is counted in distinct documents, combined
  before the shuffle; (source, line) keys are spread by their hash, so that a source with a third of all
  rows is no hot group.
* `prefix_span` grows the patterns over one sequence for each document of a source, its texts in order: each step
  extends a pattern by the frequent lines in what is left of the document behind its first occurrence, until no
  pattern is frequent. Lines may stand between; only frequent lines take part. With `max_gap` it grows runs of neighbouring
  lines inside texts instead: n lines common to all documents have n (n + 1) / 2 runs, but 2^n - 1 subsequences.
* `of_sequences` gives the occurrences of the sequences that were found, `remove_lines` cuts them.

Defined results: null texts and null sources are left out of counting and keep their texts; an empty
table gives no rows; repeated rows of a key count once; a text whose lines are all removed becomes empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.codepoints import LIMIT, SLOW, exact, points, table
from tessella.session import broadcast_if_small, cut

MIN_DOCS, MIN_SHARE = 3, 0.1
_B, _B_INVERSE = np.uint64(0x5851F42D4C957F2D), np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_DIGIT = np.uint32(0x30)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _digits() -> np.ndarray:
    return np.array([i for i in range(LIMIT) if chr(i).isdecimal()], np.uint32)


def line_ids(texts: list[str | None]) -> list[np.ndarray]:
    """The identifiers of the lines of each text; 0 for a line that has neither letter nor digit."""
    raw = "\n".join(t or "" for t in texts)
    cp = points(raw)
    a = table()[np.minimum(cp, LIMIT)]
    feed = cp == 10
    bounds = np.concatenate(([0], np.flatnonzero(feed) + 1, [len(cp) + 1]))  # of lines; each ends before its line feed
    slow = np.unique(np.searchsorted(bounds, np.flatnonzero(a == SLOW), side="right") - 1)
    a = np.where(a == SLOW, 0, a)
    number = np.isin(a, _digits())
    a[number] = _DIGIT
    keep = a != 0
    line = np.cumsum(feed)[keep]
    a = a[keep]
    again = np.zeros(len(a), bool)
    again[1:] = (a[1:] == _DIGIT) & (a[:-1] == _DIGIT) & (line[1:] == line[:-1])
    a, line = a[~again], line[~again]
    start = np.searchsorted(line, np.arange(len(bounds)))
    if len(a):
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a + np.uint64(1)) * _powers(_B, len(a)), dtype=np.uint64)))
        h = (prefix[start[1:]] - prefix[start[:-1]]) * _powers(_B_INVERSE, len(a) + 1)[start[:-1]]
    else:
        h = np.zeros(len(bounds) - 1, np.uint64)
    h[start[1:] == start[:-1]] = 0
    for k in slow:
        x = exact(raw[bounds[k] : bounds[k + 1] - 1])
        x = np.where(np.isin(x, _digits()), _DIGIT, x)
        x = x[np.concatenate(([True], (x[1:] != _DIGIT) | (x[:-1] != _DIGIT)))] if len(x) else x
        h[k] = ((x + np.uint64(1)) * _powers(_B, len(x))).sum(dtype=np.uint64) if len(x) else 0
    per = np.fromiter(((t.count("\n") if t else 0) + 1 for t in texts), np.int64, len(texts))
    return np.split(h.view(np.int64), np.cumsum(per)[:-1])


def line_table(df: DataFrame, key: str, doc: str, source: str, text: str, order: str | None = None) -> DataFrame:
    """(key, source, document hash, array of line identifiers) of every text that is not null; with `order` also its place `o` in the document."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    ready = df.filter(F.col(text).isNotNull() & F.col(source).isNotNull() & F.col(doc).isNotNull())
    place = [F.col(order).alias("o")] if order else []
    ready = ready.select(F.col(key).alias("k"), F.col(source).alias("s"), F.xxhash64(doc).alias("d"), *place, F.col(text).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="t").assign(lines=line_ids(pdf["t"].tolist()))

    return ready.mapInPandas(run, f"k {kinds[key]}, s {kinds[source]}, d long, {f'o {kinds[order]}, ' if order else ''}lines array<long>")


def frequent_lines(lines: DataFrame, docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(s, line, support) of the lines that at least `min_docs` documents and `min_share` of the source's documents hold.

    lines: of `line_table`; docs: (s, d), a row for each row of the source table (repeats allowed)."""
    total = cut(docs.distinct().groupBy("s").agg(F.count("*").alias("docs")))
    held = lines.select("s", "d", F.explode(F.array_distinct("lines")).alias("line")).filter("line != 0").distinct()
    support = held.groupBy("s", "line").agg(F.count("*").alias("support")).filter(F.col("support") >= min_docs)
    return support.join(broadcast_if_small(total, True), "s").filter(F.col("support") >= F.ceil(F.col("docs") * F.lit(min_share) - F.lit(1e-9))).select("s", "line", "support")


def occurrences(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """(k, s, d, o if `lines` has it, line_no, line) of every occurrence of a frequent line.

    A frequent line is in a tenth of its source's documents, so their number is bounded by ten times the
    lines of a document for each source; it is broadcast only if it is small all the same."""
    each = lines.select(*(c for c in lines.columns if c != "lines"), F.posexplode("lines").alias("line_no", "line")).filter("line != 0")
    return each.join(broadcast_if_small(frequent.select("s", "line"), True), ["s", "line"])


def prefix_span(at: DataFrame, docs: DataFrame, max_length: int | None = None, max_gap: int | None = None, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(s, pattern, support): all frequent sequences of lines over the documents of each source.

    at: `occurrences`. A document is the sequence of its frequent lines, texts ordered by `o` (nulls last), then key.
    The projection of a pattern on a document is what is left behind its first occurrence. Options, off by default:
    `max_length` lines, and neighbours at most `max_gap` lines apart in one text (then sequences are texts, so that no document
    is gathered, and every occurrence is kept).
    The result holds all subsequences of a frequent sequence: n different lines common to enough documents give 2^n - 1."""
    total = broadcast_if_small(cut(docs.distinct().groupBy("s").agg(F.count("*").alias("docs"))), True)
    place = F.col("o") if "o" in at.columns else F.lit(None).cast("int")
    line = F.struct(place.isNull().alias("last"), place.alias("o"), "k", "line_no", "line")
    whole = ["s", "d"] if max_gap is None else ["s", "d", "k"]
    sequences = at.groupBy(*whole).agg(F.array_sort(F.collect_set(line)).alias("rest"))
    thin = (lambda x: x["line"]) if max_gap is None else (lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line")))
    here = cut(sequences.select(*whole, F.array().cast("array<long>").alias("pattern"), F.transform("rest", thin).alias("rest")))
    found, length = None, 0
    while max_length is None or length < max_length:
        length += 1
        if max_gap is None:
            step = here.select("s", "d", "pattern", "rest", F.explode(F.array_distinct("rest")).alias("line"))
            step = step.withColumn("i", F.array_position("rest", F.col("line")))
        else:
            step = here.select("*", F.posexplode("rest").alias("i", "x"))
            if length > 1:
                step = step.filter(F.col("x.line_no") - F.col("end.line_no") <= max_gap)
            step = step.withColumn("line", F.col("x.line")).withColumn("i", F.col("i") + 1).withColumn("end", F.col("x"))
        behind = F.slice("rest", F.col("i").cast("int") + 1, F.greatest(F.size("rest") - F.col("i").cast("int"), F.lit(0)))
        step = step.select(*whole, F.concat("pattern", F.array("line")).alias("pattern"), behind.alias("rest"), *(["end"] if max_gap is not None else []))
        # without a gap a document has one projection of a pattern, so that rows are documents
        holders = step.select("s", "pattern") if max_gap is None else step.select("s", "d", "pattern").distinct()
        support = holders.groupBy("s", "pattern").agg(F.count("*").alias("support"))
        good = cut(support.join(total, "s").filter((F.col("support") >= min_docs) & (F.col("support") >= F.ceil(F.col("docs") * F.lit(min_share) - F.lit(1e-9)))).select("s", "pattern", "support"))
        found = good if found is None else found.unionByName(good)
        if good.isEmpty():
            break
        left = step.filter(F.size("rest") > 0).join(broadcast_if_small(good.select("s", "pattern"), True), ["s", "pattern"])
        here = cut(left if max_gap is None else left.dropDuplicates([*whole, "pattern", "end"]))
    return found


def of_sequences(at: DataFrame, sequences: DataFrame) -> DataFrame:
    """The rows of `at` (occurrences) whose line belongs to one of the sequences (s, pattern) of its source.

    A line of a frequent sequence is frequent alone and a sequence of its own, so each of its occurrences is one of a sequence."""
    members = sequences.select("s", F.explode("pattern").alias("line")).distinct()
    return at.join(broadcast_if_small(members), ["s", "line"], "left_semi")


def remove_lines(df: DataFrame, key: str, text: str, at: DataFrame) -> DataFrame:
    """`df` with `clean`: the text without the lines at `at` (k, line_no); all lines are kept where the key has none."""
    gone = at.groupBy("k").agg(F.collect_set("line_no").alias("__gone"))
    joined = df.join(gone.withColumnRenamed("k", key), key, "left")
    parts = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("__gone", i))
    return joined.withColumn("clean", F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(parts, "\n"))).drop("__gone")
