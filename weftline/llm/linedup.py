"""Repeated runs of lines, found in a suffix array over line ids and cut from all but their first place.

Every text is a sequence of line ids (64-bit hashes). Prefix doubling ranks the suffixes: rank k sorts them by their
first 2**k lines, from the pair of ranks k-1 at a position and 2**(k-1) lines on: pairs are counted, sorted by range and numbered by running sums.
A suffix whose 2**k lines occur once is discarded, so a level only carries what still repeats, and the levels stop at
the longest window that is asked for. All places that begin with the same m lines are one interval of the suffix array
with a longest common prefix of m or more; such an interval is named exactly by m and two overlapping ranks.

A repeated run counts from `min_words` words. A maximal run of that size is the union of the smallest windows of
min_words words that begin or end at its lines, so it is enough to look up these windows. Each place of a window but
the first is deleted. The first place is by doc_id (null last), the hash of the text, then line.

Defined results. Documents are the distinct pairs of doc_id and text, so repeated rows are one document. Null and empty
texts have no lines. A run may repeat within one text; then its later copy goes there. min_words is 1 or more. Lines
are compared byte by byte, and words are what white space separates. Extra columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import textcore as T
from .session import cut, fresh

DOC = ["doc_id", "th"]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, h, w): the lines of each document with their hash and number of words, spread by document."""

    def run(batches):
        for rows, data, offs in T.chunks(batches):
            if not len(data):
                continue
            cuts = np.flatnonzero(data == 10)
            row_of = np.repeat(np.arange(rows.num_rows), np.diff(offs) > 0)
            start = np.sort(np.concatenate([offs[row_of], cuts + 1]), kind="stable")
            end = np.sort(np.concatenate([offs[row_of + 1], cuts]), kind="stable")
            row = np.sort(np.concatenate([row_of, np.searchsorted(offs, cuts, "right") - 1]), kind="stable")
            pos = np.arange(len(row)) - np.searchsorted(row, row)
            space = _SPACE[data]
            first = ~space
            first[1:] &= space[:-1]
            inner = offs[1:-1]
            inner = inner[inner < len(data)]
            first[inner] = ~space[inner]
            words = np.concatenate([[0], np.cumsum(first)])
            some = end > start
            h = np.zeros(len(row), np.uint64)
            h[some] = T.span_hash(data, start[some], end[some])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(row)), rows.column(1).take(pa.array(row)), pa.array(pos, pa.int32()), pa.array(h.view(np.int64)), pa.array(words[end] - words[start], pa.int32())],
                names=["doc_id", "th", "pos", "h", "w"],
            )

    text = F.col("text").cast("string")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).filter("text <> ''")
    return found.mapInArrow(run, "doc_id long, th long, pos int, h long, w int").repartition(*DOC).dropDuplicates([*DOC, "pos"])


def _ranks(counts: DataFrame, *keys: str) -> DataFrame:
    """(*keys, r): the number of places (n) of smaller keys, as range-sorted partial sums; the driver sees one number a partition. No key has a task of its own."""
    ordered = cut(counts.select(*keys, "n").repartitionByRange(*keys).sortWithinPartitions(*keys))
    totals = {r["p"]: r["n"] for r in ordered.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("n").alias("n")).collect()}
    before, at = {}, 0
    for p in sorted(totals):
        before[p], at = at, at + totals[p]

    def run(batches):
        base = before.get(TaskContext.get().partitionId(), 0)
        for b in batches:
            n = b.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(base + np.cumsum(n) - n, pa.int64())], names=[*keys, "r"])
            base += int(n.sum())

    return ordered.mapInArrow(run, ", ".join(f"{k} long" for k in (*keys, "r")))


def _windows(places: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, th, start, m, nw): the smallest windows of min_words words that begin or end at a line, within runs of lines that all occur elsewhere."""

    def run(batches):
        for b in batches:
            col = b.column("x")
            if not len(col):
                continue
            offs = col.offsets.to_numpy()
            flat = col.flatten()
            pos, w = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(col)), np.diff(offs))
            n = len(pos)
            new = np.ones(n + 1, bool)
            new[1:n] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1)
            seg = np.cumsum(new[:n]) - 1
            bounds = np.flatnonzero(new)
            c = np.concatenate([[0], np.cumsum(w)])
            i = np.arange(n)
            stop = np.searchsorted(c, c[:-1] + min_words, "left")  # the window i..stop-1
            ahead = stop <= bounds[seg + 1]
            begin = np.searchsorted(c, c[1:] - min_words, "right") - 1  # the largest begin with the words needed
            back = begin >= bounds[seg]
            s = np.concatenate([i[ahead], begin[back]])
            m = np.concatenate([stop[ahead] - i[ahead], i[back] + 1 - begin[back]])
            both = np.unique(s * (n + 1) + m)
            s, m = both // (n + 1), both % (n + 1)
            at = pa.array(row[s])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(pos[s], pa.int32()), pa.array(m, pa.int32()), pa.array(c[s + m] - c[s], pa.int32())], names=["doc_id", "th", "start", "m", "nw"]
            )

    grouped = places.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("x"))
    return grouped.mapInArrow(run, "doc_id long, th long, start int, m int, nw int")


def _double(level: DataFrame, step: int) -> DataFrame:
    """Ranks of the first 2 * step lines from the ranks of step lines, for the places whose 2 * step lines repeat."""
    ahead = W.partitionBy(*DOC).orderBy("pos").rangeBetween(step, step)
    pairs = level.withColumn("b", F.first("r").over(ahead)).filter("b is not null").withColumnRenamed("r", "a")
    ranks = _ranks(pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1"), "a", "b")
    return pairs.join(ranks, ["a", "b"]).select(*DOC, "pos", "r")


def copies(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, th, start, m, nw, first): every window that has an earlier place, with that place."""
    all_lines = cut(lines(docs))
    ranks = _ranks(all_lines.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "h")
    places = cut(all_lines.join(ranks, "h").select(*DOC, "pos", "w", "r"))
    wanted = cut(_windows(places, min_words))
    longest = wanted.agg(F.max("m")).first()[0] or 0
    level, step = places.select(*DOC, "pos", "r"), 1
    named = []
    while step <= longest:
        own = wanted.filter((F.col("m") >= step) & (F.col("m") < 2 * step))
        head = level.select(*DOC, F.col("pos").alias("start"), F.col("r").alias("ra"))
        if step == 1:
            named.append(_at(own, head, "start").withColumn("rb", F.col("ra")))
        else:
            tail = level.select(*DOC, F.col("pos").alias("tail"), F.col("r").alias("rb"))
            named.append(_at(_at(own, head, "start").withColumn("tail", F.col("start") + F.col("m") - step), tail, "tail").drop("tail"))
        if 2 * step > longest:
            break
        level, step = cut(_double(level, step)), 2 * step
    if not named:
        return wanted.withColumn("first", F.struct(F.lit(False).alias("z"), "doc_id", "th", "start")).limit(0)
    found = named[0].select(*DOC, "start", "m", "nw", "ra", "rb")
    for x in named[1:]:
        found = found.unionByName(x.select(*DOC, "start", "m", "nw", "ra", "rb"))
    found = cut(found)
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th", "start")
    first = found.groupBy("m", "ra", "rb").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return found.join(first, ["m", "ra", "rb"]).filter(place > F.col("first")).select(*DOC, "start", "m", "nw", "first")


def _at(windows: DataFrame, level: DataFrame, key: str) -> DataFrame:
    right = level.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), F.col(key).alias("__k"), *[c for c in level.columns if c not in (*DOC, key)])
    on = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__t")) & (F.col(key) == F.col("__k"))
    return windows.join(right, on).drop("__d", "__t", "__k")


def runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, th, start_line, n_lines, first_doc_id, first_line): the maximal runs of lines to delete, and the place of the run's first window. Lines count from 0."""

    def merge(batches):
        for b in batches:
            col = b.column("x")
            if not len(col):
                continue
            offs = col.offsets.to_numpy()
            flat = col.flatten()
            s, m = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(col)), np.diff(offs))
            lift = row * (int((s + m).max()) + 2)  # one running maximum serves all documents
            reach = np.maximum.accumulate(s + m + lift)
            new = np.ones(len(s), bool)
            new[1:] = s[1:] + lift[1:] > reach[:-1]
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(s)) - 1
            src = flat.field(2).take(pa.array(at))
            pick = pa.array(row[at])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pick), b.column(1).take(pick), pa.array(s[at], pa.int32()), pa.array(reach[last] - lift[at] - s[at], pa.int32()), src.field(1), src.field(3)],
                names=["doc_id", "th", "start_line", "n_lines", "first_doc_id", "first_line"],
            )

    grouped = copies(docs, min_words).groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("start", "m", "first"))).alias("x"))
    return grouped.mapInArrow(merge, "doc_id long, th long, start_line int, n_lines int, first_doc_id long, first_line int")


def strip(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs without the later copies; a document of which nothing is left is dropped, and n_chars follows the text."""
    d, t, gone, kept = fresh(docs, "__d", "__t", "__gone", "__kept")
    lost = runs(docs, min_words).groupBy(*DOC).agg(F.collect_list(F.struct("start_line", (F.col("start_line") + F.col("n_lines")).alias("end_line"))).alias(gone))
    lost = lost.select(F.col("doc_id").alias(d), F.col("th").alias(t), gone)
    on = docs["doc_id"].cast("long").eqNullSafe(F.col(d)) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(F.col(t))
    joined = docs.join(lost, on, "left").drop(d, t)
    # a document's runs are disjoint, so what stays are the slices between them
    lines_of = F.split("text", "\n")
    ends = F.array_append(F.array_sort(gone), F.struct(F.size(lines_of).alias("start_line"), F.size(lines_of).alias("end_line")))
    rest = F.flatten(F.transform(ends, lambda g, i: F.slice(lines_of, F.coalesce(F.get(ends, i - 1)["end_line"], F.lit(0)) + 1, g["start_line"] - F.coalesce(F.get(ends, i - 1)["end_line"], F.lit(0)))))
    joined = joined.withColumn(kept, F.when(F.col(gone).isNotNull(), rest)).filter(F.col(kept).isNull() | (F.size(kept) > 0))
    changed = F.col(kept).isNotNull()
    out = joined.withColumn("text", F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
