"""Line dedup by pairwise alignment: common blocks leave the later document.

Lines of at least ``min_chars`` characters are anchors; the others only ever go along with an anchor. Documents that
share an anchor are candidates. The result is that of aligning every pair of them, by these steps:

1. For a rare line (at most ``rare`` holders) every pair of its holders, and for a more common one each holder with the
   first of them.
2. Where a common line, or a short line beside it, is still in place, the document goes on to the next holders until
   the line goes or no holder is left. A pair without a rare line in common only sees the other's pattern (its common
   and short lines, with a mark for what lies between), so one holder of each pattern stands for all.

The documents of a pair are aligned by patience diff on line hashes: lines that occur once in each are put in order
by their longest increasing subsequence, equal neighbours join them, and the gaps are treated alike. A block of
consecutive aligned lines with an anchor in it is deleted from the later document; the earliest holder keeps it.

Later is the larger id. Defined results: rows with a null id or text are left alone, blank lines never match;
rows of one id and text are one document (each is treated alike) and rows of one id but other texts are told apart
by a hash of the text; a document with nothing but white space left is dropped by ``dedup`` if it lost a line to
others; empty tables give no rows; other columns are ignored by ``deletions`` and carried by ``dedup``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm import kernels as K


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of the first place, that also rises in the second."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        if k == len(tops):
            tops.append(y)
            ends.append(i)
        else:
            tops[k], ends[k] = y, i
        back[i] = ends[k - 1] if k else -1
    out = []
    i = ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of equal lines, rising in both; None matches nothing."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k] and a[i] is not None:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1] and a[j - 1] is not None:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        seen_a, seen_b = Counter(a[i:j]), Counter(b[k:m])
        where = {x: y for y, x in enumerate(b[k:m], k) if x is not None and seen_b[x] == 1}
        anchors = _rising([(x, where[a[x]]) for x in range(i, j) if seen_a[a[x]] == 1 and a[x] in where])
        if not anchors:
            continue
        out += anchors
        last = (i - 1, k - 1)
        for x, y in [*anchors, (j, m)]:
            todo.append((last[0] + 1, x, last[1] + 1, y))
            last = (x, y)
    return sorted(out)


def doomed(a: list, b: list, anchor: list) -> list[int]:
    """The places in b of the aligned blocks that have an anchor."""
    out: list[int] = []
    block: list[int] = []
    last = None
    for x, y in [*patience(a, b), (None, None)]:
        if last is not None and (x, y) != (last[0] + 1, last[1] + 1):
            if any(anchor[p] for p in block):
                out += block
            block = []
        if x is not None:
            block.append(y)
            last = (x, y)
    return out


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row for each document: its key, its lines' hashes (null for blank ones), and which of them are anchors."""
    split = F.split(F.col(text_col), "\n")
    one = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    one = one.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t")).alias("doc"), split.alias("lines"))
    return one.select(
        "doc",
        F.transform("lines", lambda x: F.when(F.trim(x) != "", F.xxhash64(x))).alias("hashes"),
        F.transform("lines", lambda x: F.length(F.trim(x)) >= min_chars).alias("anchor"),
    )


def deletions(docs: DataFrame, min_chars: int = 20, rare: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, gone)``: the key of every document that loses lines, and their places in it from 0."""
    lines = _lines(docs, id_col, text_col, min_chars)
    anchors = lines.select("doc", F.explode(F.array_distinct(F.filter(F.transform(F.arrays_zip("hashes", "anchor"), lambda x: F.when(x["anchor"], x["hashes"])), lambda h: h.isNotNull()))).alias("h"))
    anchors = anchors.distinct()
    holders = anchors.groupBy("h").agg(F.count("*").alias("n"), F.min("doc").alias("first")).filter("n > 1")
    shared = K.settle(anchors.join(holders, "h"))
    common = shared.filter((F.col("n") > rare) & (F.col("doc") != F.col("first"))).select(F.col("first").alias("a"), F.col("doc").alias("b"))
    few = shared.filter(F.col("n") <= rare).select("h", "doc")
    close = few.select("h", F.col("doc").alias("a")).join(few.select("h", F.col("doc").alias("b")), "h").filter("a < b").select("a", "b")
    close = K.settle(close.distinct())
    pairs = common.unionByName(close).distinct()
    whole = K.settle(lines.join(shared.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc"]))
    kind = f"struct<id: {docs.schema[id_col].dataType.simpleString()}, t: bigint>"
    found = K.settle(_aligned(pairs, whole, kind))
    frequent = shared.filter(F.col("n") > rare)
    if frequent.take(1):
        found = _rest(found, frequent, close, whole, kind)
    return found.groupBy(F.col("b").alias("doc")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def _aligned(pairs: DataFrame, whole: DataFrame, kind: str) -> DataFrame:
    """``(b, gone)``: what the later document of each pair loses to the other."""
    left = whole.select(F.col("doc").alias("a"), F.col("hashes").alias("ha"))
    right = whole.select(F.col("doc").alias("b"), F.col("hashes").alias("hb"), F.col("anchor").alias("kb"))

    def align(batches):
        for batch in batches:
            at, gone = [], []
            for i, (a, b, anchor) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
                lost = doomed(a, b, anchor)
                if lost:
                    at.append(i)
                    gone.append(lost)
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(gone, pa.list_(pa.int32()))], ["b", "gone"])

    # the earlier documents last: very many pairs may have one in common, whose lines then don't go through a shuffle for each
    return pairs.join(right, "b").join(left, "a").select("b", "ha", "hb", "kb").mapInArrow(align, f"b {kind}, gone array<int>")


def units(hashes: list, anchor: list, common: set) -> tuple[int, dict[int, list[int]]]:
    """A document's pattern, and the places of each unit: a common line, or a short one with those up to a common line."""
    short = [h is not None and not k for h, k in zip(hashes, anchor)]
    kept = [h if h is not None and (s or h in common) else None for h, s in zip(hashes, short)]
    pattern = [x for i, x in enumerate(kept) if x is not None or not i or kept[i - 1] is not None]
    out: dict[int, list[int]] = {}
    for p, h in enumerate(kept):
        if h is None:
            continue
        if not short[p]:
            out.setdefault(h, []).append(p)
            continue
        for step in (-1, 1):
            q = p
            while 0 <= q < len(kept) and short[q]:
                q += step
            if 0 <= q < len(kept) and kept[q] is not None:
                gram = [step, *kept[p : q + step if q + step >= 0 else None : step]]
                out.setdefault(_key(gram), []).append(p)
    return _key(pattern), out


def _key(parts: list) -> int:
    return int.from_bytes(blake2b(repr(parts).encode(), digest_size=8).digest(), "big", signed=True)


def _rest(found: DataFrame, frequent: DataFrame, close: DataFrame, whole: DataFrame, kind: str) -> DataFrame:
    """``found`` with what documents lose to later holders of common lines than the first."""

    def split(batches):
        for batch in batches:
            at, us, pats, places = [], [], [], []
            for i, (hashes, anchor, common) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
                pattern, of = units(hashes, anchor, set(common))
                at += [i] * len(of)
                pats += [pattern] * len(of)
                us += of
                places += of.values()
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(us, pa.int64()), pa.array(pats, pa.int64()), pa.array(places, pa.list_(pa.int32()))], ["doc", "u", "pattern", "places"])

    common = frequent.groupBy("doc").agg(F.collect_list("h").alias("common"))
    whole = K.settle(whole.join(common, "doc"))
    held = K.settle(whole.select("doc", "hashes", "anchor", "common").mapInArrow(split, f"doc {kind}, u long, pattern long, places array<int>"))
    members = held.select("pattern", "doc").distinct().withColumn("r", F.row_number().over(Window.partitionBy("pattern").orderBy("doc")))
    partners = close.groupBy(F.col("b").alias("doc")).agg(F.count("*").alias("k"))

    def left_in_place(rows: DataFrame, found: DataFrame) -> DataFrame:
        lost = found.groupBy(F.col("b").alias("doc")).agg(F.flatten(F.collect_list("gone")).alias("gone"))
        return rows.join(lost, "doc", "left").filter(F.col("gone").isNull() | (F.size(F.array_except("places", "gone")) > 0)).drop("gone")

    # patterns of a unit in the order of their first documents; a unit's first document has nothing before it
    ranked = held.groupBy("u", "pattern").agg(F.min("doc").alias("a")).withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy("a")))
    ranked = K.settle(ranked)
    starts = ranked.filter("r = 1").select("u", F.col("a").alias("start"))
    todo = K.settle(left_in_place(held.select("doc", "u", "places").join(starts, "u").filter("doc > start").drop("start"), found))
    last = ranked.agg(F.max("r")).first()[0] or 0
    low, high = 1, 8
    while low <= last and todo.take(1):
        at = todo.select("doc", "u").join(ranked.filter(F.col("r").between(low, high)).select("u", "pattern", "a"), "u").filter("a < doc").select("pattern", "a", F.col("doc").alias("b")).distinct()
        # a pair that shares a rare line is done; another document of its pattern stands for the rest of it
        tried = at.join(close.withColumn("done", F.lit(True)), ["a", "b"], "left")
        tried = K.settle(tried)
        again = tried.filter("done").join(partners, F.col("b") == F.col("doc")).select("pattern", "b", F.explode(F.sequence(F.lit(2), F.col("k").cast("int") + 1)).alias("r"))
        again = again.join(members, ["pattern", "r"]).filter("doc < b").select(F.col("doc").alias("a"), "b", "pattern").join(close, ["a", "b"], "left_anti")
        again = again.groupBy("pattern", "b").agg(F.min("a").alias("a")).select("a", "b")
        more = K.settle(_aligned(tried.filter("done IS NULL").select("a", "b").unionByName(again).distinct(), whole, kind))
        found = found.unionByName(more)
        low, high = high + 1, high * 4
        if low <= last:
            todo = K.settle(left_in_place(todo, more))
    return found


def dedup(docs: DataFrame, min_chars: int = 20, rare: int = 8, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """``docs`` without the deleted lines; ``count_col`` follows the length of the text."""
    i, t, g = (K.fresh(docs, c) for c in ("_id", "_t", "_gone"))
    gone = K.settle(deletions(docs, min_chars, rare, id_col, text_col)).select(F.col("doc.id").alias(i), F.col("doc.t").alias(t), F.col("gone").alias(g))
    text = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, at: ~F.array_contains(g, at)), "\n")
    out = docs.join(gone, (F.col(id_col) == F.col(i)) & (F.xxhash64(text_col) == F.col(t)), "left").withColumn(text_col, F.when(F.col(g).isNull(), F.col(text_col)).otherwise(text))
    out = out.filter(F.col(g).isNull() | F.col(text_col).rlike(r"\S"))
    if count_col in docs.columns:
        kind = docs.schema[count_col].dataType
        out = out.withColumn(count_col, F.when(F.col(g).isNull(), F.col(count_col)).otherwise(F.length(text_col).try_cast(kind)))
    return out.select(*K.own(docs))


def trimmed(docs: DataFrame, min_chars: int = 20, rare: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_removed, text)`` for every document that loses lines; text is what is left of it."""
    gone = K.settle(deletions(docs, min_chars, rare, id_col, text_col)).select(F.col("doc.id").alias("_id"), F.col("doc.t").alias("_t"), F.col("gone").alias("_gone"))
    docs = docs.select(id_col, text_col)
    out = docs.join(gone, (docs[id_col] == gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["_t"]))
    text = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return out.select(id_col, F.size("_gone").alias("n_removed"), text.alias("text"))
