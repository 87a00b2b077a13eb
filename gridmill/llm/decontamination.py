"""Benchmark decontamination: pigeonhole edit matching.

Texts are compared in lower case with every run of signs and white space as one space. An item of n characters may
be found with up to ``k = floor(rate * n)`` edits. It is split into k + 1 pieces, one of which must occur unchanged
wherever the item occurs within k edits; one Aho-Corasick automaton finds all pieces of all items in one pass over
a whole text. Around each hit the smallest edit distance of the item to any passage is computed by Myers'
bit-parallel search (Python integers serve as bit vectors of any length), so a match is exact: no window is
skipped, and nothing above the budget is reported.

The benchmark is broadcast; its size is checked, and a larger one is taken in groups that each fit, with one pass
over the documents for each group. A worker builds a group's automaton once and keeps it for its next tasks.

Defined results: null or blank texts and items match nothing; an item too short for an edit must occur exactly and
between word boundaries; rows and items may repeat, each gives its own match, and of items with one id the nearest
counts; null ids are carried; empty tables give no rows; other columns are ignored by ``matches`` and carried by
``drop_contaminated``.
"""

from __future__ import annotations

from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.llm import kernels as K

LIMIT_CHARS = 4 << 20  #: characters of items in a group; its automaton then takes less than 300 MB of a worker


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def nearest(peq: dict, m: int, text: str) -> int:
    """Myers: the smallest edit distance of a pattern of m characters to any passage of text."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        ph <<= 1
        pv = ((mh << 1) | ~(xv | ph)) & mask
        mv = ph & xv & mask
    return best


class Matcher:
    """The automaton of the pieces of all items."""

    def __init__(self, items: list[tuple], rate: float):
        self.items, pieces = [], {}
        for ident, text in items:
            if not text:
                continue
            n = len(text)
            k = int(rate * n)
            peq: dict = {}
            for i, c in enumerate(text):
                peq[c] = peq.get(c, 0) | 1 << i
            edges = [n * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(edges[:-1], edges[1:]):
                pieces.setdefault(text[a:b], []).append((len(self.items), a))
            self.items.append((ident, n, k, peq))
        self.found = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.found.add_word(piece, (len(piece), where))
        if pieces:
            self.found.make_automaton()

    def match(self, text: str) -> dict:
        """Distance by item number, of the items within their budget."""
        if not self.items or not text:
            return {}
        starts: dict[int, list[int]] = {}
        for end, (size, where) in self.found.iter(text):
            for item, offset in where:
                starts.setdefault(item, []).append(end + 1 - size - offset)
        out = {}
        for item, at in starts.items():
            _, n, k, peq = self.items[item]
            if not k:
                if any((p == 0 or text[p - 1] == " ") and (p + n == len(text) or text[p + n] == " ") for p in at):
                    out[item] = 0
                continue
            best, lo, hi = k + 1, None, None
            for p in [*sorted(set(at)), None]:  # windows that overlap are searched as one
                if lo is not None and (p is None or p - k > hi):
                    best = min(best, nearest(peq, n, text[max(0, lo) : hi]))
                    lo = None
                    if not best:
                        break
                if p is not None:
                    lo = p - k if lo is None else lo
                    hi = p + n + k
            if best <= k:
                out[item] = best
        return out


_KEPT: dict[str, Matcher] = {}


def _matcher(name: str, held, rate: float) -> Matcher:
    """A group's matcher, built once in a worker; one of another group makes place for it."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Matcher(held.value, rate)
    return _KEPT[name]


def _groups(benchmark: DataFrame, item_col: str, item_text: str, limit: int):
    """The items, in groups small enough to broadcast."""
    items = benchmark.select(F.col(item_col).alias("item"), normal(F.col(item_text)).alias("text")).filter("text <> ''").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(total // limit) + 1
    for g in range(n):
        yield [(r.item, r.text) for r in (items if n == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == g)).collect()]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", limit: int = LIMIT_CHARS) -> DataFrame:
    """``(id_col, item_col, distance)`` for every row and item that it holds within the item's budget."""
    K.small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), normal(F.col(text_col)).alias("text"))
    item_type = benchmark.schema[item_col].dataType
    schema = f"id {docs.schema[0].dataType.simpleString()}, item {item_type.simpleString()}, distance int"
    out = None
    for items in _groups(benchmark, item_col, item_text, limit):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def find(batches, held=held, name=uuid4().hex):
            m = _matcher(name, held, rate)
            for batch in batches:
                at, item, distance = [], [], []
                for i, text in enumerate(batch.column(1)):
                    near: dict = {}
                    for k, d in m.match(text.as_py()).items():
                        ident = m.items[k][0]
                        near[ident] = min(d, near.get(ident, d))
                    at += [i] * len(near)
                    item += near.keys()
                    distance += near.values()
                own = pa.array(item, batch.schema.field(0).type if not item else None)
                yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), own.cast(_arrow(item_type)), pa.array(distance, pa.int32())], ["id", "item", "distance"])

        part = docs.mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "distance")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", limit: int = LIMIT_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    K.small_batches(docs.sparkSession)
    names = docs.columns
    for items in _groups(benchmark, item_col, item_text, limit):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def clean(batches, held=held, name=uuid4().hex):
            m = _matcher(name, held, rate)
            for batch in batches:
                keep = np.array([not m.match(t.as_py()) for t in batch.column(len(names))], bool)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:-1]], [f"c{i}" for i in range(len(names))])

        plain, schema = K.numbered(docs)
        docs = plain.withColumn("normal", normal(F.col(f"c{names.index(text_col)}"))).mapInArrow(clean, schema).toDF(*names)
    return docs
