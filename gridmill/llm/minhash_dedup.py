"""Near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures.

A signature holds ``perms`` MinHash values of the row's word shingles, ``bits`` of each kept. The distance of two
signatures is the number of places at which they differ. Signatures are split into ``chunks`` of consecutive
places; two signatures within ``max_distance`` have, by pigeonhole, a chunk with at most
``errors = max_distance // chunks`` differing places. All sets of that many places of a chunk are masked in turn,
and each masked chunk is a key: every pair within the distance shares at least one key. Rows that share a key are
compared in full, so the pairs are exactly those within the distance, whatever the number of rows under a key.

Equal signatures are folded first (thousands of exact copies cost one row of links each). Under each key every row is
compared with the first, which brings a cluster together in one step, as rows of pairs and never as a list in a row.
Only keys under which rows of different groups are left are searched in full, each in one task: in turn each row that
is reached is compared with the rows not reached yet, so a tight group of n rows costs about n comparisons. Links are
joined into groups by alternating minimum-label steps over written tables, as lineage would otherwise grow.

Defined results: rows whose text is null or blank have no shingle and are never near anything; a text shorter
than a shingle is one shingle; equal rows form a group; ``keep`` is the smallest id of a group and equal ids are
one document; null ids are left out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm import kernels as K

_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, (2, 512), dtype=np.int64).astype(K.U64)


def signatures(data: np.ndarray, off: np.ndarray, perms: int, bits: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a word, and their signatures as unsigned integers."""
    s, e, woff = K.words(data, off)
    rows = np.flatnonzero(np.diff(woff))
    kind = np.uint8 if bits <= 8 else np.uint16
    sig = np.zeros((len(rows), perms), kind)
    if not len(rows):
        return rows, sig
    h = K.span_hashes(data, s, e)
    lens = np.diff(woff)[rows]
    parts = K.grams(h, shingle)
    take = K.inside(woff, shingle) if len(parts) else np.zeros(0, np.int64)
    whole = rows[lens < shingle]
    doc = np.concatenate([K.rows_of(woff)[take], whole.astype(np.int32)])
    g = np.concatenate([parts[take], K.span_hashes(data, s[woff[whole]], e[woff[whole + 1] - 1])])
    by = np.argsort(doc, kind="stable")
    g, first = g[by], np.searchsorted(doc[by], rows)
    step = 1 << 15
    edges = np.unique(np.concatenate([np.searchsorted(first, np.arange(0, len(g), step)), [len(rows)]]))
    for a, b in zip(edges[:-1], edges[1:]):
        lo, hi = first[a], first[b] if b < len(rows) else len(g)
        part, cut = g[lo:hi], first[a:b] - lo
        for k in range(perms):
            v = (part ^ _SEEDS[1, k]) * (_SEEDS[0, k] | K.U64(1))
            v ^= v >> K.U64(29)
            low = np.minimum.reduceat(v, cut)
            sig[a:b, k] = (low * K.U64(0xD6E8FEB86659FD93) >> K.U64(64 - bits)).astype(kind)
    return rows, sig


def _masks(perms: int, chunks: int, errors: int) -> list[tuple[int, list[int]]]:
    """Each chunk with each set of its places left when ``errors`` of them are masked."""
    edges = [perms * c // chunks for c in range(chunks + 1)]
    out = []
    for c in range(chunks):
        own = range(edges[c], edges[c + 1])
        out += [(c, list(rest)) for rest in combinations(own, max(0, len(own) - errors))]
    return out


def near_groups(
    docs: DataFrame, perms: int = 64, bits: int = 16, chunks: int = 15, max_distance: int = 29, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, keep)`` for every row of a group of two or more: ``keep`` is the one that stays."""
    spark = docs.sparkSession
    K.small_batches(spark)
    errors = max_distance // chunks
    masks = _masks(perms, chunks, errors)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    id_type = docs.schema[0].dataType.simpleString()

    def sign(batches):
        for batch in K.slices(batches, block_bytes=4 << 20):
            data, off = K.utf8(batch.column(1))
            rows, sig = signatures(data, off, perms, bits, shingle)
            yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array([x.tobytes() for x in sig], pa.binary())], ["id", "sig"])

    kind = np.uint8 if bits <= 8 else np.uint16
    width = perms * np.dtype(kind).itemsize

    def matrix(column) -> np.ndarray:
        raw, _ = K.utf8(column)
        return raw.reshape(-1, width).view(kind)

    def keys(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                sig = matrix(part.column(1)).astype(K.U64)
                out = np.empty((len(sig), len(masks)), np.int64)
                for m, (c, places) in enumerate(masks):
                    key = np.full(len(sig), (m + 1) * 0x9E3779B97F4A7C15 % 2**64, K.U64)
                    for p in places:
                        key = K.mix(key ^ sig[:, p]) + K.U64(p)
                    out[:, m] = K.mix(key).view(np.int64)
                yield pa.record_batch([pa.array(np.repeat(part.column(0).to_pandas().to_numpy(), len(masks)), part.column(0).type), pa.array(out.reshape(-1))], ["id", "key"])

    def reach(sig: np.ndarray) -> np.ndarray:
        """The first row of each row's connected group."""
        group = np.full(len(sig), -1)
        left = np.arange(len(sig))
        while len(left):
            head, queue, left = left[0], [left[0]], left[1:]
            group[head] = head
            while queue and len(left):
                near = (sig[left] != sig[queue.pop()]).sum(1) <= max_distance
                group[left[near]] = head
                queue.extend(left[near])
                left = left[~near]
        return group

    def close(batches):
        for batch in batches:
            near = (matrix(batch.column(2)) != matrix(batch.column(3))).sum(1) <= max_distance
            yield pa.record_batch([batch.column(k).filter(pa.array(near)) for k in (0, 1)], ["u", "v"])

    def link(table: pa.Table) -> pa.Table:
        ids, cut = table["id"].combine_chunks(), table["key"].to_numpy()
        sig = matrix(table["sig"])
        by = np.argsort(cut, kind="stable")
        edges = np.append(np.flatnonzero(np.concatenate([[True], cut[by][1:] != cut[by][:-1]])), len(by))
        a, b = [], []
        for i, j in zip(edges[:-1], edges[1:]):
            own = by[i:j]
            to = own[reach(sig[own])]
            moved = to != own
            a.append(own[moved])
            b.append(to[moved])
        K.trim()
        return pa.table({"u": ids.take(pa.array(np.concatenate(a))), "v": ids.take(pa.array(np.concatenate(b)))})

    signed = docs.mapInArrow(sign, f"id {id_type}, sig binary").withColumn("head", F.min("id").over(Window.partitionBy("sig")))
    signed = K.settle(signed)
    heads = signed.filter("id = head").select("id", "sig").dropDuplicates(["id", "sig"])
    copies = signed.filter("id <> head").select(F.col("id").alias("u"), F.col("head").alias("v"))
    under = Window.partitionBy("key")
    keyed = heads.mapInArrow(keys, f"id {id_type}, key long").select("key", "id", F.min("id").over(under).alias("head"), F.count("*").over(under).alias("n"))
    shared = K.settle(keyed.filter("n > 1").drop("n"))
    # under each key every row against the first; a row is joined before its head, of which there may be very many
    stars = shared.filter("id <> head").select("id", "head").distinct().join(heads.withColumnRenamed("sig", "a"), "id").join(heads.select(F.col("id").alias("head"), F.col("sig").alias("b")), "head")
    near = K.settle(stars.select("id", "head", "a", "b").mapInArrow(close, f"u {id_type}, v {id_type}").unionByName(copies))
    # keys whose rows this has not brought into one group: all their rows, the same rows under several keys once
    known = components(near)
    named = shared.join(known, "id", "left").select("key", "id", F.coalesce("keep", "id").alias("group"))
    mark = F.xxhash64(F.lit(1), "id"), F.xxhash64(F.lit(2), "id").cast("decimal(38,0)")
    sets = named.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.bit_xor(mark[0]).alias("m"), F.sum(mark[1]).alias("s"), F.count("*").alias("n")).filter("lo <> hi")
    once = sets.groupBy("m", "s", "n").agg(F.min("key").alias("key")).select("key")
    parts = 4 * K.shuffle_parts(spark)
    members = shared.select("key", "id").join(once, "key").join(heads, "id").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    links = members.groupBy("part").applyInArrow(link, f"u {id_type}, v {id_type}")
    return components(K.settle(links.unionByName(near).distinct())).select(F.col("id").alias(id_col), "keep")


def components(links: DataFrame) -> DataFrame:
    """``(id, keep)`` for every row of links ``(u, v)``: the smallest id of its connected group.

    Large-star and small-star steps in turn: each writes its links, so a lost executor costs no more than a step.
    """
    seen = last = None
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        links = K.settle(joined.select("u", F.col("m").alias("v")).unionByName(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), over=last)
        last = links
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("keep")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("keep")).distinct())
