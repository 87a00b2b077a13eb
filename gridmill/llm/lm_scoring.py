"""Stupid-backoff scores of every document under the n-gram counts of all the other documents.

Count tables are partitioned by n-gram hash. A block of documents sends each shard the distinct n-grams it
holds (with its counts); the shard makes its part of the count table of them (``count_table``) and joins it to the
n-grams of each block (``joined``), and the block joins the totals to its exploded n-grams and sums per document.
Table and join are held in packed columns and done where the shard is: as rows of an n-gram each, written once for
the table and once more for the join, they would need more disk than the documents several times over. The number
of shards follows the size of the input, so that a shard stays as large; nothing is broadcast or collected.

The score of a word is the relative frequency of its longest n-gram found in *other* documents (a document's
own counts are taken off), times ``alpha`` for every order given up. A word found in no other document scores
``alpha / N`` after the same discounts, N being the number of words in the corpus.

Defined results: null or blank text gives 0 words and a null score; equal rows are documents of their own and
see each other's counts; an empty table gives no rows; columns other than ``id_col`` and ``text_col`` are
ignored; null ids are carried through. ``docs`` must be a deterministic scan (a table or files): it is read
twice, and a block whose two readings differ stops the job instead of giving a wrong score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm import kernels as K

SHARD_BYTES = 5 << 20  #: bytes of input for each shard
_ASK = "shard int, block long, ord int, grams binary, counts binary"
_REPLY = "block long, kind int, shard int, grams binary, ids binary"


def block_key(data: np.ndarray, off: np.ndarray) -> int:
    """Names a block by its texts, the same in every reading; equal blocks share their name."""
    part = K.mix(K.span_hashes(data, off[:-1], off[1:]) + np.arange(len(off) - 1, dtype=K.U64))
    return int(np.bitwise_xor.reduce(part, initial=K.U64(len(off)))) >> 1


def _ids(column) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", column.type)])) as w:
        w.write_batch(pa.record_batch([column], ["id"]))
    return K.squeeze(sink.getvalue().to_pybytes())


def read_ids(raw: bytes):
    return pa.ipc.open_stream(K.expand(raw)).read_all().column(0)


def _texts(data: np.ndarray, off: np.ndarray) -> bytes:
    lens = K.pack(np.diff(off))
    return K.squeeze(len(lens).to_bytes(8, "little") + lens + data.tobytes())


def payload(batches):
    """One row per block: its text and ids, compressed."""
    for batch in K.slices(batches):
        data, off = K.utf8(batch.column(1))
        yield pa.record_batch(
            [
                pa.array([block_key(data, off)], pa.int64()), pa.array([-1], pa.int32()), pa.array([0], pa.int32()),
                pa.array([_texts(data, off)], pa.binary()), pa.array([_ids(batch.column(0))], pa.binary()),
            ],
            ["block", "kind", "shard", "grams", "ids"],
        )


def unpayload(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = K.expand(raw)
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(raw, np.uint8)[8 + n :], np.concatenate([[0], np.cumsum(K.unpack(raw[8 : 8 + n]))]).astype(np.int64)


def _keys(h: np.ndarray, woff: np.ndarray, n: int) -> np.ndarray:
    """The n-gram at each place, by the upper 56 bits of its hash (two of 10**10 n-grams meet with a chance of one in 10**7)."""
    g = K.grams(h, n)
    return g[K.inside(woff, n)] & K.U64(2**64 - 256) if len(g) else g


def count_table(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all blocks in order, each once, and how often the corpus has them."""
    key = np.concatenate(grams)
    by = np.argsort(key, kind="stable")
    key = key[by]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new], np.add.reduceat(np.concatenate(counts)[by], new)


def joined(grams: list[np.ndarray], table: np.ndarray, totals: np.ndarray):
    """For each block the corpus counts of its n-grams."""
    for g in grams:
        yield totals[np.searchsorted(table, g)]


def score_documents(docs: DataFrame, order: int = 3, alpha: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, score)`` for every row: the mean log10 stupid-backoff score of its words."""
    K.small_batches(docs.sparkSession)
    shards = max(8, K.input_bytes(docs) // SHARD_BYTES)
    docs = docs.select(id_col, F.col(text_col).alias("text"))
    id_type = docs.schema[0].dataType.simpleString()

    def ask(batches):
        for batch in K.slices(batches):
            data, off = K.utf8(batch.column(1))
            key = block_key(data, off)
            s, e, woff = K.words(data, off)
            h = K.span_hashes(data, s, e)
            for n in range(1, order + 1):
                g, c = np.unique(_keys(h, woff, n), return_counts=True)
                cut = K.shard_bounds(g, shards)
                own = np.flatnonzero(np.diff(cut))
                yield pa.record_batch(
                    [
                        pa.array(own, pa.int32()), pa.array(np.full(len(own), key), pa.int64()), pa.array(np.full(len(own), n), pa.int32()),
                        pa.array([K.pack_sorted(g[cut[k] : cut[k + 1]] >> K.U64(8)) for k in own], pa.binary()), pa.array([K.pack(c[cut[k] : cut[k + 1]].astype(K.U64)) for k in own], pa.binary()),
                    ],
                    ["shard", "block", "ord", "grams", "counts"],
                )

    def total(table: pa.Table) -> pa.Table:
        out, shard = [], table["shard"][0].as_py()
        blocks, orders = table["block"].to_numpy(), table["ord"].to_numpy()
        grams, counts = table["grams"].to_pylist(), table["counts"].to_pylist()
        for n in np.unique(orders):
            at = np.flatnonzero(orders == n)
            each = [K.unpack_sorted(grams[i]) for i in at]
            found = joined(each, *count_table(each, [K.unpack(counts[i]) for i in at]))
            out += [(int(blocks[i]), int(n), shard, K.pack(x)) for i, x in zip(at, found)]
        b, n, k, p = zip(*out)
        K.trim()
        return pa.table({"block": pa.array(b, pa.int64()), "kind": pa.array(n, pa.int32()), "shard": pa.array(k, pa.int32()), "grams": pa.array(p, pa.binary()), "ids": pa.nulls(len(b), pa.binary())})

    def score(table: pa.Table) -> pa.Table:
        kinds, at = table["kind"].to_numpy(), table["shard"].to_numpy()
        home = np.flatnonzero(kinds == -1)
        if not len(home):
            raise RuntimeError("the two readings of the documents differ; give score_documents a table or files")
        data, off = unpayload(table["grams"][int(home[0])].as_py())
        s, e, woff = K.words(data, off)
        h, rows = K.span_hashes(data, s, e), K.rows_of(woff)
        size, place = len(h), np.arange(len(h)) - woff[rows]
        others = []  # by order, for the run that ends at each word: how often other documents hold it
        ctx_total = []
        for n in range(1, order + 1):
            start = K.inside(woff, n) if size >= n else np.zeros(0, np.int64)
            mine = np.flatnonzero(kinds == n)
            mine = mine[np.unique(at[mine], return_index=True)[1]]  # equal blocks get equal answers
            totals = [K.unpack(table["grams"][int(i)].as_py()) for i in mine]
            totals = np.concatenate(totals) if totals else np.zeros(0, K.U64)
            g, inv = np.unique(_keys(h, woff, n), return_inverse=True)
            if len(g) != len(totals):
                raise RuntimeError("the two readings of the documents differ; give score_documents a table or files")
            _, inv2, own = np.unique(inv * np.int64(len(off)) + rows[start], return_inverse=True, return_counts=True)
            rest = totals[inv].astype(np.int64) - own[inv2]
            full = np.zeros(size, np.int64)
            full[start + n - 1] = rest
            others.append(full)
            ctx_total.append(full)
        log = np.zeros(size)
        level = np.zeros(size, np.int64)  # the order that a word is scored at; 0: unseen elsewhere
        for n in range(order, 1, -1):
            ctx = np.zeros(size, np.int64)
            ctx[1:] = ctx_total[n - 2][:-1]
            hit = (level == 0) & (place >= n - 1) & (others[n - 1] > 0)
            log[hit] = np.log10(others[n - 1][hit] / ctx[hit])
            level[hit] = n
        hit = (level == 0) & (others[0] > 0)
        log[hit] = np.log10(others[0][hit])
        level[hit] = 1
        tried = np.minimum(place + 1, order)
        log += (tried - level) * np.log10(alpha)
        counts = np.diff(woff)
        sums = np.bincount(rows, log, minlength=len(counts)).astype(float)
        low = np.bincount(rows, (level <= 1).astype(float), minlength=len(counts)).astype(float)
        ids = [read_ids(table["ids"][int(i)].as_py()) for i in home]
        return pa.concat_tables(pa.table({"id": x, "n": pa.array(counts, pa.int64()), "sums": pa.array(sums, pa.float64()), "low": pa.array(low, pa.float64())}) for x in ids)

    asked = docs.mapInArrow(ask, _ASK)
    replies = asked.groupBy("shard").applyInArrow(total, _REPLY)
    found = replies.unionByName(docs.mapInArrow(payload, _REPLY)).groupBy("block").applyInArrow(score, f"id {id_type}, n long, sums double, low double")
    found = K.settle(found)
    corpus = found.agg(F.sum("n").alias("total"))
    return found.crossJoin(F.broadcast(corpus)).select(
        F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.round(F.when(F.col("n") > 0, (F.col("sums") - F.col("low") * F.log10("total")) / F.col("n")), 4).alias("score")
    )


SQL = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') w FROM documents),
tok AS (SELECT doc_id, i, w[i] w1, CASE WHEN i > 1 THEN w[i-1] END w2, CASE WHEN i > 2 THEN w[i-2] END w3
        FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) i FROM t)),
c1 AS (SELECT w1, count(*) c FROM tok GROUP BY ALL), d1 AS (SELECT doc_id, w1, count(*) c FROM tok GROUP BY ALL),
c2 AS (SELECT w2, w1, count(*) c FROM tok WHERE i > 1 GROUP BY ALL), d2 AS (SELECT doc_id, w2, w1, count(*) c FROM tok WHERE i > 1 GROUP BY ALL),
c3 AS (SELECT w3, w2, w1, count(*) c FROM tok WHERE i > 2 GROUP BY ALL), d3 AS (SELECT doc_id, w3, w2, w1, count(*) c FROM tok WHERE i > 2 GROUP BY ALL),
j AS (SELECT tok.doc_id, tok.i, c1.c - d1.c k1, c2.c - d2.c k2, c3.c - d3.c k3, p1.c - q1.c x1, p2.c - q2.c x2
  FROM tok JOIN c1 USING (w1) JOIN d1 USING (doc_id, w1)
  LEFT JOIN c2 ON tok.w2 = c2.w2 AND tok.w1 = c2.w1 LEFT JOIN d2 ON tok.doc_id = d2.doc_id AND tok.w2 = d2.w2 AND tok.w1 = d2.w1
  LEFT JOIN c3 ON tok.w3 = c3.w3 AND tok.w2 = c3.w2 AND tok.w1 = c3.w1 LEFT JOIN d3 ON tok.doc_id = d3.doc_id AND tok.w3 = d3.w3 AND tok.w2 = d3.w2 AND tok.w1 = d3.w1
  LEFT JOIN c1 p1 ON tok.w2 = p1.w1 LEFT JOIN d1 q1 ON tok.doc_id = q1.doc_id AND tok.w2 = q1.w1
  LEFT JOIN c2 p2 ON tok.w3 = p2.w2 AND tok.w2 = p2.w1 LEFT JOIN d2 q2 ON tok.doc_id = q2.doc_id AND tok.w3 = q2.w2 AND tok.w2 = q2.w1),
s AS (SELECT doc_id, CASE WHEN k3 > 0 THEN log10(k3 / x2) WHEN k2 > 0 THEN log10(k2 / x1) + (least(i, 3) - 2) * log10(0.4)
    WHEN k1 > 0 THEN log10(k1 / (SELECT count(*) FROM tok)) + (least(i, 3) - 1) * log10(0.4)
    ELSE least(i, 3) * log10(0.4) - log10((SELECT count(*) FROM tok)) END v FROM j)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_tokens, m AS score
FROM t LEFT JOIN (SELECT doc_id, round(avg(v), 4) m FROM s GROUP BY doc_id) a USING (doc_id)
"""
