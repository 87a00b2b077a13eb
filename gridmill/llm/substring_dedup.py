"""Repeated passages: exact repeats of word windows, found through a count-min prefilter.

Pass one: each block of documents makes a count-min sketch of its windows, ``depth`` rows of ``width`` counters for
each shard of the hash range, sent in sparse form (the counters that are not 0, and which of them are more than 1).
The shard merges the sketches of all blocks by adding their counters, so that it can only overestimate, and answers
each block with which of the block's counters have reached two. Pass two groups exactly, by 64-bit hash, only the
windows whose estimate, the least of their counters, is at least two; those that occur in two rows or more are
repeated. No repeated window is lost, because each of its occurrences raises the same counters. Overlapping and
touching repeated windows of a row join into spans.

The number of shards follows the size of the input, so that a shard's sketch stays as full; every sketch stays with its
shard: nothing is broadcast.

Defined results: a row with fewer than ``window`` words (null and blank text too) has no span; equal rows repeat
each other; a window that recurs only within one row is no repeat; an empty table gives no rows; other columns
are ignored; rows with a null id take part and come out with a null id. Words are told apart by case.
``docs`` must be a deterministic scan, as it is read twice; a difference between the readings stops the job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm import kernels as K
from gridmill.llm.lm_scoring import block_key, payload, read_ids, unpayload

SHARD_BYTES = 8 << 20  #: bytes of input for each shard, at most twice as many
_SKETCH = "shard int, block long, sketch binary"
_FLAGS = "block long, kind int, shard int, grams binary, ids binary"
_HITS = "shard int, part int, block long, hashes binary, rows binary, spots binary, ids binary"


def _windows(data: np.ndarray, off: np.ndarray, window: int):
    """Hashes of all windows in hash order, with the row and the place in it of each."""
    s, e, woff = K.words(data, off)
    at = K.inside(woff, window)
    h = K.grams(K.span_hashes(data, s, e), window)[at] if len(at) else np.zeros(0, K.U64)
    by = np.argsort(h, kind="stable")
    at = at[by]
    rows = K.rows_of(woff)[at] if len(at) else np.zeros(0, np.int32)
    return h[by], rows, at - woff[rows] if len(at) else at


def _counters(h: np.ndarray, row: int, shard_bits: int, width_bits: int) -> np.ndarray:
    """The counter of each window in a row of its shard's sketch; the first row keeps the order of the hashes."""
    if row == 0:
        return (h << K.U64(shard_bits)) >> K.U64(64 - width_bits)
    return K.mix(h + K.U64(row * 0x9E3779B97F4A7C15 % 2**64)) >> K.U64(64 - width_bits) if row > 1 else h & K.U64((1 << width_bits) - 1)


def _distinct(c: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
    """The counters in order, each once, and the place among them of each window's."""
    if row:
        return np.unique(c, return_inverse=True)
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    return c[new], np.cumsum(new) - 1


def repeated_spans(docs: DataFrame, window: int = 50, width_bits: int = 23, depth: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, start_word, end_word, n_words)``: maximal spans of words whose windows recur in another row."""
    K.small_batches(docs.sparkSession)
    shard_bits = max(3, (K.input_bytes(docs) // SHARD_BYTES).bit_length())
    shards = 1 << shard_bits
    docs = docs.select(id_col, F.col(text_col).alias("text"))
    id_type = docs.schema[0].dataType.simpleString()

    def sketch(batches):
        for batch in K.slices(batches):
            data, off = K.utf8(batch.column(1))
            h, _, _ = _windows(data, off, window)
            cut = K.shard_bounds(h, shards)
            own = np.flatnonzero(np.diff(cut))
            sketches = []
            for k in own:
                parts = []
                for d in range(depth):
                    c, at = _distinct(_counters(h[cut[k] : cut[k + 1]], d, shard_bits, width_bits), d)
                    packed = K.pack_sorted(c)
                    parts += [len(packed).to_bytes(8, "little"), packed, np.packbits(np.bincount(at) > 1).tobytes()]
                sketches.append(b"".join(parts))
            yield pa.record_batch(
                [pa.array(own, pa.int32()), pa.array(np.full(len(own), block_key(data, off)), pa.int64()), pa.array(sketches, pa.binary())],
                ["shard", "block", "sketch"],
            )

    def rows_of(sketch: bytes):
        """Of each row of a block's sketch the counters and whether they are more than 1."""
        at = 0
        for _ in range(depth):
            end = at + 8 + int.from_bytes(sketch[at : at + 8], "little")
            c = K.unpack_sorted(sketch[at + 8 : end]).astype(np.int64)
            at = end + (len(c) + 7) // 8
            yield c, np.unpackbits(np.frombuffer(sketch[end:at], np.uint8), count=len(c))

    def merge(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        merged = [np.zeros(1 << width_bits, np.uint8) for _ in range(depth)]
        for sketch in table["sketch"]:
            for row, (c, twice) in zip(merged, rows_of(sketch.as_py())):
                row[c] = np.minimum(row[c] + 1 + twice, 2)  # what is beyond 2 doesn't matter
        flags = [K.squeeze(b"".join(np.packbits(row[c] > 1).tobytes() for row, (c, _) in zip(merged, rows_of(sketch.as_py())))) for sketch in table["sketch"]]
        n = len(flags)
        K.trim()
        return pa.table({"block": table["block"], "kind": pa.array([1] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "grams": pa.array(flags, pa.binary()), "ids": pa.nulls(n, pa.binary())})

    def exact(table: pa.Table) -> pa.Table:
        kinds, at = table["kind"].to_numpy(), table["shard"].to_numpy()
        home = np.flatnonzero(kinds == -1)
        if not len(home):
            raise RuntimeError("the two readings of the documents differ; give repeated_spans a table or files")
        data, off = unpayload(table["grams"][int(home[0])].as_py())
        h, rows, spots = _windows(data, off, window)
        mine = np.flatnonzero(kinds == 1)
        mine = mine[np.unique(at[mine], return_index=True)[1]]
        cut = K.shard_bounds(h, shards)
        keep = np.ones(len(h), bool)
        own = np.flatnonzero(np.diff(cut))
        if list(at[mine]) != list(own):
            raise RuntimeError("the two readings of the documents differ; give repeated_spans a table or files")
        for k, i in zip(own, mine):
            raw, place = np.frombuffer(K.expand(table["grams"][int(i)].as_py()), np.uint8), 0
            for d in range(depth):
                c, where = _distinct(_counters(h[cut[k] : cut[k + 1]], d, shard_bits, width_bits), d)
                upto = place + (len(c) + 7) // 8
                if upto > len(raw):
                    raise RuntimeError("the two readings of the documents differ; give repeated_spans a table or files")
                keep[cut[k] : cut[k + 1]] &= np.unpackbits(raw[place:upto], count=len(c)).astype(bool)[where]
                place = upto
        h, rows, spots = h[keep], rows[keep], spots[keep]
        block = table["block"][0].as_py()
        cut = K.shard_bounds(h, shards)
        out = {k: [] for k in ("shard", "part", "block", "hashes", "rows", "spots", "ids")}
        for copy, i in enumerate(home):
            for k in np.flatnonzero(np.diff(cut)):
                a, b = cut[k], cut[k + 1]
                for key, v in zip(out, (k, copy, block, K.pack_sorted(h[a:b]), K.pack(rows[a:b].astype(K.U64)), K.pack(spots[a:b].astype(K.U64)), None)):
                    out[key].append(v)
            for key, v in zip(out, (block % shards, copy, block, None, None, None, table["ids"][int(i)].as_py())):
                out[key].append(v)
        return pa.table([pa.array(out[k], t) for k, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], list(out))

    def group(table: pa.Table) -> pa.Table:
        carried = table.filter(table["ids"].is_valid())
        table = table.filter(table["ids"].is_null())
        if not table.num_rows:
            return carried
        hashes = [K.unpack_sorted(x.as_py()) for x in table["hashes"]]
        source = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        rows = np.concatenate([K.unpack(x.as_py()) for x in table["rows"]]).astype(np.int64)
        spots = np.concatenate([K.unpack(x.as_py()) for x in table["spots"]])
        h = np.concatenate(hashes)
        by = np.argsort(h, kind="stable")
        h, source, rows, spots = h[by], source[by], rows[by], spots[by]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        other = (source != source[first][run]) | (rows != rows[first][run])  # a run has two rows if any differs from its first
        twice = np.zeros(len(first), bool)
        twice[run[other]] = True
        keep = twice[run]
        source, rows, spots = source[keep], rows[keep], spots[keep]
        by = np.lexsort((spots, rows, source))
        source, rows, spots = source[by], rows[by], spots[by]
        cut = np.searchsorted(source, np.arange(len(hashes) + 1))
        own = np.flatnonzero(np.diff(cut))
        part, block = table["part"].to_numpy()[own], table["block"].to_numpy()[own]
        n = len(own)
        found = pa.table(
            [
                pa.array(np.zeros(n, np.int32)), pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.nulls(n, pa.binary()),
                pa.array([K.pack(rows[cut[k] : cut[k + 1]].astype(K.U64)) for k in own], pa.binary()), pa.array([K.pack(spots[cut[k] : cut[k + 1]]) for k in own], pa.binary()), pa.nulls(n, pa.binary()),
            ],
            table.column_names,
        )
        return pa.concat_tables([found.cast(carried.schema), carried])

    def spans(table: pa.Table) -> pa.Table:
        has_ids = table["ids"].is_valid().to_numpy()
        ids = read_ids(table["ids"][int(np.flatnonzero(has_ids)[0])].as_py()).combine_chunks()
        mine = np.flatnonzero(~has_ids)
        if not len(mine):
            return pa.table({"id": ids[:0], "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        rows = np.concatenate([K.unpack(table["rows"][int(i)].as_py()) for i in mine]).astype(np.int64)
        spots = np.concatenate([K.unpack(table["spots"][int(i)].as_py()) for i in mine]).astype(np.int64)
        by = np.lexsort((spots, rows))
        rows, spots = rows[by], spots[by]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (spots[1:] > spots[:-1] + window)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(rows)) - 1
        return pa.table({"id": ids.take(pa.array(rows[first])), "a": pa.array(spots[first]), "b": pa.array(spots[last] + window)})

    flags = docs.mapInArrow(sketch, _SKETCH).groupBy("shard").applyInArrow(merge, _FLAGS)
    kept = flags.unionByName(docs.mapInArrow(payload, _FLAGS)).groupBy("block").applyInArrow(exact, _HITS)
    repeated = kept.groupBy("shard").applyInArrow(group, _HITS)
    joined = repeated.groupBy("block", "part").applyInArrow(spans, f"id {id_type}, a long, b long")
    return joined.select(F.col("id").alias(id_col), F.col("a").alias("start_word"), F.col("b").alias("end_word"), (F.col("b") - F.col("a")).alias("n_words"))


SQL = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) i FROM t WHERE len(w) >= 50)),
r AS (SELECT doc_id, i FROM v JOIN (SELECT h FROM v GROUP BY h HAVING count(DISTINCT doc_id) > 1) USING (h)),
g AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END n FROM r),
k AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) k FROM g)
SELECT doc_id, CAST(min(i) AS BIGINT) AS start_word, CAST(max(i) + 50 AS BIGINT) AS end_word, CAST(max(i) + 50 - min(i) AS BIGINT) AS n_words FROM k GROUP BY doc_id, k
"""
