"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, and its perplexities.

The model is over bytes, ``order`` of them (5 at most). All rows labelled good are counted, and all of them set the
thresholds: a language's trusted texts are cut in two by a bit of their hash (the first that not all of them share), each
half makes a model, and every text, trusted or not, is scored by the model of the half that it doesn't belong to, so
that no text is judged by itself or by an equal one. ``train_rows``, if given, bounds the training instead: one model of each
language, of every second one of its first ``train_rows`` in the order of a hash of the id, and thresholds of the rest.

Counting is sharded, a shard being the n-grams with some pairs of bytes before the last. The n-grams of a task go to
their shards in packed columns and are added up there. Continuation counts, contexts and back-off weights from three
bytes on are the shard's own; those of one and two bytes, and the discounts, are tables of all shards' sums, and go to
every shard. Together they give shares ``max(c - D, 0) / total`` and weights ``gamma``, of which the interpolated
probability of an n-gram is ``p_n = share_n + gamma_n p_(n-1)``, from ``p_0 = 1/256`` (an unseen context: ``gamma`` 1).

Scoring is a sharded join. A block of documents sends each shard of the model the distinct n-grams it holds. Where a
shard's n-grams meet the shard's table their log-probabilities are summed up by the recursion above and go back to the
block, which has been shuffled along with its columns; it sums them per document. Shards are cut further by a hash of
the block as the input grows, each with a copy of its part of the model; nothing is broadcast or collected but
the names of the languages and, up to ``kernels.MEMBERS`` of them, the ids of trusted rows (beyond, their texts are joined).

A row is rejected above the threshold of its language: the ``quantile`` of the bits per byte (to four digits) of all
rows labelled good (with ``train_rows``: of those that the counts don't come from).

Defined results: null or empty text has a null perplexity and is kept, as is text in a language (or of null
language) that has no two different trusted texts (with ``train_rows``: none in the sample or none outside it); any number of languages up to 2**22 (more raise an error); a label table
may repeat ids (all of a row's labels must be good) and may name ids that have no document; equal rows get equal
results; an empty table gives no rows; other columns are ignored by ``perplexities`` and carried by ``keep_good``.
``docs`` must be a deterministic scan (a table or files), as it is read several times; a difference between the readings stops
the job.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm import kernels as K
from gridmill.llm.lm_scoring import count_table

_PAD = 10
_SHARDS = 64
_PIECE = 256 << 10  #: bytes of a carried block in a row: larger ones would each be an allocation of its own on the heap
_HELD = 1 << 19  #: n-grams and their counts that a task adds up before it sends them or merges them
_COUNTED = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("c", pa.int64()), ("often", pa.list_(pa.int64())), ("grams", pa.binary()), ("counts", pa.binary())])
_ANSWERS = "block long, home long, part int, body binary"


def byte_grams(data: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """For each byte the ``order`` bytes that end there as one integer; rows are preceded by line feeds."""
    wide = data.astype(K.U64)
    key = np.zeros(len(data), K.U64)
    for j in range(order - 1, 0, -1):
        key <<= K.U64(8)
        key[j:] |= wide[: len(wide) - j] if j < len(wide) else wide[:0]
    key = (key << K.U64(8)) | wide
    lens = np.diff(off)
    for r in range(order - 1):
        at = off[:-1][lens > r] + r
        k = np.zeros(len(at), K.U64)
        for j in range(order - 1, -1, -1):
            k = (k << K.U64(8)) | (wide[at - j] if j <= r else K.U64(_PAD))
        key[at] = k
    return key


def gram_parts(data: np.ndarray, off: np.ndarray, order: int, step: int = 1 << 20):
    """``(a, b, byte_grams of the bytes from a to b)``, part by part, so that a very long row costs no more memory."""
    for a in range(0, len(data), step):
        b, lo = min(a + step, len(data)), max(0, a - order + 1)
        yield a, b, byte_grams(data[lo:b], np.unique(np.concatenate([[lo], np.clip(off, lo, b)])) - lo, order)[a - lo :]


def _discount(i: int) -> Column:
    """The discount of a count of ``i``, from the numbers of n-grams counted once to four times."""
    n = {k: F.greatest(F.lit(1.0), F.col(f"n{k}").cast("double")) for k in range(1, 5)}
    y = n[1] / (n[1] + 2 * n[2])
    return F.least(F.greatest(i - (i + 1) * y * n[i + 1] / n[i], F.lit(0.01)), F.lit(float(i)))


def codes(plan: dict, langs: list, data: np.ndarray, off: np.ndarray, other: bool) -> np.ndarray:
    """The model of each text (-1: none): that of its language's half, or of the other half; a plan has each language's place and the bit that tells halves (-1: one model)."""
    place, bit = np.array([plan.get(x, (-1, -1)) for x in langs], np.int64).reshape(-1, 2).T
    side = (K.span_hashes(data, off[:-1], off[1:]) >> np.maximum(bit, 0).astype(K.U64)).astype(np.int64) & 1 ^ int(other)
    return np.where(place < 0, -1, 2 * place + np.where(bit < 0, 0, side))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, each once, with the sums of their counts."""
    parts = [x for x in parts if len(x[0])]
    return count_table([k for k, _ in parts], [c for _, c in parts]) if parts else (np.zeros(0, K.U64), np.zeros(0, np.int64))


def counted(trusted, plan: dict, order: int) -> DataFrame:
    """From rows ``(lang, text)``, given by their ``mapInArrow``, and for each shard: its n-grams and counts packed (kind 0); for each model and length from three on how many occur once to four times (kind 1); its part of the counts of up to two bytes (kind 2)."""

    def sent(key, n):
        shard = _shard(_pair(key))
        by = np.argsort(shard, kind="stable")
        key, n = key[by], n[by]
        cut = np.searchsorted(shard[by], np.arange(_SHARDS + 1))
        own = np.flatnonzero(np.diff(cut))
        packed = [[f(x[cut[k] : cut[k + 1]].astype(K.U64)) for k in own] for f, x in ((K.pack_sorted, key), (K.pack, n))]
        return pa.record_batch([pa.array(own, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], ["shard", "grams", "counts"])

    def count(batches):
        parts, size = [], 0
        for batch in K.slices(batches, 1, 1 << 20):
            data, off = K.utf8(batch.column(1))
            own = np.repeat(codes(plan, batch.column(0).to_pylist(), data, off, False), np.diff(off))
            for a, b, key in gram_parts(data, off, order):
                known = own[a:b] >= 0
                parts.append(np.unique(key[known] | own[a:b][known].astype(K.U64) << K.U64(40), return_counts=True))
                size += len(parts[-1][0])
            if size > _HELD:
                parts = [merged(parts)]
                size = len(parts[0][0])
                if size > _HELD // 2:
                    yield sent(*parts[0])
                    parts, size = [], 0
        yield sent(*merged(parts))
        parts.clear()
        K.trim()

    def add(table: pa.Table) -> pa.Table:
        parts, size = [], 0
        for g, c in zip(table["grams"], table["counts"]):
            parts.append((K.unpack_sorted(g.as_py()), K.unpack(c.as_py()).astype(np.int64)))
            size += len(parts[-1][0])
            if size > _HELD:
                parts, size = [merged(parts)], 0
        key, c = merged(parts)
        out = [{"kind": 0, "shard": table["shard"][0].as_py(), "grams": K.pack_sorted(key), "counts": K.pack(c.astype(K.U64))}]
        low = key, c
        for n, k, c in levels(key, c, order):
            models, at = np.unique(k >> K.U64(40), return_inverse=True)
            often = [np.bincount(at, c == i, len(models)).astype(int) for i in range(1, 5)]
            out += [{"kind": 1, "n": n, "key": int(m), "often": [int(x[i]) for x in often]} for i, m in enumerate(models)]
            low = np.unique(_low(k, 2), return_counts=True)
        out += [{"kind": 2, "key": int(k), "c": int(c)} for k, c in zip(*low)]
        K.trim()
        return pa.Table.from_pylist(out, _COUNTED)

    return K.settle(trusted(count, "shard int, grams binary, counts binary").groupBy("shard").applyInArrow(add, "kind int, shard int, n int, key long, c long, often array<long>, grams binary, counts binary"))


def levels(key: np.ndarray, c: np.ndarray, order: int):
    """``(n, n-grams, counts)`` of a shard from the order down to three; below the order the counts are of the bytes before."""
    for n in range(order, 2, -1):
        if n < order:
            key, c = np.unique(_low(key, n), return_counts=True)
        yield n, key, c


def _low(key: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes of n-grams, with their model."""
    return key & (K.U64((1 << 8 * n) - 1) | ~K.U64((1 << 40) - 1))


def few_tables(counts: DataFrame, order: int) -> DataFrame:
    """``(n, kind, key, v)`` for every shard: shares (kind 0) and weights (kind 1) of up to two bytes, and from three on the discounts of the counts 1, 2 and 3 or more (kinds 2 to 4) by model."""
    model = F.shiftright("key", 40)
    seen = counts.filter("kind = 1").groupBy(F.col("key").alias("model"), "n").agg(*(F.sum(F.col("often")[i - 1]).alias(f"n{i}") for i in range(1, 5)))
    names = [f"d{i}" for i in range(1, 4)]
    cuts = lambda t: t.select("model", "n", *(_discount(i).alias(d) for i, d in enumerate(names, 1)))
    longer = cuts(seen).select("n", F.posexplode(F.array(*names)).alias("kind", "v"), F.col("model").alias("key")).select("n", F.expr("kind + 2").alias("kind"), "key", "v")
    low = K.settle(counts.filter("kind = 2").groupBy("key").agg(F.sum("c").alias("c")).withColumn("n", F.lit(min(order, 2))))
    if order > 1:
        one = F.shiftleft(model, 40).bitwiseOR(F.col("key").bitwiseAND(F.lit(255).cast("long")))
        low = low.unionByName(low.groupBy(one.alias("key")).agg(F.count("*").alias("c")).withColumn("n", F.lit(1)))
    short = low.groupBy(model.alias("model"), "n").agg(*(F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in range(1, 5)))
    cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    ctx = F.shiftleft("model", 40).bitwiseOR(F.shiftright(F.col("key").bitwiseAND(F.lit((1 << 40) - 1).cast("long")), 8))
    rows = low.withColumn("model", model).join(cuts(short), ["model", "n"]).select("n", "key", "c", ctx.alias("ctx"), cut.alias("cut"))
    contexts = rows.groupBy("n", "ctx").agg((F.sum("cut") / F.sum("c")).alias("gamma"), F.sum("c").alias("total"))
    shares = rows.join(contexts, ["n", "ctx"]).select("n", F.lit(0).alias("kind"), "key", ((F.col("c") - F.col("cut")) / F.col("total")).alias("v"))
    weights = contexts.select("n", F.lit(1).alias("kind"), F.col("ctx").alias("key"), F.col("gamma").alias("v"))
    return K.settle(shares.unionByName(weights).unionByName(longer))


def shard_table(table: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``n, kind, key, v`` of a shard, of its rows of ``few_tables`` and of its packed counts."""
    packed = [i for i, x in enumerate(table["grams"].is_valid().to_pylist()) if x]
    few_ = table.filter(table["grams"].is_null())
    n, kind, key, v = (few_[c].to_numpy() for c in ("n", "kind", "key", "v"))
    key = key.astype(K.U64)
    own = np.flatnonzero(kind >= 2)
    own = own[np.argsort(key[own] << K.U64(6) | (n[own] << 3 | kind[own]).astype(K.U64))]
    names, cut = key[own] << K.U64(6) | (n[own] << 3 | kind[own]).astype(K.U64), v[own]
    out = [(n[kind < 2], kind[kind < 2], key[kind < 2], v[kind < 2])]
    for i in packed:
        grams, counts = K.unpack_sorted(table["grams"][i].as_py()), K.unpack(table["counts"][i].as_py()).astype(np.int64)
        for k, g, c in levels(grams, counts, order):
            d = cut[np.searchsorted(names, (g >> K.U64(40)) << K.U64(6) | K.U64(k << 3) | (1 + np.minimum(c, 3)).astype(K.U64))]
            ctx, at = np.unique((g & K.U64((1 << 40) - 1)) >> K.U64(8) | g >> K.U64(40) << K.U64(40), return_inverse=True)
            total = np.bincount(at, c, len(ctx))
            out.append((np.full(len(g), k), np.zeros(len(g), int), g, (c - d) / total[at]))
            out.append((np.full(len(ctx), k), np.ones(len(ctx), int), ctx, np.bincount(at, d, len(ctx)) / total))
    return tuple(np.concatenate(x) for x in zip(*out))


def train_tables(sample: DataFrame, names: list[str], order: int) -> DataFrame:
    """The whole model as rows ``(n, kind, key, v)``, from rows ``(lang, text)``: the share (kind 0) of each n-gram and the weight (kind 1) of each context.

    A key has twice the place of the language among the names above its 40 bits of bytes.
    """
    counts = counted(sample.mapInArrow, {x: (i, -1) for i, x in enumerate(names)}, order)
    table = few_tables(counts, order)
    longer = table.filter("kind >= 2").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(_SHARDS - 1))))

    def unpacked(asked: pa.Table, table: pa.Table) -> pa.Table:
        return pa.table([pa.array(x, t) for x, t in zip(shard_table(table, order), (pa.int32(), pa.int32(), pa.int64(), pa.float64()))], ["n", "kind", "key", "v"])

    parts = counts.filter("kind = 0")
    rows = _placed(longer, parts).groupBy("shard")
    return table.filter("kind < 2").unionByName(parts.select("shard").groupBy("shard").cogroup(rows).applyInArrow(unpacked, "n int, kind int, key long, v double"))


def _placed(few_rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of both tables ``(shard, n, kind, key, v, grams, counts)``."""
    none = F.lit(None).cast("binary")
    rows = few_rows.select("shard", "n", "kind", "key", "v", none.alias("grams"), none.alias("counts"))
    return rows.unionByName(parts.select("shard", F.lit(0).alias("n"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("v"), "grams", "counts"))


def few(table: DataFrame, names: dict) -> DataFrame:
    """A table of some rows for each language, to be broadcast if the languages are few enough."""
    return F.broadcast(table) if len(names) <= 100_000 else table


def log2_of(grams: np.ndarray, n: np.ndarray, kind: np.ndarray, key: np.ndarray, v: np.ndarray, order: int) -> np.ndarray:
    """log2 of the probability of each n-gram's last byte; the language is above the 40 bits of bytes, in grams and keys."""
    p = np.full(len(grams), 1 / 256)
    lang = grams >> K.U64(40) << K.U64(40)
    for k in range(1, order + 1):
        own = grams & K.U64((1 << 8 * k) - 1)
        for kind_, probe in ((1, own >> K.U64(8) | lang), (0, own | lang)):
            at = np.flatnonzero((n == k) & (kind == kind_))
            if not len(at):
                continue
            at = at[np.argsort(key[at])]
            i = np.minimum(np.searchsorted(key[at], probe), len(at) - 1)
            hit = key[at][i] == probe
            found = v[at][i]
            p = np.where(hit, p * found if kind_ else p + found, p)
    return np.log2(p)


def _good(labels: DataFrame, id_col: str) -> DataFrame:
    return labels.groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("q")).filter("q = 1 AND id IS NOT NULL").select("id")


def _trusted(docs: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    return docs.join(_good(labels, id_col), "id", "left_semi").filter("lang IS NOT NULL")


def _training_ids(trusted: DataFrame, train_rows: int) -> DataFrame:
    """``(id)`` of the rows that the counts come from; no more than half of train_rows a language."""
    spot = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("id").cast("string")), "id")
    ranked = trusted.select("id", "lang").distinct().withColumn("k", F.row_number().over(spot)).filter(F.col("k") <= train_rows)
    return K.settle(ranked.filter("k % 2 = 0").select("id").distinct())


def _plan(trusted, halves: bool) -> dict[str, tuple[int, int]]:
    """The place of each language of ``(lang, text)``, given by their ``mapInArrow``, and the first bit of their texts' hashes that differs, to be told halves by; -1 if there are none."""

    def hashed(batches):
        for batch in K.slices(batches, 1, 1 << 20):
            data, off = K.utf8(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(K.span_hashes(data, off[:-1], off[1:]).view(np.int64))], ["lang", "h"])

    differ = F.bit_or("h").bitwiseXOR(F.bit_and("h")) if halves else F.lit(0)
    sample = trusted(hashed, "lang string, h long").groupBy("lang").agg(differ.alias("differ"))
    if halves:
        sample = sample.filter("differ <> 0")
    found = sorted((r.lang, r.differ) for r in sample.limit((1 << 22) + 1).collect())
    if len(found) > 1 << 22:
        raise ValueError("the trusted rows have more than 2**22 languages")
    return {x: (i, (d & -d).bit_length() - 1) for i, (x, d) in enumerate(found)}


def _pair(key: np.ndarray) -> np.ndarray:
    """The model and the two bytes before the last of n-grams."""
    return (key >> K.U64(40) << K.U64(16)) | (key >> K.U64(8) & K.U64(0xFFFF))


def _shard(pair: np.ndarray) -> np.ndarray:
    """The shard of each n-gram, by its model and the two bytes before the last."""
    return (K.mix(pair + K.U64(1)) % K.U64(_SHARDS)).astype(np.int32)


def _scored(docs: DataFrame, plan: dict, counts: DataFrame, order: int, lang_col: str, text_col: str) -> DataFrame:
    """``docs`` with one more column, last: the bits per byte; null where there is no model or text."""
    at, here = docs.columns.index(text_col), docs.columns.index(lang_col)
    columns, bits_col = docs.columns, K.fresh(docs, "_bits")
    salts = 1 + (K.input_bytes(docs) >> 33)
    plain, schema = K.numbered(docs)

    def blocks(batches):
        """Slices with the name of each, its text and its rows' models (-1: none)."""
        for batch in K.slices(batches, at):
            data, off = K.utf8(batch.column(at))
            code = codes(plan, batch.column(here).to_pylist(), data, off, True)
            yield (batch, *block(data, off, code))

    def block(data, off, code):
        rows = K.mix(K.mix(K.span_hashes(data, off[:-1], off[1:]) ^ K.mix(code.astype(K.U64))) + np.arange(len(code), dtype=K.U64))
        return int(np.bitwise_xor.reduce(rows, initial=K.U64(len(rows)))) >> 1, data, off, code

    def indexed(data, off, code):
        """The block's distinct n-grams in order of shard, and for each part of the text its bounds and the places of its n-grams among them (-1: no language)."""
        dictionaries, parts = [], []
        for a, b, key in gram_parts(data, off, order):
            own = np.repeat(code, np.clip(off[1:], a, b) - np.clip(off[:-1], a, b))
            coded = pa.array(key | np.where(own < 0, 0, own).astype(K.U64) << K.U64(40), mask=own < 0).dictionary_encode()
            dictionaries.append(coded.dictionary.to_numpy(zero_copy_only=False).astype(K.U64))
            parts.append((a, b, coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)))
        grams, inverse = np.unique(np.concatenate(dictionaries) if dictionaries else np.zeros(0, K.U64), return_inverse=True)
        shard = _shard(_pair(grams))
        by = np.argsort(shard, kind="stable")
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        cut = np.cumsum([0] + [len(d) for d in dictionaries])
        return grams[by], shard[by], [(a, b, i, place[inverse[lo:hi]]) for (a, b, i), lo, hi in zip(parts, cut[:-1], cut[1:])]

    def ask(batches):
        for _, name, data, off, code in blocks(batches):
            grams, shard, _ = indexed(data, off, code)
            cut = np.searchsorted(shard, np.arange(_SHARDS + 1))
            own = np.flatnonzero(np.diff(cut))
            packed = [K.pack_sorted(grams[cut[k] : cut[k + 1]]) for k in own]
            yield pa.record_batch([pa.array(own, pa.int32()), pa.array([name] * len(own), pa.int64()), pa.array(packed, pa.binary())], ["shard", "block", "grams"])

    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        grams = [K.unpack_sorted(x.as_py()) for x in asked["grams"]]
        u, inverse = np.unique(np.concatenate(grams) if grams else np.zeros(0, K.U64), return_inverse=True)
        value = log2_of(u, *shard_table(table, order), order).astype(np.float32)[inverse]
        cut = np.cumsum([0] + [len(g) for g in grams])
        body = [K.squeeze(value[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])]
        K.trim()
        return pa.table([asked["block"], pa.array([-1] * len(body), pa.int64()), asked["shard"], pa.array(body, pa.binary())], ["block", "home", "part", "body"])

    def carry(batches):
        task = TaskContext.get().partitionId() << 32
        for home, (batch, name, *_) in enumerate(blocks(batches), task):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as w:
                w.write_batch(batch)
            body = K.squeeze(sink.getvalue())
            pieces = [body[i : i + _PIECE] for i in range(0, len(body), _PIECE)]
            for part, piece in enumerate(pieces):
                yield pa.record_batch([pa.array([name], pa.int64()), pa.array([home], pa.int64()), pa.array([part], pa.int32()), pa.array([piece], pa.binary())], ["block", "home", "part", "body"])

    def score(table: pa.Table) -> pa.Table:
        home, part = table["home"].to_numpy(), table["part"].to_numpy()
        got = np.flatnonzero(home < 0)
        got = got[np.unique(part[got], return_index=True)[1]]  # equal blocks get equal answers
        value = [np.frombuffer(K.expand(table["body"][int(i)].as_py()), np.float32) for i in got]
        value = np.concatenate(value) if value else np.zeros(0, np.float32)
        out, bits = [], None
        for own in np.unique(home[home >= 0]):
            pieces = np.flatnonzero(home == own)
            body = b"".join(table["body"][int(i)].as_py() for i in pieces[np.argsort(part[pieces])])
            rows = pa.ipc.open_stream(K.expand(body)).read_all().combine_chunks()
            if bits is None:
                data, off = K.utf8(rows.column(at))
                code = codes(plan, rows.column(here).to_pylist(), data, off, True)
                grams, _, parts = indexed(data, off, code)
                if len(grams) != len(value):
                    break
                sums, lens = np.zeros(len(code)), np.diff(off)
                for a, b, index, place in parts:
                    v = np.zeros(len(index) + 1)
                    known = index >= 0
                    v[1:][known] = value[place[index[known]]]
                    np.cumsum(v, out=v)
                    sums += v[np.clip(off[1:] - a, 0, b - a)] - v[np.clip(off[:-1] - a, 0, b - a)]
                bits = np.where((lens > 0) & (code >= 0), -sums / np.maximum(lens, 1), np.nan)
            out.append(rows.append_column("bits", pa.array(bits, from_pandas=True)))
        if not out:
            raise RuntimeError("the two readings of the documents differ; give the classifier a table or files")
        K.trim()
        return pa.concat_tables(out)

    # a shard's part of the model, once for each of the shard's cuts; short n-grams and discounts are in all
    every = few_tables(counts, order).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(_SHARDS - 1))))
    model = _placed(every, counts.filter("kind = 0")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = plain.mapInArrow(ask, "shard int, block long, grams binary").withColumn("salt", F.pmod("block", F.lit(salts)).cast("int"))
    answers = asked.groupBy("shard", "salt").cogroup(model.groupBy("shard", "salt")).applyInArrow(answer, _ANSWERS)
    scored = answers.unionByName(plain.mapInArrow(carry, _ANSWERS)).groupBy("block").applyInArrow(score, f"{schema}, bits double")
    return scored.toDF(*columns, bits_col)


def _judged(docs: DataFrame, labels: DataFrame, order: int, train_rows: int | None, quantile: float, id_col: str, text_col: str, lang_col: str, carry: bool) -> DataFrame:
    """``docs`` (without their texts unless these are to be carried) with ``_bits``, ``_limit`` and ``_keep``, or longer names where those are taken."""
    if not 1 <= order <= 5:
        raise ValueError("order must be from 1 to 5")
    K.small_batches(docs.sparkSession)
    b, lim, kept = (K.fresh(docs, c) for c in ("_bits", "_limit", "_keep"))
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    used = K.settle(_good(labels, id_col)) if train_rows is None else _training_ids(_trusted(known.drop("text"), labels, id_col), train_rows)
    trusted = partial(K.among, known.filter("lang IS NOT NULL AND text <> ''").select("lang", "text", "id"), used)
    plan = _plan(trusted, train_rows is None)
    counts = counted(trusted, plan, order)
    scored = _scored(docs, plan, counts, order, lang_col, text_col)
    scored = K.settle(scored if carry else scored.drop(text_col))
    seen = scored.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.round(b, 4).alias("bits")).filter("bits IS NOT NULL")
    held_out = _trusted(seen, labels, id_col)
    if train_rows is not None:
        held_out = held_out.join(used, "id", "left_anti")
    limits = held_out.groupBy("lang").agg(F.percentile("bits", F.lit(quantile)).alias("limit"))
    code = K.fresh(docs, "_code")
    limits = few(limits.select(F.col("lang").alias(code), F.col("limit").alias(lim)), plan)
    out = scored.join(limits, F.col(lang_col) == F.col(code), "left").drop(code)
    return out.withColumn(kept, F.coalesce(F.round(b, 4) <= F.col(lim), F.lit(True)))


def perplexities(
    docs: DataFrame, labels: DataFrame, order: int = 5, train_rows: int | None = None, quantile: float = 0.99, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``(id_col, perplexity, threshold, keep)`` for every row; perplexities are per byte."""
    thin = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    j = _judged(thin, labels.select(F.col(id_col).alias("id"), "quality"), order, train_rows, quantile, "id", "text", "lang", False)
    return j.select(F.col("id").alias(id_col), F.round(F.pow(2.0, "_bits"), 6).alias("perplexity"), F.round(F.pow(2.0, "_limit"), 6).alias("threshold"), F.col("_keep").alias("keep"))


def keep_good(
    docs: DataFrame, labels: DataFrame, order: int = 5, train_rows: int | None = None, quantile: float = 0.99, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    return _judged(docs, labels, order, train_rows, quantile, id_col, text_col, lang_col, True).filter(F.col(K.fresh(docs, "_keep"))).select(*K.own(docs))
