"""Toxicity: noisy-channel deobfuscation, then scoring of the restored text.

Every word of every text is scanned. Words that the channel may have disguised (a letter written as a digit or sign,
masked or doubled, or with a dot, dash or the like between letters; three or more letters apart with spaces, however
many) become a lattice of what each character may stand for, and Viterbi decoding under a character trigram model
finds the likeliest plain word; plain words and numbers are their own only reading. A text's score is the sum, over its distinct words, of each word's largest log-odds among
the word and its prefixes in toxic against other labelled rows. The trigram model, the log-odds and the threshold are
learned from all labelled rows. Texts are scored where they are read: nothing is shuffled but counts (of the labelled
rows' words and features), and labelled texts if ``kernels.among`` needs a join. The trigrams, as many as the alphabet
allows, are held by every worker, and so are the features, ``FEATURES`` of them: where there are more, texts are scored
in several passes, each over a part of the features (256 parts at most), and written between them.

Defined results: null and blank texts score 0; very long words are decoded whole (a run of one character counts as
two); a label table may repeat ids (one toxic label is enough) and may name ids without a document; without a toxic
label nothing scores above 0; equal rows get equal scores; an empty table gives no rows; ids may be null; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm import kernels as K

LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
_GAPS = ".-_*~'"
_PREFIXES = tuple(range(4, 11))
FEATURES = 1 << 22  #: features that a worker holds, of 16 bytes each
_STRIP = np.zeros(256, bool)
_STRIP[[ord(c) for c in ".,!$%*#&|\"'()[]{}?;:-_~<>=+/\\"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(65, 91), *range(128, 256)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LEET if ord(c) < 128]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HEAD, _TAIL = np.zeros(256, bool), np.zeros(256, bool)  # signs that may be a word's first or last letter
_HEAD[[ord(c) for c in "$@!|+"]] = True
_TAIL[[ord(c) for c in "$@"]] = True
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in _GAPS]] = True


class Channel:
    """Viterbi decoding of a disguised word under a character trigram model."""

    def __init__(self, counts: dict[str, int]):
        self.c = counts
        self.letters = sorted(g for g in counts if len(g) == 1 and g.isalpha())
        self.n = sum(counts[g] for g in counts if len(g) == 1) or 1
        self.known: dict[str, str] = {}
        self.memo: dict[tuple[str, str], float] = {}

    def cost(self, state: str, c: str) -> float:
        k = (state, c)
        if k not in self.memo:
            n = self.c
            p = 0.75 * n.get(state + c, 0) / (n.get(state, 0) or 1) + 0.2 * n.get(state[1] + c, 0) / (n.get(state[1], 0) or 1) + 0.05 * (n.get(c, 0) + 0.01) / self.n
            self.memo[k] = log(p)
        return self.memo[k]

    def readings(self, c: str, before: str, stretched: bool) -> list[tuple[str, float]]:
        """What a character may stand for, with the channel's log-probability; '' for nothing."""
        if c == "*":
            return [("", -1.5), *((x, -3.5) for x in self.letters)]
        if c in _GAPS:
            return [("", -0.3)]
        out = [(c, -0.05 if c.isalpha() else -4.0)]
        out += [(x, -0.7) for x in LEET.get(c, "")]
        if not c.isalnum() and c not in LEET:
            out.append(("", -1.0))
        if c == before:
            out.append(("", -0.7 if stretched else -4.0))
        return out

    def decode(self, word: str) -> str:
        if word in self.known:
            return self.known[word]
        w = [(m[1], len(m[0]) > 2) for m in re.finditer(r"(.)\1*", word, re.S) for _ in m[0][:2]]  # of three or more, two are looked at
        best: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}  # by the last two letters; texts are chains from their ends
        before = ""
        for c, stretched in w:
            new: dict[str, tuple[float, tuple | None]] = {}
            options = self.readings(c, before, stretched)
            for state, (score, text) in best.items():
                for x, chance in options:
                    if x:
                        s, t, v = state[1] + x, (text, x), score + chance + self.cost(state, x)
                    else:
                        s, t, v = state, text, score + chance
                    if s not in new or v > new[s][0]:
                        new[s] = (v, t)
            best, before = new, c
        end = max(best, key=lambda s: (best[s][0] + self.cost(s, "$"), s))
        chain, out = best[end][1], []
        while chain is not None:
            chain, x = chain
            out.append(x)
        text = "".join(reversed(out))
        if len(self.known) >= 1 << 17:
            self.known.clear()
        self.known[word] = text
        return text


def _strip(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the signs at their ends."""
    s, e = s.copy(), e.copy()
    for side in (0, 1):
        todo = np.arange(len(s))
        while len(todo):
            todo = todo[s[todo] < e[todo]]
            at = s[todo] if side == 0 else e[todo] - 1
            todo = todo[_STRIP[data[at]]]
            if side == 0:
                s[todo] += 1
            else:
                e[todo] -= 1
    return s, e


def suspects(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which stripped words the channel may have disguised."""
    sums = lambda m: np.concatenate([[0], np.cumsum(m, dtype=np.int64)])
    inside = lambda c: c[e] - c[s]
    letters, signs, gaps = (inside(sums(t[data])) for t in (_LETTER, _SIGN, _GAP))
    double, wide = np.zeros(len(data), bool), np.zeros(len(data), bool)
    double[1:] = (data[1:] == data[:-1]) & _LETTER[data[1:]] & (data[1:] < 128)
    wide[3:] = (data[3:] == data[1:-2]) & (data[2:-1] == data[:-3]) & (data[2:-1] & 224 == 192)  # letters of two bytes
    foreign = np.zeros(len(data), bool)
    for x in (c.encode() for c in LEET if ord(c) > 127):
        n = len(x)
        if len(data) >= n:
            foreign[: len(data) - n + 1] |= np.all([data[k : len(data) - n + 1 + k] == b for k, b in enumerate(x)], axis=0)
    after = lambda m, k: (lambda c: np.where(e - s > k, c[e] - c[np.minimum(s + k, e)], 0))(sums(m))
    odd = (after(double, 1) > 0) | (after(wide, 3) > 0) | (inside(sums(foreign)) > 0)
    digits = inside(sums(_DIGIT[data]))
    # a word of signs alone is looked at unless it is a number
    return ((letters >= 1) & ((signs > 0) & (letters + signs > 2) | (gaps > 0) | odd)) | ((letters == 0) & (signs > 2) & (digits > 0) & (signs > digits))


def _apart(s: np.ndarray, e: np.ndarray, cs: np.ndarray, ce: np.ndarray, data: np.ndarray, woff: np.ndarray) -> list[tuple[int, str]]:
    """Runs of three or more words of one character each besides signs at their ends: the first word and the characters.

    A run with such signs within is also taken as the parts that begin or end at them.
    """
    if not len(s):
        return []
    signs = np.concatenate([[0], np.cumsum(_SIGN[data], dtype=np.int64)])
    lone = (cs == ce) & (signs[e] - signs[s] == 1)  # a sign among others that may be a letter
    last = len(data) - 1
    first = np.minimum(cs, last)
    wide = (ce - cs > 1) & (ce - cs < 5) & (data[first] >= 192)
    for k in range(1, 4):
        wide &= (ce - cs <= k) | (data[np.minimum(cs + k, last)] & 192 == 128)
    single = (((ce - cs == 1) & (_LETTER | _SIGN)[data[first]]) | wide | lone) & (ce - cs < 5)
    raw = data.tobytes()
    chars: dict[int, str] = {}
    for i in np.flatnonzero(single):
        if lone[i]:
            c = next(chr(x) for x in raw[s[i] : e[i]] if _SIGN[x])
        else:
            c = raw[cs[i] : ce[i]].decode("utf-8", "replace")
            if wide[i] and not c.isalpha() and c not in LEET:
                single[i] = False
        chars[int(i)] = c
    new = np.zeros(len(s) + 1, bool)
    new[woff] = True
    out = []
    at = np.flatnonzero(single)
    if not len(at):
        return out
    begins, ends = single & ~lone & (cs > s), single & ~lone & (ce < e)
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | new[at[1:]]]))
    for a, b in zip(cut, np.append(cut[1:], len(at))):
        if b - a < 3:
            continue
        lo, hi = int(at[a]), int(at[b - 1]) + 1
        parts = {(lo, hi)}
        edges = [lo, *(x for x in range(lo + 1, hi) if begins[x] or ends[x - 1]), hi]
        parts.update((x, y) for x, y in zip(edges, edges[1:]) if y - x >= 3)
        out += [(x, "".join(chars[k] for k in range(x, y))) for x, y in sorted(parts)]
    return out


def features(data: np.ndarray, s: np.ndarray, e: np.ndarray):
    """The hashes of each word and of its prefixes of some bytes; 0 where the word is no longer than that. Their last byte goes by the word's first four bytes."""
    lens = e - s
    hashes = K.prefix_hashes(data, s, e, _PREFIXES)
    last = hashes[1] & K.U64(255)
    for size, h in zip((0, *_PREFIXES), hashes):
        h = (h ^ K.U64((size + 1) * 0x9E3779B97F4A7C15 % 2**64)) & K.U64(2**64 - 256) | last
        yield np.where(lens > size if size else lens > 1, h, K.U64(0))


def restored(data: np.ndarray, off: np.ndarray, channel: Channel | None):
    """The texts' words with the disguised ones decoded: bytes, spans, and the row of each."""
    s, e, woff = K.words(data, off)
    rows = K.rows_of(woff)
    cs, ce = _strip(data, s, e)
    extra: list[bytes] = []
    extra_rows: list[int] = []
    if channel is not None and len(s):
        ws, we = cs.copy(), ce.copy()
        ws[(cs - s == 1) & (cs < ce) & _HEAD[data[s]]] -= 1
        tail = (e - ce > 0) & (e - ce < 3) & (cs < ce) & _TAIL[data[e - 1]]
        we[tail] = e[tail]
        odd = np.flatnonzero(suspects(data, ws, we))
        raw = data.tobytes()
        for i in odd:
            word = raw[ws[i] : we[i]].decode("utf-8", "replace")
            plain = channel.decode(word)
            if plain and plain != word:
                extra.append(plain.encode())
                extra_rows.append(int(rows[i]))
        for a, run in _apart(s, e, cs, ce, data, woff):
            for part in {run, run[1:], run[:-1]} if len(run) > 3 else {run}:  # a word of one letter may stand at either end
                extra.append(channel.decode(part).encode())
                extra_rows.append(int(rows[a]))
    if extra:
        n = len(data)
        ends = n + np.cumsum([len(x) for x in extra])
        data = np.concatenate([data, np.frombuffer(b"".join(extra), np.uint8)])
        cs, ce = np.concatenate([cs, np.concatenate([[n], ends[:-1]])]), np.concatenate([ce, ends])
        rows = np.concatenate([rows, np.array(extra_rows, rows.dtype)])
    return data, cs, ce, rows


def _features_of(data, s, e, rows, chosen: np.ndarray | None):
    """Distinct (row, word, feature) of the texts, only the chosen features if given."""
    out_r, out_w, out_f = [], [], []
    bits = None
    if chosen is not None:
        bits = np.zeros(1 << 16, bool)
        bits[(chosen >> K.U64(48)).astype(np.int64)] = True
    word = None
    for f in features(data, s, e):
        word = f if word is None else word
        at = np.flatnonzero(f) if bits is None else np.flatnonzero((f != 0) & bits[(f >> K.U64(48)).astype(np.int64)])
        if chosen is not None and len(at):
            i = np.minimum(np.searchsorted(chosen, f[at]), len(chosen) - 1)
            at = at[chosen[i] == f[at]]
        out_r.append(rows[at])
        out_w.append(word[at])
        out_f.append(f[at])
    return np.concatenate(out_r), np.concatenate(out_w), np.concatenate(out_f)


def train(docs: DataFrame, labels: DataFrame, min_docs: int, min_odds: float):
    """Trigram counts, the table ``(f, w)`` of features and log-odds, and all labelled rows, from rows ``(id, text)`` and labels ``(id, toxic)``."""
    marks = K.settle(labels.filter("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg((F.max("toxic") > 0).alias("toxic")))
    texts = docs.filter("text IS NOT NULL")
    sides = [K.among(texts, marks.filter(F.col("toxic") == x).select("id")).select(F.lit(x).alias("toxic"), "text") for x in (True, False)]
    known = K.settle(sides[0].unionByName(sides[1]))

    def vocabulary(batches):
        for batch in K.slices(batches, block_bytes=4 << 20):
            words = Counter(w for t in batch.column(1).to_pylist() for w in re.findall(r"[^\W\d_]+", t))
            yield pa.record_batch([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["w", "n"])

    def trigrams(batches):
        for batch in batches:
            grams: Counter = Counter()
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = int(n**0.5) + 1  # a word's weight grows with its count, but not in proportion
                w = "^^" + w + "$"
                grams["^"] += n
                grams["^^"] += n
                for i in range(2, len(w)):
                    grams[w[i]] += n
                    grams[w[i - 1 : i + 1]] += n
                    grams[w[i - 2 : i + 1]] += n
            yield pa.record_batch([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["g", "n"])

    words = known.mapInArrow(vocabulary, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    counts = {r.g: r.n for r in words.mapInArrow(trigrams, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}

    def seen(chosen):
        def count(batches):
            for batch in K.slices(batches, block_bytes=4 << 20):
                data, off = K.utf8(batch.column(1))
                s, e, woff = K.words(data, off)
                r, _, f = _features_of(data, *_strip(data, s, e), K.rows_of(woff), chosen)
                by = np.lexsort((r, f))
                r, f = r[by], f[by]
                one = np.ones(len(f), bool)
                one[1:] = (f[1:] != f[:-1]) | (r[1:] != r[:-1])
                u, n = np.unique(f[one], return_counts=True)
                yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["f", "n"])

        return count

    size = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    bad = K.settle(known.filter("toxic").mapInArrow(seen(None), "f long, n long").groupBy("f").agg(F.sum("n").alias("t")).filter(F.col("t") >= min_docs))
    # few enough features are looked for alone; else all of the other rows' are counted and joined
    chosen = np.sort(bad.select("f").toArrow()["f"].to_numpy().view(K.U64)) if bad.count() <= FEATURES else None
    good = known.filter("NOT toxic").mapInArrow(seen(chosen), "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (size.get(True, 0) + 1)) - F.log((F.coalesce("n", F.lit(0)) + 0.5) / (size.get(False, 0) + 1))
    model = bad.join(good, "f", "left").select("f", odds.alias("w")).filter(F.col("w") >= min_odds)
    return counts, K.settle(model), known


def scores(
    docs: DataFrame, labels: DataFrame, min_docs: int = 4, min_odds: float = 3.5, threshold: float = 5.5, recall: float = 0.97, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, score, toxic)`` for every row.

    A row is toxic from ``threshold`` on, or from the score that ``recall`` of the rows labelled toxic with a score
    reach, if that is lower: with few labels no single word can score as high as with many.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))
    counts, model, known = train(docs, labels.select(F.col(id_col).alias("id"), "toxic"), min_docs, min_odds)
    passes = min(256, -(-model.count() // FEATURES)) or 1

    def score(held, carry):
        def add(batches):
            counts, chosen, odds = held.value
            channel = Channel(counts)
            for batch in K.slices(batches, block_bytes=1 << 20):
                out = batch.column(2).to_numpy().copy()
                if len(chosen):
                    r, w, f = _features_of(*restored(*K.utf8(batch.column(1)), channel), chosen)
                    v = odds[np.searchsorted(chosen, f)]
                    by = np.lexsort((-v, w, r))  # of a row's word the largest
                    r, w, v = r[by], w[by], v[by]
                    first = np.ones(len(r), bool)
                    first[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1])
                    np.add.at(out, r[first], v[first])
                columns = [batch.column(0), *([batch.column(1)] if carry else []), pa.array(out)]
                yield pa.record_batch(columns, ["id", *(["text"] if carry else []), "score"])

        return add

    parts = []
    for k in range(passes):  # a word's features are all in one
        part = model.filter(F.pmod(F.col("f").bitwiseAND(255), F.lit(passes)) == k).toArrow()
        f, w = part["f"].to_numpy().view(K.U64), part["w"].to_numpy()
        by = np.argsort(f)
        parts.append(spark.sparkContext.broadcast((counts, f[by], w[by])))

    def scored(table: DataFrame) -> DataFrame:
        table, kind = table.withColumn("score", F.lit(0.0)), table.schema["id"].dataType.simpleString()
        for held in parts[:-1]:
            table = K.settle(table.mapInArrow(score(held, True), f"id {kind}, text string, score double"))
        return table.mapInArrow(score(parts[-1], False), f"id {kind}, score double")

    marked = scored(known.filter("toxic").select(F.col("toxic").alias("id"), "text"))
    least = marked.filter("score > 0").agg(F.percentile("score", F.lit(1 - recall))).first()[0]
    threshold = threshold if least is None else min(threshold, least)
    return scored(docs).select(F.col("id").alias(id_col), F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("toxic"))
