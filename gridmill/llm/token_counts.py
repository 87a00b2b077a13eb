"""Token counts of byte-pair vocabularies by rank-synchronous array merging.

Texts are cut into pre-tokens by a vectorised form of the public pattern (contractions; an optional space before
letters, digits or other signs; white space). The pre-tokens of a batch are looked up by hash, and only those not
met before by the worker are merged: they lie side by side as one ragged array of symbols, and every round each
sequence applies its lowest-rank pair at all its places at once, until no sequence has a pair with a rank. The
symbols that survive are counted.

The rank file is a parameter (``path``), read on each worker from a path that all of them see; it is never copied.

Defined results: null text gives a null count and empty text 0; white space counts as the vocabulary has it; very
long texts and pre-tokens are processed whole; equal rows get equal counts; an empty table gives no rows; ids may
be null or repeat; other columns are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm import kernels as K

LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
_TAILS = {"s": 1, "d": 1, "m": 1, "t": 1, "ll": 2, "ve": 2, "re": 2}


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point, as the regex module has it."""
    text = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "." for c in range(0x110000))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[m.start() : m.end()] = kind
    return out


def pre_tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start byte of each pre-token, and each row's offset into them; a pre-token ends where the next begins."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = _classes()[cp]
    n = len(cp)
    row = np.zeros(n + 1, bool)  # the first character of a row
    row[np.searchsorted(at, off)] = True
    row, end = row[:-1], row[1:].copy()
    end[-1] = True  # the last character of a row
    start = row.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # the last of a run of white space before a word parts from the run; a plain space joins the word
    before = np.zeros(n, bool)
    before[:-1] = space[:-1] & ~space[1:] & ~end[:-1]
    start |= before
    plain = before & (cp == 32)
    start[1:] &= ~plain[:-1] | row[1:]
    # contractions: a lone apostrophe that begins a run of signs, with no plain space in front
    quote = np.flatnonzero((cp == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~row[quote + 1]]
    if len(quote):
        pick = lambda k: np.where(quote + k < n, cp[np.minimum(quote + k, n - 1)], 0)
        a, b = pick(1), pick(2)
        same = (quote + 2 < n) & ~row[np.minimum(quote + 2, n - 1)]
        one = np.isin(a, [ord(x) for x in "sdmt"])
        two = np.zeros(len(quote), bool)
        for t in ("ll", "ve", "re"):
            two |= (a == ord(t[0])) & (b == ord(t[1])) & same
        size = np.where(one, 2, np.where(two, 3, 0))
        hit = size > 0
        q, size = quote[hit], size[hit]
        start[q + 1] = False
        q = q + size
        on = q[q < n]
        start[on] = True
    first = at[start]
    return first, np.searchsorted(first, off)


class Vocabulary:
    """Ranks of byte strings as sorted pair keys, and the counts of pre-tokens met so far."""

    def __init__(self, path: str, cache_bits: int = 20):
        with open(path, "rb") as f:
            rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.single = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        for token, r in rank.items():
            for i in range(1, len(token)):
                a, b = rank.get(token[:i]), rank.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        # a direct-mapped copy of the pair table: most probes end here
        self.bits = 20
        self.slot_key, self.slot_rank = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        spot = self._spot(self.keys)
        self.slot_key[spot], self.slot_rank[spot] = self.keys, self.ranks
        full = self.slot_key[spot] != self.keys
        self.rest_keys, self.rest_ranks = self.keys[full], self.ranks[full]
        self.cache_bits = cache_bits
        self.met, self.count = np.zeros(1 << cache_bits, K.U64), np.zeros(1 << cache_bits, np.int32)

    def _spot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(K.U64) * K.U64(0x9E3779B97F4A7C15)) >> K.U64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; a large number if it has none."""
        key = a << 32 | b
        spot = self._spot(key)
        out = np.where(self.slot_key[spot] == key, self.slot_rank[spot], 1 << 40)
        if len(self.rest_keys):
            i = np.minimum(np.searchsorted(self.rest_keys, key), len(self.rest_keys) - 1)
            out = np.where(self.rest_keys[i] == key, self.rest_ranks[i], out)
        return out

    def merge(self, symbols: np.ndarray, seq: np.ndarray, n: int) -> np.ndarray:
        """How many symbols each of n sequences is left with; symbols lie in order, seq names their sequence."""
        left = np.bincount(seq, minlength=n)
        ranks = None
        while len(symbols) > 1:
            if ranks is None:
                ranks = np.full(len(symbols), 1 << 40, np.int64)
                pair = np.flatnonzero(seq[1:] == seq[:-1])
                ranks[pair] = self.rank(symbols[pair], symbols[pair + 1])
            first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            lens = np.diff(np.append(first, len(seq)))
            low = np.minimum.reduceat(ranks, first)
            live = low < 1 << 40
            if not live.any():
                break
            on = np.repeat(live, lens)
            if not live.all():  # sequences that are done leave the arrays
                symbols, seq, ranks = symbols[on], seq[on], ranks[on]
                lens, low = lens[live], low[live]
            hit = ranks == np.repeat(low, lens)
            # of hits side by side (one symbol repeated), every other one counts, from the left
            chain = np.flatnonzero(hit[1:] & hit[:-1] & (seq[1:] == seq[:-1]))
            if len(chain):
                at = np.flatnonzero(hit)
                new = np.concatenate([[True], (np.diff(at) != 1) | (seq[at[1:]] != seq[at[:-1]])])
                run = np.flatnonzero(new)
                odd = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) & 1
                hit[at[odd == 1]] = False
            at = np.flatnonzero(hit)
            symbols = symbols.copy()
            symbols[at] = ranks[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            left -= np.bincount(seq[at], minlength=n)
            moved = np.cumsum(keep) - 1
            symbols, seq, ranks = symbols[keep], seq[keep], ranks[keep]
            new = moved[at]
            touched = np.unique(np.concatenate([new, new[new > 0] - 1]))
            ranks[touched] = 1 << 40
            pair = touched[touched + 1 < len(seq)]
            pair = pair[seq[pair + 1] == seq[pair]]
            ranks[pair] = self.rank(symbols[pair], symbols[pair + 1])
        return left

    def counts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The number of tokens of each row."""
        s, cut = pre_tokens(data, off)
        if not len(s):
            return np.zeros(len(off) - 1, np.int64)
        e = np.append(s[1:], len(data))
        h = K.span_hashes(data, s, e) | K.U64(1)
        spot = (h >> K.U64(64 - self.cache_bits)).astype(np.int64)
        out = self.count[spot]
        miss = np.flatnonzero(self.met[spot] != h)
        if len(miss):
            u, first, inv = np.unique(h[miss], return_index=True, return_inverse=True)
            lens = (e - s)[miss[first]]
            where = np.repeat(s[miss[first]] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
            n = self.merge(self.single[data[where]], np.repeat(np.arange(len(u)), lens), len(u)).astype(np.int32)
            out[miss] = n[inv]
            where = (u >> K.U64(64 - self.cache_bits)).astype(np.int64)
            self.met[where], self.count[where] = u, n
        total = np.concatenate([[0], np.cumsum(out, dtype=np.int64)])
        return total[cut[1:]] - total[cut[:-1]]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens)`` for every row."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def count(batches):
        vocab = vocabulary(path)
        for batch in K.slices(batches, block_bytes=2 << 20):
            n = vocab.counts(*K.utf8(batch.column(1)))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64(), mask=batch.column(1).is_null().to_numpy(zero_copy_only=False))], ["id", "n"])

    return docs.mapInArrow(count, f"id {docs.schema[0].dataType.simpleString()}, n long").select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"))
