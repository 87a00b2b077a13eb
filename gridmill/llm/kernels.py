"""Vectorised text kernels shared by the operators of this subpackage.

Texts stay in Arrow's contiguous UTF-8 buffer; words, hashes and n-grams are numpy arrays over it,
so no Python object is made per word. A word is a maximal run of bytes that are not ASCII white space.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_P, _Q = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03)
_CODEC = pa.Codec("zstd", 1)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, U64(pow(int(base), -1, 2**64))
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, self.base, U64)]), dtype=U64)
            self.down = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, self.inverse, U64)]), dtype=U64)
        return self.up[:n], self.down[:n]


_BYTES_P, _WORDS_P = _Powers(_P), _Powers(_Q)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(off) == 0:
        off = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each row's offset into the words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | first[1:-1]
    end[:-1] &= ~solid[1:] | first[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap."""
    return prefix_hashes(data, s, e, (), step)[0]


def prefix_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, sizes: tuple[int, ...], step: int = 1 << 20) -> list[np.ndarray]:
    """Hashes of the spans, and of the first so many bytes of each, as they would hash as spans."""
    out = [np.empty(len(s), U64) for _ in range(1 + len(sizes))]
    i = 0
    while i < len(s):
        base = int(s[i])
        j = max(i + 1, int(np.searchsorted(e, base + step, "right")))
        stop = int(e[j - 1])
        up, down = _BYTES_P.get(stop - base + 1)
        sums = np.zeros(stop - base + 1, U64)
        np.cumsum(_BYTE[data[base:stop]] * up[:-1], out=sums[1:])
        lo, hi = s[i:j] - base, e[i:j] - base
        low, scale = sums[lo], down[lo]
        for k, size in enumerate((None, *sizes)):
            out[k][i:j] = (sums[hi if size is None else np.minimum(hi, lo + size)] - low) * scale
        i = j
    return [mix(x) for x in out]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words; the caller drops those that cross rows."""
    if len(h) < n:
        return np.zeros(0, U64)
    if n == 1:
        return h
    if n <= 4:
        g = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            g = g * _P + h[k : len(h) - n + 1 + k]
        return mix(g)
    up, down = _WORDS_P.get(len(h) + 1)
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(h * up[:-1], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(h) - n + 1])


def rows_of(woff: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(woff) - 1, dtype=np.int32), np.diff(woff))


def inside(woff: np.ndarray, n: int) -> np.ndarray:
    """Positions at which a run of n words stays within its row."""
    lens = np.maximum(np.diff(woff) - n + 1, 0)
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(woff[:-1] - (np.cumsum(lens) - lens), lens)


def pack(a: np.ndarray) -> bytes:
    """Unsigned integers as zstd-compressed byte planes, as many as the largest needs."""
    a = np.ascontiguousarray(a, dtype="<u8")
    w = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes()
    return bytes([w]) + len(a).to_bytes(8, "little") + (_CODEC.compress(planes, asbytes=True) if planes else b"")


def unpack(b: bytes) -> np.ndarray:
    w, n = b[0], int.from_bytes(b[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    if w and n:
        out[:, :w] = np.frombuffer(_CODEC.decompress(b[9:], w * n, asbytes=True), np.uint8).reshape(w, n).T
    return out.reshape(-1).view("<u8")


def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted unsigned integers by their differences."""
    if not len(a):
        return pack(a)
    d = np.diff(a, prepend=U64(0))
    return int(d[0]).to_bytes(8, "little") + pack(d[1:])


def unpack_sorted(b: bytes) -> np.ndarray:
    if b[0] == 0 and len(b) == 9:
        return np.zeros(0, U64)
    d = unpack(b[8:])
    return np.cumsum(np.concatenate([[U64(int.from_bytes(b[:8], "little"))], d]), dtype=U64)


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + (_CODEC.compress(raw, asbytes=True) if raw else b"")


def expand(b: bytes) -> bytes:
    n = int.from_bytes(b[:8], "little")
    return _CODEC.decompress(b[8:], n, asbytes=True) if n else b""


def shard_bounds(sorted_hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each of the equal hash ranges begins in a sorted array; one more entry than shards."""
    edges = np.array([(k << 64) // shards for k in range(1, shards)], U64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def trim() -> None:
    """Gives memory that is no longer used back to the system: an idle worker then holds little more than its modules."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def slices(batches, text: str | int = "text", block_bytes: int = 8 << 20):
    """Record batches cut into slices of at most about block_bytes of text, whole rows each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8(batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + block_bytes, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
    trim()


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one if the table has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own(df: DataFrame, *but: str) -> list:
    """The table's columns, but those named, whatever signs their names hold."""
    return [F.col(f"`{c}`") for c in df.columns if c not in but]


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """The table with its columns named by their place, and their schema: any name then survives a pass through Python."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)


@lru_cache(1)
def _local_dir() -> str:
    """A folder for local sessions without a shared one, as in tests; it goes when the process ends."""
    path = tempfile.mkdtemp(prefix="gridmill-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """A new folder name in the shared folder that the cluster names; a local one only in a local session where none is set.

    All folders of an application lie in one, which goes when its driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_dir()
    home = f"{base.rstrip('/')}/gridmill-{spark.sparkContext.applicationId}"
    _remove_at_end(spark, home)
    return f"{home}/{uuid.uuid4().hex}"


_HOMES: set[str] = set()


def _path(spark: SparkSession, path: str):
    """The file system of a path and the path, in the driver's JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _remove_at_end(spark: SparkSession, home: str) -> None:
    if home not in _HOMES:
        _HOMES.add(home)
        fs, at = _path(spark, home)
        fs.mkdirs(at)
        fs.deleteOnExit(at)


def settle(df: DataFrame, over: DataFrame | None = None) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends, and the loss of an executor costs nothing.

    ``over`` is a settled table that nothing needs any more once these rows are written; its files go.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    _MADE.append(path)
    if over is not None:
        drop(over)
    return spark.read.parquet(path)


_MADE: list[str] = []  # the folders of settled tables


def settle_stage(make, over: DataFrame) -> DataFrame:
    """The rows of ``make()`` settled; the tables that were settled on the way to them go, and so does ``over`` if it was settled."""
    before = len(_MADE)
    df = make()
    between = _MADE[before:]
    out = settle(df, over=over)
    for path in between:
        _remove(df.sparkSession, path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


def drop(settled: DataFrame) -> None:
    """Removes the files of a settled table that no plan reads any more; other tables are left alone."""
    spark = settled.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in settled.inputFiles()}:
        if f"/gridmill-{spark.sparkContext.applicationId}/" in path:
            _remove(spark, path)


MEMBERS = 1 << 24  #: ids that a worker holds, of 8 bytes each


def among(rows: DataFrame, ids: DataFrame, work=None, schema: str | None = None) -> DataFrame:
    """The rows whose ``id`` is one of ``ids`` (a settled table), or what ``work`` makes of their batches, in the same worker.

    The rows stay where they are read if ids are whole numbers and at most ``MEMBERS``; else they are joined.
    """
    if not all(isinstance(x.schema["id"].dataType, IntegralType) for x in (rows, ids)) or ids.count() > MEMBERS:
        found = rows.join(ids.select("id"), "id", "left_semi").select(*rows.columns)
        return found if work is None else found.mapInArrow(work, schema)
    own = ids.select(F.col("id").cast("long")).filter("id IS NOT NULL").toArrow()["id"].to_numpy()
    held, at = rows.sparkSession.sparkContext.broadcast(np.unique(own)), rows.columns.index("id")

    def keep(batches):
        own = held.value
        for batch in batches:
            x = batch.column(at).cast(pa.int64())
            n = pc.fill_null(x, 0).to_numpy(zero_copy_only=False)
            i = np.minimum(np.searchsorted(own, n), len(own) - 1)
            yield batch.filter(pc.and_(x.is_valid(), pa.array(own[i] == n if len(own) else np.zeros(len(n), bool))))

    return rows.mapInArrow(keep, rows.schema) if work is None else rows.mapInArrow(lambda batches: work(keep(batches)), schema)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files (or rows) that a plan reads, as the engine knows them; by the shuffle partitions where it doesn't."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return total if total < 1 << 60 else shuffle_parts(df.sparkSession) << 26


def small_batches(spark: SparkSession, limit: int = 8 << 20, rows: int = 512) -> None:
    """Long texts make large batches; the session's limits of bytes to Python and of rows read at once are lowered, so that neither side of the pipe holds much."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", limit), ("spark.sql.parquet.columnarReaderBatchSize", rows)):
        try:
            if int(spark.conf.get(key).rstrip("b")) > most:
                spark.conf.set(key, str(most))
        except ValueError:  # given with another unit: the user's own choice
            pass
