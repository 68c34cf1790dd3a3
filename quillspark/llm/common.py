"""Helpers shared by the training-data operators: staged tables, text batches, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; longer documents are cut into overlapping segments.
CHUNK_BYTES = 1 << 19
U64 = np.uint64


_folders: dict[str, str] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under the one that ``spark.checkpoint.dir`` names; it goes when the driver ends.

    Where that is unset, a local session gets a temporary folder, and a cluster, whose executors could not share one, an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"{root or 'file://' + tempfile.mkdtemp(prefix='quillspark-')}/{app}"
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _folders[app] = path
    return _folders[app]


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: it is computed once, its lineage ends there, and its shuffles go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.staged_at = path
    return found


def discard(found: DataFrame) -> None:
    """Remove a staged table that no plan reads any more."""
    spark = found.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(found.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of one Arrow batch between the JVM and Python: many rows, or one long text.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def tidied(run, batches):
    """The batches that ``run`` makes; then the worker, which serves other tasks, gives back the memory that it no longer uses."""
    try:
        yield from run(batches)
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such function
            ctypes.CDLL(None).malloc_trim(0)


def through(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of BATCH_BYTES at most, which the session keeps to from then on."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) != str(BATCH_BYTES):
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(functools.partial(tidied, run), schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns, cast, so that extra columns of any name can't clash."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- Arrow text


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def spans_of(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes at most; a longer row comes alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def longs(column: pa.Array) -> np.ndarray:
    """int64 values; null becomes the largest value, which sorts last."""
    return pc.fill_null(column.cast(pa.int64()), (1 << 63) - 1).to_numpy(zero_copy_only=False)


# ---------------------------------------------------------------- hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix generator, element by element."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


BYTE_CODES = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_UP = np.ones(1, U64)
_DOWN = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    global _UP, _DOWN
    if len(_UP) < n:
        size = max(n, CHUNK_BYTES + 4096)
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, U64)
            down = np.full(size, pow(_BASE, -1, 1 << 64), U64)
            up[0] = down[0] = 1
            _UP, _DOWN = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _UP[:n], _DOWN[:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Sums H with H[j] - H[i], shifted back by i, being the hash of codes[i:j].

    For short ranges, or where equality is checked after it: from 1 024 codes on, regular sequences of two can collide.
    """
    out = np.zeros(len(codes) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(codes * powers(len(codes))[0], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mixed hash of each range [lo, hi) of the codes behind ``prefix``."""
    with np.errstate(over="ignore"):
        x = (prefix[hi] - prefix[lo]) * powers(len(prefix))[1][lo]
        return mix64(x + (hi - lo).astype(U64) * U64(0x9E3779B97F4A7C15))


def chain_hash(values: np.ndarray, lo: np.ndarray, count: np.ndarray, step: int = 1) -> np.ndarray:
    """Hash of values[lo], values[lo + step], ... (count) for each range, mixed after every value, so that no sums can cancel out."""
    out = mix64(count.astype(U64))
    live = np.arange(len(lo))
    with np.errstate(over="ignore"):
        for k in range(int(count.max()) if len(count) else 0):
            live = live[count[live] > k]
            out[live] = mix64(out[live] * U64(0x9E3779B97F4A7C15) ^ values[lo[live] + step * k])
    return out


def bytes_hash(data: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``chain_hash`` of byte ranges of at least eight bytes, eight at a time; the last eight end with the range."""
    padded = np.append(data, np.zeros(8, np.uint8))
    view = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        return mix64(chain_hash(view, lo, (size - 1) >> 3, 8) * U64(0x9E3779B97F4A7C15) ^ view[lo + size - 8] ^ size.astype(U64))


#: Words of more bytes are hashed by a digest: the sums of ``prefix_hash`` can collide on long regular ones.
LONG_WORD = 64


def digest_long(codes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``codes`` of words with those of long words replaced by a digest of their bytes."""
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        codes[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return codes


WORD_GAP = np.zeros(256, bool)
WORD_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_ranges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and return."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~WORD_GAP[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] times, then the same for the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


# ---------------------------------------------------------------- packed rows


def pack(*arrays: np.ndarray) -> bytes:
    """Equal-length columns one after the other, for one binary cell."""
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(payload: bytes, *dtypes: str) -> list[np.ndarray]:
    kinds = [np.dtype(d) for d in dtypes]
    n, at, out = len(payload) // sum(k.itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(payload, k, n, at))
        at += n * k.itemsize
    return out


def by_bucket(bucket: np.ndarray, columns: Iterable[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed columns) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
        if hi > lo:
            yield int(bucket[order[lo]]), pack(*(c[lo:hi] for c in columns))
