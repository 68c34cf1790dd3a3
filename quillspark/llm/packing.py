"""Operator 9: packing of token sequences by non-negative least squares over shallow length combinations."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoded
from .common import longs, only, partitions, staged, table, through

WINDOW, END_ID = 1024, 0
#: The tokenizer's own special token; its string in a text is one id there, before any merge.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


# ---------------------------------------------------------------- plan


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c) of lengths that occur, a >= b >= c, with a + b + c = window; c or b and c may be 0."""
    have = np.flatnonzero(histogram)
    have = have[have > 0]
    out = []
    if window < len(histogram) and histogram[window]:
        out.append([[window, 0, 0]])
    present = np.zeros(window + 1, bool)
    present[have] = True
    a = have[(have >= (window + 1) // 2) & (have < window)]
    a = a[present[window - a]]
    if len(a):
        out.append(np.stack([a, window - a, np.zeros_like(a)], 1))
    for a in have[(3 * have >= window) & (have < window)].tolist():
        b = have[(have <= a) & (2 * have >= window - a) & (have < window - a)]
        c = window - a - b
        b, c = b[present[c]], c[present[c]]
        if len(b):
            out.append(np.stack([np.full(len(b), a), b, c], 1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros((0, 3), np.int64)


def least_squares(parts: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes the lengths used by x[i] times parts[i] come near the histogram: min |A x - h|.

    Multiplicative updates keep x non-negative and never raise the distance; A has at most three entries a column, so
    both products are sums over the parts.
    """
    used = parts > 0
    h = histogram.astype(float)
    h[0] = 0

    def back(v: np.ndarray) -> np.ndarray:
        return np.where(used, v[parts], 0).sum(1)

    def forth(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h))
        for k in range(parts.shape[1]):
            out += np.bincount(parts[:, k], weights=x, minlength=len(h))
        out[0] = 0
        return out

    target = back(h)
    x = np.full(len(parts), max(h.sum(), 1) / max(1, 2 * len(parts)))
    for _ in range(rounds):
        x *= target / np.maximum(back(forth(x)), 1e-12)
    return x


def plan_packing(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Length combinations and how often each is used; together they use every piece of the histogram exactly once.

    The combinations that fill the window get the rounded counts of the least-squares fit, as far as pieces are left;
    what then remains is packed greedily, the longest piece first, each time with the longest piece that still fits.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[tuple[int, ...], int]] = []
    if window < len(left) and left[window]:
        plan.append(((window,), int(left[window])))
        left[window] = 0
    parts = combinations(left, window)
    if len(parts):
        x = np.floor(least_squares(parts, left) + 0.5).astype(np.int64)
        for i in np.argsort(-x, kind="stable").tolist():
            if not x[i]:
                break
            lengths, times = np.unique(parts[i][parts[i] > 0], return_counts=True)
            n = int(min(x[i], (left[lengths] // times).min()))
            if n:
                plan.append((tuple(int(v) for v in parts[i] if v), n))
                left[lengths] -= n * times
    while left.any():
        taken: dict[int, int] = {}
        room = window
        while room:
            fit = np.flatnonzero(left[: room + 1] > np.array([taken.get(i, 0) for i in range(room + 1)])) if taken else np.flatnonzero(left[: room + 1])
            if not len(fit):
                break
            v = int(fit[-1])
            taken[v] = taken.get(v, 0) + 1
            room -= v
        n = min(int(left[v]) // t for v, t in taken.items())
        plan.append((tuple(v for v, t in sorted(taken.items(), reverse=True) for _ in range(t)), n))
        for v, t in taken.items():
            left[v] -= n * t
    return plan


@dataclass(frozen=True)
class Slots:
    """For each length, where its pieces go by rank: from ``rank`` on to sequence ``first`` + (their place), at ``offset``."""

    rank: dict[int, np.ndarray]
    first: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]


def slots(plan: list[tuple[tuple[int, ...], int]]) -> Slots:
    upto: dict[int, int] = {}
    found: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, n in plan:
        offset = 0
        for v in lengths:
            found.setdefault(v, []).append((upto.get(v, 0), sequence, offset))
            upto[v] = upto.get(v, 0) + n
            offset += v
        sequence += n
    cols = {v: np.array(f, np.int64).T for v, f in found.items()}
    return Slots(*({v: c[k].copy() for v, c in cols.items()} for k in range(3)))


# ---------------------------------------------------------------- pieces


def token_ids(batches: Iterator[pa.RecordBatch], path: str, special: bool):
    """(rows' doc_ids, ids, offsets); texts with the special token's string are cut there."""
    for batch, lo, hi, ids, at in encoded(batches, path):
        names = batch.column(0).slice(lo, hi - lo)
        texts = batch.column(1).slice(lo, hi - lo)
        odd = np.flatnonzero(pa.compute.match_substring(texts, SPECIAL).fill_null(False).to_numpy(zero_copy_only=False)) if special else ()
        if len(odd):
            from .bpe import vocabulary

            words = vocabulary(path)
            each = np.split(ids, at[1:-1])
            for i in odd.tolist():
                parts: list[int] = []
                for k, piece in enumerate(texts[i].as_py().split(SPECIAL)):
                    parts += [SPECIAL_ID] * (k > 0) + words.encode(piece)
                each[i] = np.array(parts, np.uint32)
            ids, at = np.concatenate(each), np.append(0, np.cumsum([len(e) for e in each]))
        yield names, ids, at


def pieces(docs: DataFrame, path: str, window: int = WINDOW, special: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece: whole windows, then what is left of the document."""

    def run(batches):
        for names, ids, at in token_ids(batches, path, special):
            doc, start, length, crc, total = [], [], [], [], []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                own = np.append(ids[a:b], END_ID).astype("<u4")
                raw, n = memoryview(own).cast("B"), len(own)
                for s in range(0, n, window):
                    e = min(n, s + window)
                    doc.append(i)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(raw[4 * s : 4 * e]))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(doc, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return only(docs, doc_id="long", text="string").transform(through, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces (with a column ``length``) and their sequence_id and offset.

    Only the counts of lengths, ``window`` numbers at most, reach the driver.  A piece's rank among those of its length
    is its rank within its share (by a hash of its place) plus the sizes of the shares before, so that a length which
    most pieces have is ranked by many tasks.
    """
    spark = found.sparkSession
    shares = partitions(spark)
    found = found.withColumn("_share", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shares)).cast("int"))
    sizes = found.groupBy("length", "_share").agg(F.count(F.lit(1)).alias("_n"))
    histogram = np.zeros(window + 1, np.int64)
    for v, n in sizes.groupBy("length").agg(F.sum("_n")).collect():
        histogram[v] = n
    at = slots(plan_packing(histogram, window))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_share", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = found.join(before, ["length", "_share"]).withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("length", "_share").orderBy("doc_id", "start", "ids_crc32")) - 1)
    names = [c for c in found.columns if c != "_share"]

    def place(batches):
        for batch in batches:
            length, rank = longs(batch.column("length")), longs(batch.column("_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts):
                if len(rows):
                    v = int(length[rows[0]])
                    k = np.searchsorted(at.rank[v], rank[rows], "right") - 1
                    sequence[rows] = at.first[v][k] + rank[rows] - at.rank[v][k]
                    offset[rows] = at.offset[v][k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {t}" for c, t in found.dtypes if c != "_share") + ", sequence_id long, offset long"
    return ranked.select(*names, "_rank").transform(through, place, schema)


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, special: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document.

    A document is its text's ids (none, if null) and the id 0.  Repeated rows are packed as often as they occur; a null
    doc_id stays null; other columns are ignored.  An empty table gives no pieces.
    """
    return pack(staged(pieces(docs, path, window, special), "pieces"), window)


def rank_path() -> str:
    """The rank file that holds the vocabulary of ``byte_bpe_50k.json``; the tests hold the two encodings against each other."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), rank_path())
