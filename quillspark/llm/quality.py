"""Operator 1: quality scores by random Fourier features over document statistics, ridge regression and isotonic steps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_CODES, only, prefix_hash, range_hash, spans_of, staged, table, through, utf8, word_ranges

#: Random features, kernel width in standard deviations, ridge, and bins of the calibration.
FEATURES, SPREAD, RIDGE, BINS, SEED = 256, 3.0, 1e-3, 1024, 11
STATISTICS = (
    "log_bytes", "letters", "capitals", "digits", "spaces", "lines", "stops", "commas", "bars", "shouts", "signs",
    "wide", "word_length", "word_spread", "short_words", "long_words", "distinct_words", "distinct_lines", "line_length",
    "capital_words", "byte_entropy", "odd_ends",
)


def _mask(signs: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(signs)] = True
    return out


_UPPER, _LOWER, _DIGIT = (_mask(bytes(range(a, b))) for a, b in ((65, 91), (97, 123), (48, 58)))
_KINDS = [_UPPER | _LOWER, _UPPER, _DIGIT, _mask(b" \t"), _mask(b"\n"), _mask(b".?"), _mask(b",;:"), _mask(b"|"), _mask(b"!"), _mask(b"#$%&*<>{}[]\\^~@=+_/`"), np.arange(256) >= 128]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """STATISTICS of each of the texts that lie one after the other; all are 0 for an empty text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    sizes = np.diff(offsets)
    safe = np.maximum(sizes, 1)
    out[:, 0] = np.log1p(sizes)

    def per_text(values: np.ndarray, at: np.ndarray = offsets) -> np.ndarray:
        upto = np.append(0.0, np.cumsum(values, dtype=np.float64))
        return upto[at[1:]] - upto[at[:-1]]

    for k, mask in enumerate(_KINDS):
        out[:, 1 + k] = per_text(mask[data]) / safe
    starts, ends = word_ranges(data)
    inner = offsets[1:-1]
    cut = inner[(inner > 0) & (inner < len(data))]
    if len(cut) and len(starts):  # words end where texts do
        owner = np.searchsorted(starts, cut, "right") - 1
        cut = np.unique(cut[(owner >= 0) & (cut > starts[np.maximum(owner, 0)]) & (cut < ends[np.maximum(owner, 0)])])
        starts, ends = np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))
    at = np.searchsorted(starts, offsets)
    words = np.maximum(np.diff(at), 1)
    lengths = (ends - starts).astype(float)
    mean = per_text(lengths, at) / words
    out[:, 12] = mean
    out[:, 13] = np.sqrt(np.maximum(per_text(lengths**2, at) / words - mean**2, 0))
    out[:, 14] = per_text(lengths <= 3, at) / words
    out[:, 15] = per_text(lengths >= 12, at) / words
    if len(starts):
        text_of = np.repeat(np.arange(n), np.diff(at))
        out[:, 16] = distinct(data, starts, ends, text_of, n) / words
        out[:, 19] = per_text(_UPPER[data[starts]], at) / words
        out[:, 21] = per_text(_KINDS[9][data[ends - 1]], at) / words
    line_at = np.flatnonzero(data == 10)
    edges = np.union1d(np.append(line_at + 1, offsets[:-1]), [])
    edges = edges[edges < len(data)].astype(np.int64)
    if len(edges):
        line_end = np.append(edges[1:], len(data))
        line_of = np.searchsorted(offsets, edges, "right") - 1
        lines = np.maximum(np.bincount(line_of, minlength=n), 1)
        out[:, 17] = distinct(data, edges, line_end, line_of, n) / lines
        out[:, 18] = np.log1p(sizes / lines)
    text_of = np.repeat(np.arange(n), sizes)
    counts = np.bincount(text_of * 256 + data, minlength=256 * n).reshape(n, 256) if len(data) else np.zeros((n, 256))
    share = counts / safe[:, None]
    out[:, 20] = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    return out


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many different ranges of bytes each owner has."""
    with np.errstate(over="ignore"):
        mark = range_hash(prefix_hash(BYTE_CODES[data]), starts, ends) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, first = np.unique(mark, return_index=True)
    return np.bincount(owner[first], minlength=n).astype(float)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics (array of doubles), of whole texts; null texts are empty."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in spans_of(offsets, 1 << 20):
                found = statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["doc_id", "stats"])

    return only(docs, doc_id="long", text="string").transform(through, run, "doc_id long, stats array<double>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    edges: np.ndarray  # raw scores
    levels: np.ndarray  # calibrated ones, by np.interp

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2.0 / FEATURES) * np.cos(x @ self.omega + self.phase)
        return np.concatenate([z, np.ones((len(z), 1))], 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(stats) @ self.weights, self.edges, self.levels), 0, 1)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def summed(df: DataFrame, columns: list[str], size: int, add) -> np.ndarray:
    """The sum of ``add(batch)``, an array of ``size`` numbers, over all rows: by partition, then by a few tasks, then here."""

    def partial(batches):
        total = np.zeros(size)
        for batch in batches:
            total += add(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def join(batches):
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = df.select(*columns).transform(through, partial, "sums binary").repartition(8).transform(through, join, "sums binary").collect()
    return np.sum([np.frombuffer(r[0], np.float64) for r in parts], axis=0) if parts else np.zeros(size)


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing levels nearest to y/n by weighted squares (pool adjacent violators); bins with n = 0 are left out by the caller."""
    blocks: list[list[float]] = []
    for s, w in zip(y.tolist(), n.tolist()):
        blocks.append([s, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, w2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + w2, blocks[-1][2] + k2]
    return np.concatenate([np.full(k, s / w) for s, w, k in blocks])


def fit(labelled: DataFrame) -> Model:
    """Model of rows (doc_id, stats, y in 0/1).  Three passes sum moments, normal equations and calibration bins.

    Nine tenths of the rows (by a hash of doc_id) fit the weights, the rest the calibration.  Without rows, or with one
    class, the score is that class's share for all (0.5 without rows).
    """
    d = len(STATISTICS)
    rng = np.random.default_rng(SEED)
    omega, phase = rng.normal(0, 1 / (SPREAD * np.sqrt(d) / 2), (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    labelled = labelled.withColumn("calibrate", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(10)) == 0)

    def moments(batch):
        x = matrix(batch.column(0))
        return np.concatenate([[len(x), batch.column(1).to_numpy(zero_copy_only=False).sum()], x.sum(0), (x * x).sum(0)])

    m = summed(labelled, ["stats", "y"], 2 + 2 * d, moments)
    n, ones = m[0], m[1]
    mean = m[2 : 2 + d] / max(n, 1)
    scale = np.sqrt(np.maximum(m[2 + d :] / max(n, 1) - mean**2, 0))
    scale[scale < 1e-9] = 1
    model = Model(mean, scale, omega, phase, np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.full(2, ones / n if n else 0.5))
    if not n or ones in (0, n):
        return model
    size = FEATURES + 1

    def equations(batch):
        z = model.features(matrix(batch.column(0)))
        y = batch.column(1).to_numpy(zero_copy_only=False)
        use = ~np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
        z, y = z[use], y[use]
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    s = summed(labelled, ["stats", "y", "calibrate"], size * size + size, equations)
    gram = s[: size * size].reshape(size, size)
    weights = np.linalg.solve(gram + RIDGE * max(1.0, np.trace(gram) / size) * np.eye(size), s[size * size :])
    ridge = Model(mean, scale, omega, phase, weights, model.edges, model.levels)

    def bins(batch):
        use = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
        raw = ridge.features(matrix(batch.column(0)))[use] @ weights
        y = batch.column(1).to_numpy(zero_copy_only=False)[use]
        at = np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS), np.bincount(at, weights=raw, minlength=BINS)])

    b = summed(labelled, ["stats", "y", "calibrate"], 3 * BINS, bins).reshape(3, BINS)
    have = np.flatnonzero(b[0])
    if not len(have):
        return Model(mean, scale, omega, phase, weights, model.edges, np.array([0.0, 1.0]))
    # half an observation of each class keeps the ends from being certain
    prior = ones / n
    levels = isotonic(b[1][have] + 0.02 * prior, b[0][have] + 0.02)
    edges = b[2][have] / b[0][have]
    return Model(mean, scale, omega, phase, weights, edges, levels)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of rows (doc_id, stats)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(matrix(batch.column(1))))], ["doc_id", "score"])

    return stats.select("doc_id", "stats").transform(through, run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Learned from labels (0 or 1; others are ignored) of documents that aren't held out.  Repeated rows are scored each;
    a null doc_id is not held out and has no label; null texts score as empty ones; other columns are ignored.
    """
    stats = staged(document_statistics(docs), "statistics")
    marks = only(labels, doc_id="long", quality="int").where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    labelled = staged(stats.join(marks, "doc_id").select("doc_id", "stats", F.col("quality").cast("double").alias("y")), "labelled")
    scored = score(stats, fit(labelled))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
