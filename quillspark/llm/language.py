"""Operator 10: language identification by averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, spans_of, table, through, utf8

#: Buckets and width of the subword embeddings; subwords are runs of so many bytes.
BUCKETS_BITS, WIDTH, GRAMS = 15, 16, (2, 3, 4)
#: About so many labelled documents are learned from at most, shared evenly by the languages, but LEAST_ROWS of each
#: language however many there are; every fifth is held back to calibrate.
SAMPLE, LEAST_ROWS, EPOCHS, RATE = 3000, 10, 4, 0.5
#: Share of rightly labelled documents that may be rejected when calibrating.
LOST = 0.002
UNDETERMINED = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _b in range(128):
    if not (97 <= _FOLD[_b] <= 122):
        _FOLD[_b] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def subwords(data: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the subword that starts at each byte; signs other than letters count as spaces, capitals as small."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    x = np.full(n, size, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(size):
            x = (x ^ data[i : i + n]) * _FACTORS[i]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
    return (x >> np.uint32(32 - BUCKETS_BITS)).astype(np.int64)


def sums(values: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``values`` (one for each subword start) over each text."""
    starts, ends = offsets[:-1], np.maximum(offsets[1:] - size + 1, offsets[:-1])
    out = np.zeros((len(starts), values.shape[1]))
    full = np.flatnonzero(ends > starts)
    if len(full):
        cuts = np.stack([starts[full], ends[full]], 1).ravel()
        if cuts[-1] >= len(values):
            cuts = cuts[:-1]
        out[full] = np.add.reduceat(values, cuts, axis=0, dtype=np.float64)[::2]
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    embedding: np.ndarray  # buckets x WIDTH
    output: np.ndarray  # WIDTH x languages
    bias: np.ndarray
    heat: float = 1.0
    least: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of texts that lie one after the other."""
        data = _FOLD[data]
        narrow = len(self.languages) <= WIDTH
        values = ((self.embedding @ self.output) if narrow else self.embedding).astype(np.float32)
        total = np.zeros((len(offsets) - 1, values.shape[1]))
        for size in GRAMS:
            total += sums(values[subwords(data, size)], offsets, size)
        sizes = np.diff(offsets)
        n = sum(np.maximum(sizes - g + 1, 0) for g in GRAMS)
        mean = total / np.maximum(n, 1)[:, None]
        return (mean if narrow else mean @ self.output) + self.bias

    def scores(self, logits: np.ndarray) -> np.ndarray:
        z = logits * self.heat
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> Model:
    """Stochastic gradient descent, one document a step; every fifth document only sets the heat and the least score.

    The heat is the factor of the logits with the least log loss on those; the least score lets LOST of their right
    predictions go at most.
    """
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (1 << BUCKETS_BITS, WIDTH))
    output = rng.normal(0, 0.1, (WIDTH, len(languages)))
    bias = np.zeros(len(languages))
    target = np.array([languages.index(v) for v in labels])
    held = np.arange(len(texts)) % 5 == 4
    bags = []
    for text in texts:
        data = _FOLD[np.frombuffer(text, np.uint8)]
        found = np.concatenate([subwords(data, g) for g in GRAMS])
        at, n = np.unique(found, return_counts=True)
        bags.append((at, n / max(1, n.sum())))
    fit = np.flatnonzero(~held)
    steps, step = max(1, EPOCHS * len(fit)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit).tolist():
            at, weight = bags[i]
            rate = RATE * (1 - step / steps)
            step += 1
            if not len(at):
                continue
            rows = embedding[at]
            hidden = weight @ rows
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            back = output @ p
            output -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            embedding[at] = rows - (rate * len(at) ** 0.5) * np.outer(weight, back)
    model = Model(languages, embedding.astype(np.float32), output.astype(np.float32), bias)
    check = np.flatnonzero(held & np.array([len(b[0]) > 0 for b in bags], bool)) if len(bags) else held
    if not len(check):
        return model
    some = [texts[i] for i in check.tolist()]
    logits = model.logits(np.frombuffer(b"".join(some), np.uint8), np.append(0, np.cumsum([len(t) for t in some])))
    want = target[check]
    heats = 2.0 ** np.arange(-3, 6.5, 0.5)
    losses = []
    for heat in heats:
        z = logits * heat
        z -= z.max(1, keepdims=True)
        losses.append((np.log(np.exp(z).sum(1)) - z[np.arange(len(want)), want]).mean())
    heat = float(heats[int(np.argmin(losses))])
    p = Model(languages, model.embedding, model.output, bias, heat).scores(logits)
    right = np.sort(p.max(1)[p.argmax(1) == want])
    least = min(0.5, float(right[int(LOST * len(right))])) * 0.999 if len(right) else 0.0
    return Model(languages, model.embedding, model.output, bias, heat, least)


def learned_rows(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) != 2


def fit(docs: DataFrame) -> Model | None:
    """Learn from the documents that ``learned_rows`` allows and that have a language; None if there are none."""
    docs = only(docs, doc_id="long", text="string", lang="string").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learned_rows(F.col("doc_id")))
    counts = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return None
    quota = max(SAMPLE / len(counts), LEAST_ROWS)
    share = F.create_map(*[F.lit(x) for c in counts for x in (c["lang"], int(min(1.0, quota / c["count"]) * (1 << 30)))])
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.coalesce(share[F.col("lang")], F.lit(0)))
    rows = sample.orderBy(F.xxhash64("doc_id"), "text").limit(int(2 * quota * len(counts))).collect()
    return train([r["text"].encode() for r in rows], [r["lang"] for r in rows]) if rows else None


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.append(0, np.cumsum(_ASCII_LETTER[data]))
    out = upto[offsets[1:]] > upto[offsets[:-1]]
    for i in np.flatnonzero(~out).tolist():
        text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
        out[i] = any(unicodedata.category(c)[0] == "L" for c in text)
    return out


def judged(text: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Label, score and whether it is rejected, of each text."""
    data, offsets = utf8(text)
    labels, scores, rejected = [], [np.zeros(0)], [np.zeros(0, bool)]
    for lo, hi in spans_of(offsets, 1 << 20):
        part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        known = has_letter(part, offs)
        if model is None:
            known[:] = False
            best, score = np.zeros(hi - lo, np.int64), np.zeros(hi - lo)
        else:
            p = model.scores(model.logits(part, offs))
            best, score = p.argmax(1), p.max(1)
        labels += [model.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist())]
        scores.append(np.where(known, score, 0.0))
        rejected.append(~known | (score < (model.least if model else 0)))
    return labels, np.concatenate(scores), np.concatenate(rejected)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` and lang_pred, lang_score, lang_rejected; by the column ``text`` alone.

    Text that is null or has no letter is ``und`` with score 0 and rejected; so is all text if nothing could be learned.
    Other text is rejected if its score is below the calibrated least score.  Columns of ``docs`` with the names of the
    three give way to them.
    """
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())]
    docs = docs.drop(*[f.name for f in added])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: buckets x width

    def run(batches):
        for batch in batches:
            labels, scores, rejected = judged(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores), pa.array(rejected)], [*batch.schema.names, "lang_pred", "lang_score", "lang_rejected"])

    return docs.transform(through, run, T.StructType([*docs.schema.fields, *added]))


def recognised(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that ``identify`` does not reject, with all their columns, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~judged(batch.column("text"), shared.value)[2]))

    return docs.transform(through, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(only(docs, doc_id="long", text="string"), fit(docs))
    return found.select("doc_id", F.coalesce(~learned_rows(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
