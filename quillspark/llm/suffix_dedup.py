"""Operator 4: removal of bytes in 100-byte strings that start earlier too, found by suffix sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranges, table, through
from .deep_shallow import suffix_order
from .repeats import covered, find_repeats, over_texts, places, with_ids, with_texts

WINDOW, GRAM = 100, 24


def repeated_suffixes(key, doc, start, count, size, body: bytes):
    """Places of all suffixes whose first WINDOW bytes are those of an earlier one among the given slices."""
    count = count.astype(np.int64)
    at = np.cumsum(np.append(0, size.astype(np.int64)))[:-1]
    suffix = ranges(at, count)
    owner = np.repeat(np.arange(len(doc)), count)
    place = start[owner].astype(np.int64) + suffix - at[owner]
    buffer = np.concatenate([np.frombuffer(body, np.uint8), np.zeros(WINDOW + 8, np.uint8)])
    order, group = suffix_order(buffer, suffix, WINDOW)
    d, p = doc[owner][order], place[order]
    by = np.lexsort((p, d, group))
    g, d, p = group[by], d[by], p[by]
    head = np.ones(len(g), bool)
    head[1:] = g[1:] != g[:-1]
    first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(g) else np.zeros(0, np.int64)
    gone = (d != d[first]) | (p != p[first])
    return d[gone], p[gone], np.ones(int(gone.sum()), np.int32)


def dedup(docs: DataFrame, with_text: bool = True, whole_hash: bool = False, as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, hash (of the whole text) and kept (bytes left, or text without broken signs).

    A byte goes if a WINDOW-byte string over it also starts earlier: in a document of smaller id, or before it in its
    own.  Null texts are empty, texts below WINDOW bytes stay whole.  Rows that repeat an id and a text are one document
    and get the same result; for other repeated and for null ids see ``places``.  Other columns are ignored.
    """
    placed, shift, ids = places(docs)
    found, plan = find_repeats(placed, shift, "byte", WINDOW, GRAM, True, repeated_suffixes)
    names = ["place", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["hash"] * whole_hash, *["kept"] * with_text]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * whole_hash, *[pa.string() if as_text else pa.binary()] * with_text]
    schema = pa.schema(list(zip(names, kinds)))

    def finish(batches):
        some, size = [], 0
        for place, text, starts, counts in over_texts(batches):
            n = len(text)
            if len(starts):
                gone = covered(n, starts, counts, WINDOW)
                kept = text[~gone].tobytes()
                edge = np.diff(gone.astype(np.int8))
                spans = int((edge == 1).sum()) + int(gone[0])
            else:
                kept, spans = text.tobytes(), 0
            own = [int(np.uint64(xxhash.xxh64_intdigest(text.tobytes(), seed=42)).astype(np.int64))] if whole_hash else []  # F.xxhash64
            some.append((place, n, n - len(kept), spans, hashlib.sha256(kept).hexdigest(), *own, *[kept.decode("utf-8", "ignore") if as_text else kept] * with_text))
            size += len(kept) * with_text + 100
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], schema=schema)
                some, size = [], 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], schema=schema)

    out = with_texts(placed, found, plan.buckets).transform(through, finish, "place long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", hash long" * whole_hash + f", kept {'string' if as_text else 'binary'}" * with_text)
    return with_ids(out, ids)


def dedup_rows(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with what ``dedup`` leaves of the text; rows that lose all of it go.

    Signs of several bytes that a removed run cuts are left out.  Null text stays null.  The row's other columns travel
    with it, joined by doc_id and the hash of the text.
    """
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"))
    bare = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    found = dedup(bare, whole_hash=True, as_text=True).where("n_removed > 0")
    cut = found.select(F.col("doc_id").alias("cut_id"), F.col("hash").alias("cut_hash"), (F.col("n_bytes") > F.col("n_removed")).alias("left"), "kept").dropDuplicates(["cut_id", "cut_hash"])
    joined = keyed.join(cut, F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("hash") == F.col("cut_hash")), "left").where(F.coalesce("left", F.lit(True)))
    text = F.when(F.col("kept").isNull(), F.col("row.text")).otherwise(F.col("kept"))
    return joined.select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), with_text=False)
