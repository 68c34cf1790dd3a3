"""Operator 6: near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Words are runs of letters and digits (ASCII capitals and those of Latin-1 as small ones); shingles are five words in a
row.  A shingle weighs tf * (1 + idf), idf being ln((N + SMOOTH) / (df + SMOOTH)) over its largest value and df the count
of its bucket in a table of fixed size over all documents, less what a bucket holds on average; SMOOTH is above the noise
of that, so that the few copies of one text hardly change its weights.  Signatures (Ioffe 2010) of BANDS x ROWS samples give candidates by equal
bands; a pair is linked if the weighted Jaccard similarity of its whole shingle sets is LEAST or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_CODES, U64, longs, mix64, partitions, prefix_hash, range_hash, ranges, spans_of, staged, table, through, utf8
from .components import components
from .repeats import places, split_at, with_ids, word_codes

SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 16, 4
TABLE_BITS, SLICES, FILTER_BITS = 20, 16, 24
SMOOTH = 50.0
#: Bytes of text of one step: small, so that the samples' arrays stay in the processor's cache.
STEP_BYTES = 1 << 18
#: Members of a group that are compared with its first by one task.
SHARE = 512
#: Members not connected with their group's leader that one task holds against all others.
BLOCK = 128

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def folded(data: np.ndarray) -> np.ndarray:
    out = _FOLD[data]
    if len(out) > 1:
        latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[latin] += 32
    return out


@dataclass
class Bags:
    """Distinct shingles of texts: hash and count of each, where each text's begin, and the digest of each text's words in two halves."""

    shingles: np.ndarray
    counts: np.ndarray
    offsets: np.ndarray
    one: np.ndarray
    two: np.ndarray
    words: np.ndarray


def text_digests(data: np.ndarray, inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of a digest of each text's words, joined by one space."""
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    plain = np.where(inside, data, np.uint8(32))[keep]
    cuts = np.append(0, np.cumsum(keep))[offsets].tolist()
    raw = plain.tobytes()
    digests = b"".join(hashlib.blake2b(raw[i:j].strip(b" "), digest_size=16).digest() for i, j in zip(cuts[:-1], cuts[1:]))
    pairs = np.frombuffer(digests, U64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def bags(data: np.ndarray, offsets: np.ndarray) -> Bags:
    data = folded(data)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_GAP[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = split_at(edge[0::2], edge[1::2], offsets) if len(edge) else (edge, edge)
    codes = word_codes(data, starts, ends)
    at = np.searchsorted(starts, offsets)
    sizes = np.diff(at)
    prefix = prefix_hash(codes)
    one, two = text_digests(data, inside[1:-1], offsets)
    many = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, (sizes > 0).astype(np.int64))
    lo = ranges(at[:-1], many)
    owner = np.repeat(np.arange(len(sizes)), many)
    found = range_hash(prefix, lo, np.minimum(lo + SHINGLE, at[1:][owner]))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(found)))
    return Bags(found[first], counts, np.searchsorted(owner[first], np.arange(len(sizes) + 1)), one, two, sizes)


def bags_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Bags]]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        ids = longs(batch.column(0))
        for lo, hi in spans_of(offsets, STEP_BYTES):
            yield ids[lo:hi], bags(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def shingle_weights(docs: DataFrame) -> np.ndarray:
    """Weight of a shingle by its bucket (float32, 2**TABLE_BITS of them): only sums of fixed size reach the driver."""
    size = 1 << TABLE_BITS

    def count(batches):
        total, n = np.zeros(size, np.int64), 0
        for _, b in bags_of(batches):
            total += np.bincount((b.shingles & U64(size - 1)).astype(np.int64), minlength=size)
            n += int((b.words > 0).sum())
        parts = total.reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES + 1), pa.int32()), pa.array([*(p.astype(np.uint32).tobytes() for p in parts), np.array([n], np.uint32).tobytes()])], ["slice", "counts"])

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64)
                totals[k] = totals[k] + part if k in totals else part
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()])], ["slice", "counts"])

    # first by a few tasks for each slice, then one, so that no task adds the tables of all
    parts = docs.transform(through, count, "slice int, counts binary").repartition(SLICES, "slice").transform(through, add, "slice int, counts binary").collect()
    found = {r[0]: np.frombuffer(r[1], np.int64) for r in parts}
    if not found:
        return np.ones(size, np.float32)
    counts = np.concatenate([found[k] for k in range(SLICES)]).astype(float)
    n = max(2.0, float(found[SLICES][0]))
    df = np.clip(counts - counts.mean(), 1, n)
    return (1 + np.log((n + SMOOTH) / (df + SMOOTH)) / np.log((n + SMOOTH) / (1 + SMOOTH))).astype(np.float32)


class Sampler:
    """Consistent weighted samples.  Each shingle's random numbers are 16-bit quantiles looked up by a hash of it."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        grid = (np.arange(1 << 16) + 0.5) / (1 << 16)
        x = np.linspace(1e-6, 30, 400_000)
        gamma = np.interp(grid, 1 - np.exp(-x) * (1 + x), x).astype(np.float32)  # quantiles of Gamma(2, 1)
        self.r, self.log_c, self.beta = gamma, np.log(gamma), grid.astype(np.float32)
        self.factors = rng.integers(1 << 62, 1 << 63, BANDS * ROWS).astype(U64) * U64(2) + U64(1)

    def bands(self, b: Bags, weights: np.ndarray) -> np.ndarray:
        """texts x BANDS hashes; texts without shingles get zeros."""
        n = len(b.words)
        out = np.zeros((BANDS, n), U64)
        full = np.flatnonzero(np.diff(b.offsets))
        if not len(full):
            return out.T
        starts = b.offsets[:-1][full]
        sizes = np.diff(b.offsets)[full]
        log_s = np.log(b.counts.astype(np.float32) * weights)
        with np.errstate(over="ignore"):
            for k, factor in enumerate(self.factors):
                x = b.shingles * factor
                x ^= x >> U64(32)
                x *= U64(0x9FB21C651E98DF25)
                r = self.r[x >> U64(48)]
                beta = self.beta[x >> U64(32) & U64(0xFFFF)]
                t = np.floor(log_s / r + beta)
                a = self.log_c[x >> U64(16) & U64(0xFFFF)] - r * (t - beta + 1)
                least = np.minimum.reduceat(a, starts)
                hit = np.flatnonzero(a == np.repeat(least, sizes))
                at = hit[np.searchsorted(hit, starts)]
                sample = mix64(b.shingles[at] + t[at].astype(np.int64).astype(U64) * U64(0xA24BAED4963EE407))
                out[k // ROWS, full] = mix64(out[k // ROWS, full] * U64(0x9E3779B97F4A7C15) + sample + U64(k))
        return out.T


def signatures(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, one, two (hashes of the words), bands (array of hashes) of the documents that have words."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        sampler, table_ = Sampler(), shared.value
        for ids, b in bags_of(batches):
            bands = sampler.bands(b, table_[(b.shingles & U64(len(table_) - 1)).astype(np.int64)])
            have = np.flatnonzero(b.words > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(have) + 1, BANDS), pa.int32()), pa.array(np.ascontiguousarray(bands[have]).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[have]), pa.array(b.one[have].view(np.int64)), pa.array(b.two[have].view(np.int64)), lists], ["doc_id", "one", "two", "bands"])

    return docs.transform(through, run, "doc_id long, one long, two long, bands array<long>")


def bitmap(keys: DataFrame) -> np.ndarray:
    """2**FILTER_BITS bits, those of the keys' hashes set; built by partition and joined by a few tasks."""

    def mark(batches):
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[(mix64(longs(batch.column(0)).astype(U64)) >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()])], ["bits"])

    def join(batches):
        total = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            for x in batch.column(0):
                total |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["bits"])

    parts = keys.coalesce(12).transform(through, mark, "bits binary").repartition(2).transform(through, join, "bits binary").collect()
    total = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in parts:
        total |= np.frombuffer(r[0], np.uint8)
    return total


def weighted_sets(docs: DataFrame, weights: np.ndarray, keys: DataFrame) -> DataFrame:
    """doc_id, shingles, weights (packed) of the documents among ``keys``, and of some others by chance."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, bitmap(keys)))

    def wanted(batches, bits):
        for batch in batches:
            place = (mix64(longs(batch.column(0)).astype(U64)) >> U64(64 - FILTER_BITS)).astype(np.int64)
            yield batch.filter(pa.array((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)))

    def run(batches):
        table_, bits = shared.value
        for ids, b in bags_of(wanted(batches, bits)):
            w = (b.counts.astype(np.float32) * table_[(b.shingles & U64(len(table_) - 1)).astype(np.int64)]).astype(np.float32)
            cuts = list(zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([b.shingles[i:j].tobytes() for i, j in cuts], pa.binary()), pa.array([w[i:j].tobytes() for i, j in cuts], pa.binary())], ["doc_id", "shingles", "weights"])

    return docs.transform(through, run, "doc_id long, shingles binary, weights binary")


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Of two sets with their shingles in ascending order."""
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    same = a[at] == b
    both = float(np.minimum(wa[at[same]], wb[same]).sum(dtype=np.float64))
    return both / max(float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - both, 1e-300)


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs (a, b): the sets of all b go to the tasks of their a, SHARE of them or so to each."""
    n = partitions(pairs.sparkSession)
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    ours = sets.join(shares, sets["doc_id"] == shares["a"]).select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("b"), "shingles", "weights")
    theirs = pairs.join(shares, "a").join(sets, pairs["b"] == sets["doc_id"]).select("a", F.expr("cast(pmod(xxhash64(b), shares) as int)").alias("share"), "b", "shingles", "weights")
    rows = ours.unionAll(theirs).repartition(n, "a", "share").sortWithinPartitions("a", "share", F.asc_nulls_first("b"))

    def run(batches):
        own, x, wx = None, None, None
        for batch in batches:
            a, share = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            b, out = batch.column(2).to_pylist(), []
            for i in range(batch.num_rows):
                y, wy = np.frombuffer(batch.column(3)[i].as_buffer(), U64), np.frombuffer(batch.column(4)[i].as_buffer(), np.float32)
                if b[i] is None:
                    own, x, wx = (a[i], share[i]), y.copy(), wy.copy()
                elif own == (a[i], share[i]):
                    out.append((a[i], b[i], weighted_jaccard(x, wx, y, wy)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    return rows.transform(through, run, "a long, b long, similarity double")


def links(groups: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b) of linked pairs, enough to connect all that any links within the groups connect.

    ``groups`` has (g1, g2, doc, many).  Each member of a group is compared with the group's leader, the text with the
    most copies.  Members then connected with the leader need no comparison with each other; each of the rest, x, is
    compared with the members y that the triangle inequality of the distance (1 - similarity) leaves: to be linked, their
    distances to the leader must differ by 1 - least at most.  Those comparisons go in blocks: BLOCK of the rest meet all
    members of their group.
    """
    n, reach = partitions(groups.sparkSession), 1 - least
    first = groups.groupBy("g1", "g2").agg(F.max_by("doc", F.struct("many", -F.col("doc"))).alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    led = staged(groups.join(first, ["g1", "g2"]).where("doc <> a").select("g1", "g2", "a", F.col("doc").alias("b")), "led")
    near = staged(similarities(led.select("a", "b").distinct(), sets), "similarities")
    good = near.where(F.col("similarity") >= least).select("a", "b")
    parts = staged(components(good), "first-parts")
    ids = lambda name: parts.select(F.col("id").alias(name), F.col("component").alias(f"part_{name}"))
    members = led.join(near, ["a", "b"]).join(ids("a"), "a", "left").join(ids("b"), "b", "left")
    settled = F.coalesce("part_a", "a") == F.coalesce("part_b", "b")
    members = staged(members.select("g1", "g2", F.col("b").alias("doc"), (1 - F.col("similarity")).alias("d"), (~settled).alias("rest")), "members")
    rests = members.groupBy("g1", "g2").agg(F.count_if("rest").alias("rests"), F.count(F.lit(1)).alias("n")).where("rests > 0 and n > 1").select("g1", "g2", F.ceil(F.col("rests") / BLOCK).cast("int").alias("blocks"))
    some = members.join(rests, ["g1", "g2"])
    left = some.where("rest").select("g1", "g2", F.expr("cast(pmod(xxhash64(doc), blocks) as int)").alias("block"), F.lit(0).alias("side"), "doc", "d", "rest")
    right = some.select("g1", "g2", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "doc", "d", "rest")
    rows = left.unionAll(right).join(sets.withColumnRenamed("doc_id", "doc"), "doc").select("g1", "g2", "block", "side", "doc", "d", "rest", "shingles", "weights")
    rows = rows.repartition(n, "g1", "g2", "block").sortWithinPartitions("g1", "g2", "block", "side")

    def run(batches):
        own, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            side, doc, d, rest = (batch.column(i).to_pylist() for i in range(3, 7))
            out = []
            for i, key in enumerate(keys):
                y, wy = np.frombuffer(batch.column(7)[i].as_buffer(), U64), np.frombuffer(batch.column(8)[i].as_buffer(), np.float32)
                if key != own:
                    own, held = key, []
                if not side[i]:
                    held.append((doc[i], d[i], y.copy(), wy.copy()))
                    continue
                for x, dx, sx, wx in held:
                    if x != doc[i] and (not rest[i] or x < doc[i]) and abs(dx - d[i]) <= reach + 1e-6 and weighted_jaccard(sx, wx, y, wy) >= least:
                        out.append((x, doc[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    more = staged(rows.transform(through, run, "a long, b long"), "similar")
    return good.unionAll(more)


def clusters(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its cluster), kept (it is that document) of every row.

    A cluster is a connected component of links.  Documents with equal words are one in all comparisons.  Texts of less
    than five words are one shingle; texts without words, null or empty, are clusters of their own.  Rows of one doc_id
    and text are one document; for other repeated ids and null ids see ``places``.  Other columns are ignored.
    """
    placed, _, ids = places(docs)
    found = _clusters(placed, least).select("place", F.col("class").alias("class_id"), (F.col("place") == F.col("class")).alias("kept"))
    if ids is not None:
        heads = ids.select(F.col("place").alias("class_id"), F.col("id").alias("head"))
        found = found.join(heads, "class_id").select("place", F.col("head").alias("class_id"), "kept")
    return with_ids(found, ids)


def _clusters(placed: DataFrame, least: float) -> DataFrame:
    weights = shingle_weights(placed)
    signed = staged(signatures(placed, weights), "signatures")
    classes = staged(signed.groupBy("one", "two").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("many"), F.first("bands").alias("bands")), "text-classes")
    banded = classes.select("doc", "many", F.posexplode("bands").alias("g1", "g2"))
    several = banded.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g1", "g2")
    groups = staged(banded.join(several, ["g1", "g2"]), "groups")
    sets = staged(weighted_sets(placed, weights, groups.select("doc").distinct()), "sets")
    parts = components(links(groups, sets, least))
    known = signed.join(classes.select("one", "two", "doc"), ["one", "two"]).join(parts, F.col("doc") == parts["id"], "left").select("doc_id", F.coalesce("component", "doc").alias("class")).distinct()
    return placed.select("doc_id").join(known, "doc_id", "left").select(F.col("doc_id").alias("place"), F.coalesce("class", "doc_id").alias("class"))


def dedup(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their cluster; see ``clusters``.

    Of equal rows one stays, of rows of one doc_id with different texts those that are no copies of an earlier one.
    """
    names = docs.columns
    placed, _, ids = places(docs)
    found = _clusters(placed, least)
    if ids is None:
        gone = found.where("place <> class").select(F.col("place").alias("doc_id"))
        return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in names])
    # repeated or null ids: rows are told apart by their texts' places
    texts = ids.join(found.where("place = class"), "place", "left_semi").select(F.col("id").alias("_id"), F.xxhash64("text").alias("_hash")).distinct()
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    keyed = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash")).dropDuplicates(["id", "hash"])
    kept = keyed.join(texts, keyed["id"].eqNullSafe(texts["_id"]) & (keyed["hash"] == texts["_hash"]), "left_semi")
    return kept.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(names)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "documents"))
