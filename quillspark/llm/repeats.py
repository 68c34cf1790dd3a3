"""Exact search for windows that repeat across a corpus, without shuffling every window.

A window is ``window`` consecutive units (bytes, or words) of one document.  Each window has an anchor: the start of
its ``gram``-unit piece of least hash, the leftmost of equals.  Equal windows have equal anchors at equal offsets, so a
window can repeat only where its anchor's piece does.  Consecutive windows with the same anchor form a slice.

1. ``anchors``: every document's slices, as (key: hash of the anchor's piece, mark: hash of the whole slice, place).
   Copies of one slice within a task are settled there; one of each goes on to the task of its key.
2. There, slices whose key occurs once are dropped, copies of a slice are settled by their first, and of slices that
   share only the key one each is asked for.
3. The asked slices are cut from the texts and go to the task of their key, which compares their windows exactly.

Keys that very many different slices share (the rims of widely copied passages) are known from a sample of documents;
the sample decides only the route: such keys are spread by slice, and their windows later by window.

Rows between steps hold packed arrays: (bucket, kind, payload).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, CHUNK_BYTES, U64, by_bucket, bytes_hash, chain_hash, digest_long, longs, mix64, only, pack, partitions, powers, prefix_hash, range_hash, ranges, spans_of, staged, through, unpack, utf8, word_ranges

ROWS = "bucket int, kind int, payload binary"
ROWS_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
SETTLED, ASKED, ANCHOR, TEXT = 0, 1, 2, 3
#: Slices held by one task before they are packed and sent.
FLUSH = 750_000
#: A key that is in so many of the sampled documents is spread; as many keys are kept at most.
HEAVY_DOCS, HEAVY_KEYS, SAMPLE = 24, 1 << 16, 64
#: Different slices of one key that one task compares before they are spread by window.
WIDE = 20_000


@dataclass(frozen=True)
class Plan:
    """``earlier_place``: a copy may start earlier in the same document; else only in a document of smaller id."""

    unit: str
    window: int
    gram: int
    earlier_place: bool
    buckets: int
    shift: int = 0  # bits of a place below the document's id, see ``places``

    @property
    def span(self) -> int:
        return self.window - self.gram + 1


@dataclass
class Units:
    """Unit codes of the documents of a chunk; ``base`` is the number of units before each in its own document."""

    codes: np.ndarray
    bounds: np.ndarray
    docs: np.ndarray
    base: np.ndarray
    raw: np.ndarray | None = None


def segments(plan: Plan, docs: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> Iterator[Units]:
    """Chunks of whole documents; a document of more units than a chunk holds is cut, with window - 1 units twice."""
    for lo, hi in spans_of(offsets):
        part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if plan.unit == "byte":
            if hi - lo == 1 and len(part) > CHUNK_BYTES:
                for at in range(0, len(part) - plan.window + 1, CHUNK_BYTES):
                    cut = part[at : at + CHUNK_BYTES + plan.window - 1]
                    yield Units(BYTE_CODES[cut], np.array([0, len(cut)]), docs[lo:hi], np.array([at]), cut)
                continue
            yield Units(BYTE_CODES[part], offs, docs[lo:hi], np.zeros(hi - lo, np.int64), part)
        else:
            starts, ends = word_ranges(part)
            if hi - lo > 1 and len(starts):  # words end where documents do
                starts, ends = split_at(starts, ends, offs)
            codes = word_codes(part, starts, ends)
            bounds = np.searchsorted(starts, offs)
            if hi - lo == 1 and len(codes) > CHUNK_BYTES:
                for at in range(0, len(codes) - plan.window + 1, CHUNK_BYTES):
                    cut = codes[at : at + CHUNK_BYTES + plan.window - 1]
                    yield Units(cut, np.array([0, len(cut)]), docs[lo:hi], np.array([at]))
                continue
            yield Units(codes, bounds, docs[lo:hi], np.zeros(hi - lo, np.int64))


def split_at(starts: np.ndarray, ends: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut the ranges at the given offsets."""
    inner = offs[1:-1]
    owner = np.searchsorted(starts, inner, "right") - 1
    cut = np.unique(inner[(owner >= 0) & (inner > starts[np.maximum(owner, 0)]) & (inner < ends[np.maximum(owner, 0)])])
    if not len(cut):
        return starts, ends
    return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if len(data) <= CHUNK_BYTES + 4096:
        return digest_long(range_hash(prefix_hash(BYTE_CODES[data]), starts, ends), data, starts, ends)
    out, at = [], 0
    while at < len(starts):  # pieces of whole words keep the hash's powers short
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK_BYTES, "right")))
        piece = data[starts[at] : ends[to - 1]]
        out.append(range_hash(prefix_hash(BYTE_CODES[piece]), starts[at:to] - starts[at], ends[at:to] - starts[at]))
        at = to
    return digest_long(np.concatenate(out), data, starts, ends) if out else np.zeros(0, U64)


def slices(plan: Plan, u: Units) -> tuple[np.ndarray, ...]:
    """key, mark, doc, start, count, back of every slice: windows start, start+1, ... (count); the anchor lies ``back`` after the last."""
    n, w = len(u.codes), plan.window
    sizes = np.diff(u.bounds)
    windows = np.maximum(sizes - w + 1, 0)
    if not windows.sum():
        return (np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(0, np.uint8))
    bits = U64(21)  # chunks hold fewer than 2**21 units
    prefix = prefix_hash(u.codes)
    with np.errstate(over="ignore"):
        gram = mix64((prefix[plan.gram :] - prefix[: -plan.gram]) * powers(len(prefix))[1][: n - plan.gram + 1])
    least = ((gram >> bits) << bits) | np.arange(len(gram), dtype=U64)
    width = 1
    while width * 2 <= plan.span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = plan.span - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    start = ranges(u.bounds[:-1], windows)
    anchor = (least[start] & U64((1 << 21) - 1)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    lo, at = start[first], anchor[first]
    hi = lo + count - 1
    mark = chain_hash(u.codes, lo, count + (w - 1)) if u.raw is None else bytes_hash(u.raw, lo, count + (w - 1))
    with np.errstate(over="ignore"):
        mark = mix64(mark + (at - lo).astype(U64))
    doc = np.searchsorted(u.bounds, lo, "right") - 1
    return gram[at], mark, u.docs[doc], (lo - u.bounds[doc] + u.base[doc]).astype(np.int32), count.astype(np.uint8), (at - hi).astype(np.uint8)


def settle(plan: Plan, key, mark, doc, start, count, back, heavy: np.ndarray | None = None, final: bool = False):
    """Of copies of a slice: which are repeats for sure, and which go on (indices).

    ``final``: these are all slices of their keys, so keys with one kind of slice end here.
    """
    order = np.lexsort((start, doc, mark, key))
    k, m, d = key[order], mark[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    s = start[order]
    if plan.earlier_place:
        gone = (d != d[head]) | (s != s[head])
    else:
        gone = (d >> plan.shift) != (d[head] >> plan.shift)
    keep = ~gone
    keep[1:] &= new[1:] | (d[1:] != d[:-1]) | (s[1:] != s[:-1])  # a repeated row is the same place
    if final:
        newkey = np.ones(len(order), bool)
        newkey[1:] = k[1:] != k[:-1]
        number = np.cumsum(newkey) - 1
        kinds = np.bincount(number, weights=new)[number] if len(order) else np.zeros(0)
        several = kinds > 1
        if heavy is not None and len(heavy):
            several |= member(k, heavy)
        keep &= several
        return order[gone], order[keep], kinds[keep]
    return order[gone], order[keep], None


def member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x


def doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(doc.astype(U64)) % U64(buckets)).astype(np.int32)


def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.binary())], schema=ROWS_ARROW)


def sized(found: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    some, size = [], 0
    for f in found:
        some.append(f)
        size += len(f[2])
        if size > 4 << 20 or len(some) > 5000:
            yield rows(some)
            some, size = [], 0
    if some:
        yield rows(some)


def anchors(plan: Plan, heavy: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[tuple[int, int, bytes]]:
            key, mark, doc, start, count, back = (np.concatenate(c) for c in zip(*held))
            gone, on, _ = settle(plan, key, mark, doc, start, count, back)
            for b, p in by_bucket(doc_bucket(doc[gone], plan.buckets), (doc[gone], start[gone], count[gone])):
                yield b, SETTLED, p
            on = on[np.lexsort((start[on], doc[on]))]
            route = np.where(member(key[on], heavy), mix64(key[on] ^ mark[on]), key[on])
            for b, p in by_bucket(((route >> U64(7)) % U64(plan.buckets)).astype(np.int32), (key[on], mark[on], doc[on], start[on], count[on], back[on])):
                yield b, ANCHOR, p

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for u in segments(plan, longs(batch.column(0)), data, offsets):
                found = slices(plan, u)
                held.append(found)
                size += len(found[0])
                if size > FLUSH:
                    yield from sized(flush())
                    held, size = [], 0
        if held:
            yield from sized(flush())

    return run


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """Rows (kind, payload) of each bucket in turn, of a stream sorted by bucket."""

    def flat():
        for batch in batches:
            cols = [batch.column(i) for i in range(3)]
            for i in range(batch.num_rows):
                yield cols[0][i].as_py(), cols[1][i].as_py(), cols[2][i].as_buffer()

    stream = flat()
    row = next(stream, None)
    while row is not None:
        bucket = row[0]

        def inner():
            nonlocal row
            while row is not None and row[0] == bucket:
                yield row[1], row[2]
                row = next(stream, None)

        mine = inner()
        yield bucket, mine
        for _ in mine:
            pass


SLICE = ("u8", "u8", "i8", "i4", "u1", "u1")


def compare_keys(plan: Plan, heavy: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for bucket, stream in buckets_of(batches):
                some = []
                for kind, payload in stream:
                    if kind == SETTLED:
                        yield bucket, SETTLED, bytes(payload)
                    else:
                        some.append(unpack(payload, *SLICE))
                if not some:
                    continue
                key, mark, doc, start, count, back = (np.concatenate(c) for c in zip(*some))
                gone, on, kinds = settle(plan, key, mark, doc, start, count, back, heavy, final=True)
                for b, p in by_bucket(doc_bucket(doc[gone], plan.buckets), (doc[gone], start[gone], count[gone])):
                    yield b, SETTLED, p
                wide = ((kinds > WIDE) | member(key[on], heavy)).astype(np.uint8)
                for b, p in by_bucket(doc_bucket(doc[on], plan.buckets), (key[on], doc[on], start[on], count[on], back[on], wide)):
                    yield b, ASKED, p

        yield from sized(found())

    return run


def pack_texts(buckets: int):
    """Texts by the bucket of their document, compressed: (bucket, TEXT, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)

        def found():
            for batch in batches:
                data, offsets = utf8(batch.column(1))
                docs = longs(batch.column(0))
                for lo, hi in spans_of(offsets, 8 << 20):
                    bucket = doc_bucket(docs[lo:hi], buckets)
                    order = np.argsort(bucket, kind="stable")
                    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                    for one in np.split(order, cuts):
                        one = one + lo
                        sizes = (offsets[one + 1] - offsets[one]).astype(np.int64)
                        body = b"".join(data[offsets[i] : offsets[i + 1]].tobytes() for i in one.tolist())
                        head = np.array([len(one)], np.int64).tobytes() + pack(docs[one], sizes)
                        yield int(bucket[one[0] - lo]), TEXT, squeeze.compress(head + body)

        yield from sized(found())

    return run


def open_texts(payload) -> Iterator[tuple[int, np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(bytes(payload))
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    docs, sizes = unpack(raw[8 : 8 + 16 * n], "i8", "i8")
    body, at = np.frombuffer(raw, np.uint8), 8 + 16 * n
    for i in range(n):
        yield int(docs[i]), body[at : at + sizes[i]]
        at += int(sizes[i])


ASK = ("u8", "i8", "i4", "u1", "u1", "u1")


def grouped(columns: list[list[np.ndarray]], by: int) -> tuple[dict[int, tuple[int, int]], list[np.ndarray]]:
    """Columns sorted by one of them, and the range of each of its values."""
    cols = [np.concatenate(c) for c in zip(*columns)] if columns else []
    if not cols:
        return {}, []
    order = np.argsort(cols[by], kind="stable")
    cols = [c[order] for c in cols]
    values, first = np.unique(cols[by], return_index=True)
    last = np.append(first[1:], len(order))
    return {int(v): (int(a), int(b)) for v, a, b in zip(values, first, last)}, cols


def cut_slices(plan: Plan):
    """Asked slices with their content, to the bucket of their key; those of wide keys window by window, by content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for _, stream in buckets_of(batches):
                asked, where, cols = [], None, []
                held, size = [], 0
                for kind, payload in stream:  # ASKED sorts before TEXT
                    if kind == ASKED:
                        asked.append(unpack(payload, *ASK))
                        continue
                    if where is None:
                        where, cols = grouped(asked, 1)
                    if not where:
                        continue
                    for doc, text in open_texts(payload):
                        if doc not in where:
                            continue
                        lo, hi = where[doc]
                        key, _, start, count, back, wide = (c[lo:hi] for c in cols)
                        if plan.unit == "word":
                            starts, ends = word_ranges(text)
                            if not len(starts):
                                continue
                            at = lambda i, n: b" ".join(text[a:b].tobytes() for a, b in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist()))
                        else:
                            raw = text.tobytes()
                            at = lambda i, n: raw[i : i + n]
                        for k, s, c, w in zip(key.tolist(), start.tolist(), count.tolist(), wide.tolist()):
                            if w:
                                for i in range(s, s + c):
                                    body = at(i, plan.window)
                                    held.append((hash_bytes(body), doc, i, 1, body))
                                    size += len(body) + 32
                            else:
                                body = at(s, c + plan.window - 1)
                                held.append((k, doc, s, c, body))
                                size += len(body) + 32
                        if size > 8 << 20:
                            yield from packed(plan, held)
                            held, size = [], 0
                if held:
                    yield from packed(plan, held)

        yield from sized(found())

    return run


def hash_bytes(body: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(body)


def packed(plan: Plan, held: list) -> Iterator[tuple[int, int, bytes]]:
    key = np.array([h[0] for h in held], U64)
    bucket = ((key >> U64(7)) % U64(plan.buckets)).astype(np.int32)
    order = np.lexsort((key, bucket))
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for one in np.split(order, cuts):
        some = [held[i] for i in one.tolist()]
        body = b"".join(h[4] for h in some)
        head = np.array([len(some)], np.int64).tobytes() + pack(key[one], np.array([h[1] for h in some], np.int64), np.array([h[2] for h in some], np.int32), np.array([h[3] for h in some], np.uint8), np.array([len(h[4]) for h in some], np.int32))
        yield int(bucket[one[0]]), ANCHOR, head + body


def open_slices(payload) -> tuple[list[np.ndarray], bytes]:
    raw = bytes(payload)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return unpack(raw[8 : 8 + 25 * n], "u8", "i8", "i4", "u1", "i4"), raw[8 + 25 * n :]


def compare_slices(plan: Plan, repeated: Callable):
    """``repeated(key, doc, start, count, size, body)`` gives (doc, start, count) of windows that repeat earlier ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for _, stream in buckets_of(batches):
                some = [open_slices(payload) for _kind, payload in stream]
                cols = [np.concatenate(c) for c in zip(*(s[0] for s in some))]
                doc, start, count = repeated(*cols, b"".join(s[1] for s in some))
                for b, p in by_bucket(doc_bucket(doc, plan.buckets), (doc, start.astype(np.int32), count.astype(np.int32))):
                    yield b, ASKED, p  # counts are four bytes here

        yield from sized(found())

    return run


def heavy_keys(plan: Plan, docs: DataFrame) -> np.ndarray:
    """Keys that at least HEAVY_DOCS documents of a sample share; at most HEAVY_KEYS of them, whatever the corpus."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for u in segments(plan, longs(batch.column(0)), data, offsets):
                key, mark, doc = slices(plan, u)[:3]
                both = np.unique(np.stack([key, mark], 1), axis=0)[:, 0] if len(key) else key
                yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64))], ["key"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    found = sample.transform(through, keys, "key long").groupBy("key").count().where(F.col("count") >= HEAVY_DOCS).orderBy(F.desc("count"), "key").limit(HEAVY_KEYS).select("key").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(U64))


def numbered(keys: DataFrame) -> tuple[DataFrame, int]:
    """Different rows (none, id, sha) with their place, which grows in that order, and how many low bits of it tell the rows of one id apart.

    The bits above number the ids.  Rows are sorted by range, each range counts on its own, and the counts of the ranges
    alone reach the driver; so an id of any number of rows is no hot spot.
    """
    n = partitions(keys.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, rank, last = -1, 0, None  # of the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            none = batch.column(0).to_numpy(zero_copy_only=False)
            ident = longs(batch.column(1))
            new = np.ones(len(none), bool)
            new[1:] = (none[1:] != none[:-1]) | (ident[1:] != ident[:-1])
            new[0] = last != (bool(none[0]), int(ident[0]))
            runs = run + np.cumsum(new)
            at = np.arange(len(none))
            head = np.maximum.accumulate(np.where(new, at, -1))
            ranks = np.where(head >= 0, at - head, at + rank + 1)
            run, rank, last = int(runs[-1]), int(ranks[-1]), (bool(none[-1]), int(ident[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs), pa.array(ranks)], ["none", "id", "sha", "part", "run", "rank"])

    parted = keys.repartitionByRange(n, "none", "id", "sha").sortWithinPartitions("none", "id", "sha").withColumn("part", F.spark_partition_id())
    counted = staged(parted.transform(through, count, "none boolean, id long, sha binary, part int, run long, rank long"), "places-counted")
    ident = F.struct("none", "id")
    ends = counted.groupBy("part").agg(F.min(ident).alias("lo"), F.max(ident).alias("hi"), F.max(F.struct("run", "rank")).alias("last"), F.max(F.when(F.col("run") == 0, F.col("rank"))).alias("first"), F.max("rank").alias("most"))
    bases, runs, ranks, most, hi = [], 0, 0, 0, None
    for r in sorted(ends.collect(), key=lambda r: r.part):
        goes_on = hi == r.lo  # the first id of this range is the last of the range before
        base, carry = (runs - 1, ranks) if goes_on else (runs, 0)
        bases.append((r.part, base, carry))
        most = max(most, r.most, r.first + carry)
        runs, ranks, hi = base + r["last"].run + 1, r["last"].rank + 1 + (carry if r["last"].run == 0 else 0), r.hi
    shift = most.bit_length()
    if max(runs - 1, 0).bit_length() + shift > 63:  # takes 2**32 different rows at least
        raise ValueError(f"{runs} ids with up to {most + 1} texts each do not fit in places of 63 bits")
    offsets = keys.sparkSession.createDataFrame(bases, "part int, base long, carry long")
    rank = F.col("rank") + F.when(F.col("run") == 0, F.col("carry")).otherwise(0)
    return counted.join(F.broadcast(offsets), "part").select("none", "id", "sha", ((F.col("base") + F.col("run")) * F.lit(1 << shift) + rank).alias("place")), shift


def places(docs: DataFrame) -> tuple[DataFrame, int, DataFrame | None]:
    """Rows (doc_id: a place in the order of documents, text), how many low bits of a place are not the id's, and the rows' ids.

    As a rule a place is the id, and the last is None.  Where ids repeat or are null, equal rows are one row here, rows of
    one id with different texts are ordered by the texts' SHA-256, and null ids are one id that comes last; the ids then
    are rows (place, id, many: how many equal rows there are, text), see ``with_ids``.  Ids may have any value.
    """
    docs = only(docs, doc_id="long", text="string")
    seen = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if seen.n == seen.d:
        return docs, 0, None
    text = F.coalesce("text", F.lit(""))
    hashed = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
    keys, shift = numbered(hashed.select("none", "id", "sha").distinct())
    different = hashed.groupBy("none", "id", "sha").agg(F.count(F.lit(1)).alias("many"), F.first("text").alias("text"))
    ids = staged(different.join(keys, ["none", "id", "sha"]).select("place", F.when(~F.col("none"), F.col("id")).alias("id"), "many", "text"), "places")
    return ids.select(F.col("place").alias("doc_id"), "text"), shift, ids


def with_ids(found: DataFrame, ids: DataFrame | None) -> DataFrame:
    """``found`` with doc_id in place of its first column, a place; a result of equal rows once for each of them."""
    place, *names = found.columns
    if ids is None:
        return found.withColumnRenamed(place, "doc_id")
    own = ids.select(F.col("place").alias(place), F.col("id").alias("doc_id"), "many")
    return found.join(own, place).withColumn("many", F.explode(F.sequence(F.lit(1).cast("long"), F.col("many")))).select("doc_id", *names)


def find_repeats(docs: DataFrame, shift: int, unit: str, window: int, gram: int, earlier_place: bool, repeated: Callable) -> tuple[DataFrame, Plan]:
    """Rows (bucket, kind, payload) of all repeated windows, by document; SETTLED counts take one byte, ASKED ones four.

    ``docs`` and ``shift`` are those of ``places``.
    """
    n = partitions(docs.sparkSession)
    plan = Plan(unit, window, gram, earlier_place, 4 * n, shift)
    heavy = heavy_keys(plan, docs)
    first = docs.transform(through, anchors(plan, heavy), ROWS).repartition(n, "bucket").sortWithinPartitions("bucket").transform(through, compare_keys(plan, heavy), ROWS)
    first = staged(first, "repeats-keys")
    asked = first.where(F.col("kind") == ASKED)
    cut = with_texts(docs, asked, plan.buckets).transform(through, cut_slices(plan), ROWS)
    second = staged(cut.repartition(n, "bucket").sortWithinPartitions("bucket").transform(through, compare_slices(plan, repeated), ROWS), "repeats-windows")
    return first.where(F.col("kind") == SETTLED).unionAll(second), plan


def with_texts(docs: DataFrame, other: DataFrame, buckets: int) -> DataFrame:
    """Packed rows and packed texts of each bucket together, the rows first."""
    n = partitions(docs.sparkSession)
    return docs.transform(through, pack_texts(buckets), ROWS).unionAll(other).repartition(n, "bucket").sortWithinPartitions("bucket", "kind")


def over_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Place, text, and the starts and counts of its repeated windows."""
    for _, stream in buckets_of(batches):
        spans, where, cols = [], None, []
        for kind, payload in stream:
            if kind == SETTLED:
                doc, start, count = unpack(payload, "i8", "i4", "u1")
                spans.append((doc, start, count.astype(np.int32)))
            elif kind == ASKED:
                spans.append(unpack(payload, "i8", "i4", "i4"))
            else:
                if where is None:
                    where, cols = grouped(spans, 0)
                for doc, text in open_texts(payload):
                    lo, hi = where.get(doc, (0, 0))
                    yield doc, text, *((cols[1][lo:hi], cols[2][lo:hi]) if hi > lo else (np.zeros(0, np.int32), np.zeros(0, np.int32)))


def covered(n: int, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Which of n units lie in a repeated window."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + counts - 1 + window, n), -1)
    return np.cumsum(edge[:-1]) > 0
