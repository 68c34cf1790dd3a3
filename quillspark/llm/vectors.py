"""Operators 2 and 3: exact top-k search by the threshold algorithm, and near-duplicate vectors by epsilon grid order."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, partitions, staged, table, through
from .components import components

TOP, QUERY_STEP, LEVELS = 20, 20, 64
#: Rows and queries of one block of the search.
ROW_BLOCK, QUERY_BLOCK = 8192, 1024
LEAST_COSINE, LEADING, JOIN_BLOCK, LEAF = 0.95, 8, 2048, 512
#: Bytes of a block's vectors as doubles, which end it before JOIN_BLOCK rows if they are long.
JOIN_BYTES = 4 << 20
#: Axes on which distances are bounded before the vectors themselves are multiplied.
BOUNDING = 24
#: Bytes of blocks, as stored, that a task holds of one side of the join.
SIDE_BYTES = 16 << 20
#: Lengths of vectors, the most frequent ones, whose principal axes are taken; other lengths use their first members.
FITTED = 16


def finite(column: str):
    """Arrays without null, NaN or infinite members, and not empty."""
    return F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))


def packed_blocks(rows: DataFrame, vector: str, kind: str, size: int) -> DataFrame:
    """(width, ids, data, block): rows (vec_id, vector) of one width in blocks of at most ``size``, within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(width: int):
            ids, data = zip(*held.pop(width))
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([np.concatenate(ids).tobytes()]), pa.array([np.concatenate(data).tobytes()])], ["width", "ids", "data"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            widths = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
            at = np.cumsum(widths) - widths
            for width in np.unique(widths).tolist():
                rows_of = np.flatnonzero(widths == width)
                for some in np.split(rows_of, range(size, len(rows_of), size)):
                    held.setdefault(width, []).append((ids[some], flat[(at[some][:, None] + np.arange(width)).ravel()]))
                    if sum(len(h[0]) for h in held[width]) + size // 2 > size:
                        yield flush(width)
        for width in list(held):
            yield flush(width)

    return rows.select("vec_id", vector).transform(through, run, "width int, ids binary, data binary").withColumn("block", F.monotonically_increasing_id())


def threshold_top(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ``top`` rows of highest inner product, ties to smaller ids, by Fagin's threshold algorithm.

    Each dimension has its rows in order of their value; a query goes down those lists at once, from the top where its
    own value is positive, else from the bottom, and scores the rows it meets in full.  No row not met yet can score
    more than the sum of the values just passed, so it stops when the top-th score is above that.
    """
    n, width = rows.shape
    lists = np.argsort(rows, axis=0, kind="stable").T  # width x n, ascending
    values = np.take_along_axis(rows.T, lists, 1)
    wide, lanes = rows.astype(np.float64), np.arange(width)
    for q, own in zip(queries, query_ids.tolist()):
        use = lanes[q != 0]
        down = q[use] > 0
        met = np.zeros(n, bool)
        met[ids == own] = True
        best_score, best_row, depth = np.zeros(0), np.zeros(0, np.int64), 0
        step = max(16, top)
        while True:
            to = min(n, depth + step)
            if len(use):
                found = np.concatenate([lists[use[down], n - to : n - depth].ravel(), lists[use[~down], depth:to].ravel()])
                fresh = np.zeros(n, bool)
                fresh[found] = True
                fresh &= ~met
                new = np.flatnonzero(fresh)
            else:
                new, to = np.flatnonzero(~met), n
            met[new] = True
            score = np.append(best_score, wide[new] @ q)
            row = np.append(best_row, new)
            if len(score) > top:
                least = np.partition(score, len(score) - top)[len(score) - top]
                may = np.flatnonzero(score >= least)
                may = may[np.lexsort((ids[row[may]], -score[may]))[:top]]
                score, row = score[may], row[may]
            best_score, best_row, depth = score, row, to
            if to >= n or met.all():
                break
            if len(score) >= top:
                bound = (q[use] * np.where(down, values[use, n - to], values[use, to - 1])).sum()
                if score.min() > bound:
                    break
            step = depth
        order = np.lexsort((ids[best_row], -best_score))
        yield own, ids[best_row][order], best_score[order].astype(np.int64)


def top_k(embeddings: DataFrame, top: int = TOP, query_step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score of the ``top`` rows of highest inner product of floor(LEVELS * x).

    Queries are the rows whose vec_id is divisible by ``query_step``, against all other rows, in blocks of both.  A null
    vec_id, and vectors that are null, empty or hold null or non-finite members, take no part; an id given more than once
    counts once, with its smallest vector; only vectors of one length meet.  Other columns are ignored.
    """
    spark = embeddings.sparkSession
    n = partitions(spark)
    rows = only(embeddings, vec_id="long", embedding="array<double>").where(F.col("vec_id").isNotNull() & finite("embedding"))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * LEVELS).cast("double")).alias("v"))
    rows = staged(rows, "vectors")
    count = rows.count()
    several = max(1, -(-count // ROW_BLOCK))
    blocks = packed_blocks(rows.repartition(several, "vec_id"), "v", "f8", ROW_BLOCK)
    asked = rows.where(F.pmod("vec_id", F.lit(query_step)) == 0)
    queries = packed_blocks(asked.repartition(max(1, -(-count // (QUERY_BLOCK * query_step))), "vec_id"), "v", "f8", QUERY_BLOCK)
    blocks = staged(blocks, "row-blocks")
    queries = staged(queries, "query-blocks")
    numbers = queries.groupBy("width").agg(F.collect_list("block").alias("queries"))  # numbers of blocks alone
    pairs = blocks.select("width", "block").join(numbers, "width").select("block", F.explode("queries").alias("query"))
    work = pairs.join(blocks, "block").join(queries.select(F.col("block").alias("query"), F.col("ids").alias("query_ids"), F.col("data").alias("query_data")), "query")
    work = work.repartition(n, F.xxhash64("block", "query")).select("width", "ids", "data", "query_ids", "query_data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width = batch.column(0)[i].as_py()
                ids, data, query_ids, query_data = (np.frombuffer(batch.column(1 + k)[i].as_buffer(), t) for k, t in enumerate(("i8", "f8", "i8", "f8")))
                found = list(threshold_top(data.reshape(-1, width), ids, query_data.reshape(-1, width), query_ids, top))
                sizes = [len(f[1]) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], sizes), pa.int64()), pa.array(np.concatenate([f[1] for f in found]), pa.int64()), pa.array(np.concatenate([f[2] for f in found]), pa.int64())], ["query_id", "vec_id", "score"])

    near = work.transform(through, run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


# ---------------------------------------------------------------- near duplicates


def usable(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places, vectors) by length of those rows of a batch that have an id and finite members, not all zero."""
    widths = pa.compute.fill_null(pa.compute.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null members become NaN
    starts = np.cumsum(widths, dtype=np.int64) - widths
    named = ids.is_valid().to_numpy(zero_copy_only=False)
    for width in np.unique(widths[widths > 0]).tolist():
        at = np.flatnonzero((widths == width) & named)
        x = flat[starts[at][:, None] + np.arange(width)]
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        yield width, at[good], x[good] + 0.0  # -0.0 becomes 0.0


def leading_axes(rows: DataFrame, width: int) -> np.ndarray:
    """width x BOUNDING: the principal axes of the unit vectors; sums of width**2 numbers a partition, no rows, reach the driver."""
    from .quality import summed

    def add(batch):
        total = np.zeros(1 + width + width * width)
        for _, _, x in usable(batch.column(0), batch.column(1)):
            x = unit(x)
            total += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        return total

    s = summed(rows.where(F.size("embedding") == width), ["vec_id", "embedding"], 1 + width + width * width, add)
    n = max(s[0], 1)
    mean = s[1 : 1 + width] / n
    spread = s[1 + width :].reshape(width, width) / n - np.outer(mean, mean)
    return np.linalg.eigh(spread)[1][:, ::-1][:, :BOUNDING]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # very large or small members neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class GridSide:
    """Unit vectors in epsilon grid order, with what bounds their distances: single precision, as only candidates depend on it."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray) -> None:
        self.x, self.boxes = unit(vectors), {}
        p = self.x @ axes
        self.leading = p[:, :LEADING]
        half = (p * p).sum(1, keepdims=True) / 2
        one = np.ones_like(half)
        self.first, self.second = (np.concatenate(c, 1).astype(np.float32) for c in ([p, -half, one], [p, one, -half]))

    def box(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        if (lo, hi) not in self.boxes:
            p = self.leading[lo:hi]
            self.boxes[lo, hi] = p.min(0), p.max(0)
        return self.boxes[lo, hi]


class GridJoin:
    """Links between two sequences of vectors in epsilon grid order, by recursion over intervals of both."""

    def __init__(self, a: GridSide, b: GridSide, least: float, same: bool) -> None:
        self.a, self.b, self.least, self.same = a, b, least, same
        self.reach = 2 - 2 * least + 1e-9

    def leaf(self, a0: int, a1: int, b0: int, b1: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the links between two intervals.

        first @ second is half the negative squared distance on the bounding axes, which no pair's cosine less 1 exceeds.
        """
        may = self.a.first[a0:a1] @ self.b.second[b0:b1].T >= np.float32(self.least - 1 - 1e-5)
        if self.same and b0 < a1:  # each pair once
            may &= np.arange(b0, b1)[None, :] > np.arange(a0, a1)[:, None]
        at = np.flatnonzero(may)
        if len(at) * 16 > may.size:
            return np.nonzero(may & (self.a.x[a0:a1] @ self.b.x[b0:b1].T >= self.least))
        i, j = np.divmod(at, b1 - b0)
        found = np.einsum("ij,ij->i", self.a.x[a0 + i], self.b.x[b0 + j]) >= self.least
        return i[found], j[found]

    def leaves(self) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
        """(interval of a, interval of b, rows, columns of links) of intervals that have any."""
        stack = [(0, len(self.a.x), 0, len(self.b.x))]
        while stack:
            a0, a1, b0, b1 = stack.pop()
            if a0 == a1 or b0 == b1 or (self.same and b1 <= a0):
                continue
            (alo, ahi), (blo, bhi) = self.a.box(a0, a1), self.b.box(b0, b1)
            gap = np.maximum(np.maximum(alo - bhi, blo - ahi), 0)
            if gap @ gap > self.reach:
                continue
            if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
                i, j = self.leaf(a0, a1, b0, b1)
                if len(i):
                    yield a0, a1, b0, b1, i, j
                continue
            am = (a0 + a1) // 2 if a1 - a0 > LEAF else a1
            bm = (b0 + b1) // 2 if b1 - b0 > LEAF else b1
            stack += [(x0, x1, y0, y1) for x0, x1 in ((a0, am), (am, a1)) for y0, y1 in ((b0, bm), (bm, b1))]


def roots(found: np.ndarray) -> np.ndarray:
    """For a matrix of links between rows and columns: for each row, then each column, a node of its component."""
    n, m = found.shape
    row, col = np.arange(n), np.full(m, n)
    while True:
        new_col = np.minimum(col, np.where(found, row[:, None], n).min(0))
        new_row = np.minimum(row, np.where(found, new_col[None, :], n).min(1))
        if (new_col == col).all() and (new_row == row).all():
            return np.concatenate([row, np.where(col < n, col, n + np.arange(m))])
        row, col = new_row, new_col


def join_blocks(a: GridSide, b: GridSide, a_ids, b_ids, a_many, b_many, least, same) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, links (copies counted) and for each the id of a vector that its links reach."""
    n = len(a.x)
    links = np.zeros(n + (0 if same else len(b.x)), np.int64)
    parent = list(range(len(links)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    shift = 0 if same else n
    for a0, a1, b0, b1, i, j in GridJoin(a, b, least, same).leaves():
        np.add.at(links, a0 + i, b_many[b0 + j])
        np.add.at(links, shift + b0 + j, a_many[a0 + i])
        x, y = a0 + i, shift + b0 + j
        if len(i) > a1 - a0 + b1 - b0:  # more links than a forest has
            found = np.zeros((a1 - a0, b1 - b0), bool)
            found[i, j] = True
            root = roots(found)
            node = np.concatenate([np.arange(a0, a1), np.arange(shift + b0, shift + b1)])
            some = np.flatnonzero(root != np.arange(len(root)))
            x, y = node[some], node[root[some]]
        for p, q in zip(x.tolist(), y.tolist()):
            p, q = find(p), find(q)
            if p != q:
                parent[max(p, q)] = min(p, q)
    ids = a_ids if same else np.concatenate([a_ids, b_ids])
    hit = np.flatnonzero(links)
    top = np.array([find(i) for i in hit.tolist()], np.int64)
    return ids[hit], links[hit], ids[top] if len(top) else ids[:0]


def near_duplicates(embeddings: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: links are pairs of cosine >= ``least`` in double precision.

    Vectors that are null, empty, zero or hold null or non-finite members have no links, nor has a null vec_id; vectors
    of different lengths are not linked.  Equal vectors are joined once, with their number.  An id given more than once
    counts as that many vectors, but has one row for each of its rows.  Other columns are ignored.

    Vectors are shuffled once, into blocks; pairs of blocks meet as tasks read both sides from the shared folder, so that
    disk grows with the table and not with its square.
    """
    spark = embeddings.sparkSession
    n = partitions(spark)
    rows = only(embeddings, vec_id="long", embedding="array<double>")
    widths = [r[0] for r in rows.groupBy(F.size("embedding").alias("w")).count().where("w > 0").orderBy(F.desc("count"), "w").limit(FITTED).collect()]
    reach = float(np.sqrt(2 - 2 * least))
    fitted = {w: leading_axes(rows, w) for w in widths}

    def axes(w: int) -> np.ndarray:
        return fitted[w] if w in fitted else np.eye(w, min(w, BOUNDING))

    def keyed(batches):
        """key (width, cells, digest), vec_id, ids of equal vectors of the batch, data: in single precision if that is exact."""
        for batch in batches:
            ids, rest = batch.column(0).to_pylist(), np.ones(batch.num_rows, bool)
            out: list[tuple] = []
            for w, at, x in usable(batch.column(0), batch.column(1)):
                rest[at] = False
                cells = np.zeros((len(at), LEADING), ">u2")
                p = np.floor(unit(x) @ axes(w)[:, :LEADING] / reach) + (1 << 15)
                cells[:, : p.shape[1]] = np.clip(p, 0, (1 << 16) - 1)
                with np.errstate(over="ignore"):
                    narrow = x.astype(np.float32)
                exact = (narrow == x).all(1).tolist()
                held: dict[bytes, list[int]] = {}
                for i in range(len(at)):
                    held.setdefault(narrow[i].tobytes() if exact[i] else x[i].tobytes(), []).append(i)
                for data, same in held.items():
                    known = sorted(ids[k] for k in at[same].tolist())
                    key = w.to_bytes(4, "big") + cells[same[0]].tobytes() + blake2b(data, digest_size=8).digest()
                    out.append((key, known[0], np.array(known, np.int64).tobytes(), data))
            out += [(bytes(4) + (k % 4096).to_bytes(2, "big"), ids[k], None, None) for k in np.flatnonzero(rest).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.binary(), pa.binary()))], ["key", "vec_id", "ids", "data"])

    ordered = rows.transform(through, keyed, "key binary, vec_id long, ids binary, data binary")
    ordered = ordered.repartitionByRange(n, "key").sortWithinPartitions("key", "vec_id")
    block_kinds = {"width": pa.int32(), "lo": pa.list_(pa.float64()), "hi": pa.list_(pa.float64()), "ids": pa.binary(), "many": pa.binary(), "data": pa.binary()}
    member_kinds = {"vec_id": pa.int64(), "class": pa.int64(), "copies": pa.int64()}

    def in_blocks(batches):
        """Rows of two kinds: blocks of distinct vectors, and vec_id, class (null: no links), copies of every row."""
        held: list[tuple[bytes, int, int]] = []
        members: list[list] = [[], [], []]
        width, data, ids = 0, None, []  # of the class at hand

        def table_of(columns, count):
            kinds = block_kinds | member_kinds
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(count, k)) for c, k in kinds.items()], list(kinds))

        def block():
            wide = any(len(h[0]) == 8 * width for h in held)
            x = np.array([np.frombuffer(h[0], "f8" if len(h[0]) == 8 * width else "f4") for h in held], np.float64)
            p = unit(x) @ axes(width)[:, :LEADING]
            lo, hi = np.zeros(LEADING), np.zeros(LEADING)
            lo[: p.shape[1]], hi[: p.shape[1]] = p.min(0), p.max(0)
            packed = [np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int64), x if wide else x.astype(np.float32)]
            held.clear()
            values = [pa.array([width], pa.int32()), pa.array([lo.tolist()]), pa.array([hi.tolist()]), *(pa.array([v.tobytes()], pa.binary()) for v in packed)]
            return table_of(dict(zip(block_kinds, values)), 1)

        def listed():
            found = table_of({c: pa.array(v, k) for (c, k), v in zip(member_kinds.items(), members)}, len(members[0]))
            for v in members:
                v.clear()
            return found

        def close():
            many = sum(map(len, ids))
            held.append((data, int(ids[0][0]), many))
            for some in ids:
                for own, value in zip(members, (some.tolist(), [int(ids[0][0])] * len(some), [many] * len(some))):
                    own += value
                if len(members[0]) >= 1 << 14:
                    yield listed()
            if len(held) >= min(JOIN_BLOCK, JOIN_BYTES // (8 * width) + 1):
                yield block()

        for batch in batches:
            for key, own, some, vector in zip(*(c.to_pylist() for c in batch.columns)):
                w = int.from_bytes(key[:4], "big")
                if ids and (w != width or vector != data):
                    yield from close()
                    ids = []
                if w != width and held:
                    yield block()
                width, data = w, vector
                if vector is not None:
                    ids.append(np.frombuffer(some, np.int64))
                    continue
                for v, value in zip(members, (own, None, 0)):
                    v.append(value)
                if len(members[0]) >= 1 << 14:
                    yield listed()
        if ids:
            yield from close()
        if held:
            yield block()
        if members[0]:
            yield listed()

    schema = "width int, lo array<double>, hi array<double>, ids binary, many binary, data binary, vec_id long, class long, copies long"
    blocks = staged(ordered.transform(through, in_blocks, schema).withColumn("block", F.monotonically_increasing_id()), "vector-blocks")
    side = lambda name: blocks.where("width is not null").select(F.col("block").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in block_kinds])
    apart = sum((F.greatest(F.col("a_lo")[k] - F.col("b_hi")[k], F.col("b_lo")[k] - F.col("a_hi")[k], F.lit(0.0)) ** 2 for k in range(LEADING)), F.lit(0.0))
    # of both orders of two blocks one, which a hash names, so that no task has all of its pairs and another none
    once = F.expr("a = b or (a < b) = (xxhash64(least(a, b), greatest(a, b)) >= 0)")
    work = side("a").hint("shuffle_replicate_nl").join(side("b"), (F.col("a_width") == F.col("b_width")) & once & (apart <= 2 - 2 * least + 1e-9))
    work = work.select("a_width", "a", "b", "a_ids", "b_ids", "a_many", "b_many", "a_data", "b_data").coalesce(8 * n)

    def link(batches):
        last = None

        def read(batch, i, w, column):
            raw, ids = batch.column(column)[i].as_buffer(), batch.column(column - 4)[i].as_buffer()
            return GridSide(np.frombuffer(raw, "f8" if raw.size == ids.size * w else "f4").reshape(-1, w), axes(w))

        for batch in batches:
            for i in range(batch.num_rows):
                w, of_a, of_b = (batch.column(k)[i].as_py() for k in range(3))
                ids_a, ids_b, many_a, many_b = (np.frombuffer(batch.column(3 + k)[i].as_buffer(), "i8") for k in range(4))
                if last is None or last[0] != of_a:
                    last = of_a, read(batch, i, w, 7)
                a = last[1]
                b = a if of_a == of_b else read(batch, i, w, 8)
                ids, links, near = join_blocks(a, b, ids_a, ids_b, many_a, many_b, least, of_a == of_b)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(near, pa.int64())], ["a", "n", "b"])

    with side_bytes(spark):
        found = staged(work.transform(through, link, "a long, n long, b long"), "vector-links")
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    parts = components(found.select("a", "b"))
    members = blocks.where("width is null").select("vec_id", "class", "copies")
    result = members.where("class is not null").join(counts.withColumnRenamed("a", "class"), "class", "left").join(parts.select(F.col("id").alias("class"), "component"), "class", "left")
    # ids of a class of their own may be smaller than the class found through others
    result = result.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    alone = members.where("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


@contextlib.contextmanager
def side_bytes(spark: SparkSession):
    """Scans planned within have SIDE_BYTES a partition at most: a product of two tables holds a partition of one of them in memory."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    least = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(name, str(min(least, SIDE_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def query_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def query_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
SQL_TOP_K = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {_USABLE}
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
