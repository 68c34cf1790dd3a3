"""Counts by term, number, query, range and grid cell.  Hits are rows; a flag column may narrow them per facet."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RequestError

TERM_CAP, RANGE_CAP, CELL_CAP, MAX_LEVEL, ERROR_SHARE = 1000, 65_536, 100_000, 11, 0.1
GAP_MS = {"SECOND": 1000, "MINUTE": 60_000, "HOUR": 3_600_000, "DAY": 86_400_000, "WEEK": 604_800_000}


def terms(hits: DataFrame, value: Column, *, multi: bool = False, dictionary: DataFrame | None = None, limit: int = 100, mincount: int = 0, sort: str | None = None, distinct: Column | None = None) -> DataFrame:
    """value, count.  ``dictionary`` (value) adds its terms with 0; a document counts once for a term it has twice.

    Order: by count, then value, where the limit is positive, else by value, if ``sort`` doesn't say.  ``distinct``
    counts different values of that column (null is one) in place of rows.
    """
    limit = TERM_CAP if limit < 0 else limit
    sort = sort or ("count" if limit > 0 and limit != TERM_CAP else "index")
    if distinct is None:
        values = hits.select((F.explode(F.array_distinct(value)) if multi else value).alias("value")).where("value is not null")
        counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    else:
        values = hits.select((F.explode(F.array_distinct(value)) if multi else value).alias("value"), distinct.alias("_g")).where("value is not null")
        counts = values.groupBy("value").agg(distinct_groups(F.col("_g")).alias("count"))
    if dictionary is not None and mincount <= 0:
        counts = dictionary.select("value").distinct().join(counts, "value", "left").select("value", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    counts = counts.where(F.col("count") >= mincount)
    order = [F.desc("count"), F.asc("value")] if sort == "count" else [F.asc("value")]
    return counts.orderBy(*order).limit(min(limit, TERM_CAP))


def several_terms(hits: DataFrame, values: dict[str, Column], flags: dict[str, Column] | None = None) -> DataFrame:
    """facet, value, count for many single-valued facets in one scan and one shuffle; ``flags`` narrows each."""
    flags = flags or {}
    pairs = F.array(*[F.struct(F.lit(k).alias("facet"), F.when(flags.get(k, F.lit(True)), v.cast("string")).alias("value")) for k, v in values.items()])
    return hits.select(F.inline(pairs)).where("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))


def missing(value: Column) -> Column:
    return F.count_if(value.isNull())


def queries(hits: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """facet, count of each predicate, in one pass."""
    row = hits.agg(*[F.count_if(F.coalesce(p, F.lit(False))).alias(f"c{i}") for i, p in enumerate(predicates.values())])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("facet"), F.col(f"c{i}").alias("count")) for i, k in enumerate(predicates)])))


def range_edges(start: float, end: float, gap: float) -> tuple[int, float]:
    """Number of buckets and the end that they reach: the last bucket is whole."""
    if gap <= 0 or end < start:
        raise RequestError("a range facet needs a positive gap and an end after its start")
    n = math.ceil((end - start) / gap) if end > start else 0
    if n > RANGE_CAP:
        raise RequestError(f"a range facet has {RANGE_CAP} buckets at most")
    return n, start + n * gap


def date_gap_ms(text: str) -> int:
    import re

    found = re.fullmatch(r"\+?(\d+)([A-Z]+?)S?", text)
    if not found or found[2] not in GAP_MS:
        raise RequestError(f"bad gap {text}")
    return int(found[1]) * GAP_MS[found[2]]


def ranges(hits: DataFrame, value: Column, start: float, end: float, gap: float) -> DataFrame:
    """lower, count of each bucket [lower, lower + gap), the empty ones too."""
    n, _ = range_edges(start, end, gap)
    whole = all(float(x).is_integer() for x in (start, gap))
    kind = "long" if whole else "double"
    bucket = F.floor((value - F.lit(start).cast(kind)) / F.lit(gap).cast(kind))
    counts = hits.where((value >= start) & (value < start + n * gap)).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = hits.sparkSession.range(n).select(F.col("id").alias("bucket"))
    return every.join(counts, "bucket", "left").select((F.lit(start).cast(kind) + F.col("bucket") * F.lit(gap).cast(kind)).alias("lower"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def grid(level: int) -> tuple[int, int]:
    """Columns and rows of the geohash grid of a level."""
    return 1 << math.ceil(5 * level / 2), 1 << (5 * level // 2)


def default_level(width: float, height: float, share: float = ERROR_SHARE) -> int:
    """The coarsest level whose cells are within the given share of the box's diagonal."""
    error = share * math.hypot(width, height) / 2
    for level in range(1, MAX_LEVEL):
        cols, rows = grid(level)
        if math.hypot(360 / cols, 180 / rows) / 2 <= error:
            return level
    return MAX_LEVEL


def heatmap(hits: DataFrame, lat: Column, lon: Column, level: int, box: tuple[float, float, float, float] = (-90, -180, 90, 180)) -> DataFrame:
    """row, col, count of the grid cells that points fall in; rows from the north, columns closed on their east side."""
    cols, rows = grid(level)
    south, west, north, east = box
    first = max(0, math.ceil((west + 180) / 360 * cols) - 1), min(cols - 1, math.ceil((east + 180) / 360 * cols) - 1)
    if (first[1] - first[0] + 1) * max(1, math.ceil((north - south) / 180 * rows)) > CELL_CAP:
        raise RequestError(f"a heatmap has {CELL_CAP} cells at most")
    col = F.greatest(F.ceil((lon + 180) / 360 * cols) - 1, F.lit(0))
    row = F.greatest(F.ceil((F.lit(90.0) - lat) / 180 * rows) - 1, F.lit(0))
    inside = lat.between(south, north) & lon.between(west, east)
    return hits.where(inside).groupBy(row.cast("int").alias("row"), col.cast("int").alias("col")).agg(F.count(F.lit(1)).alias("count"))


def heatmap_grid(cells: Iterable, n_rows: int, n_cols: int, row0: int = 0, col0: int = 0) -> list | None:
    """Rows of counts; a row, and the grid, of zeros alone is None."""
    out: list = [None] * n_rows
    for r, c, n in cells:
        if out[r - row0] is None:
            out[r - row0] = [0] * n_cols
        out[r - row0][c - col0] += n
    return out if any(r is not None for r in out) else None


def distinct_groups(group: Column) -> Column:
    """Different values of the group, and one for rows without."""
    return F.count_distinct(group) + F.max(F.when(group.isNull(), 1).otherwise(0))


def nested(hits: DataFrame, levels: list[tuple], best: dict[str, Column] | None = None, mincount: int = 1) -> DataFrame:
    """One row for each bucket of nested term facets: the values down to it, its depth, count and maxima.

    ``levels``: name, value, limit, order (``count desc`` or ``index asc``) of each, from the outermost, and if they
    differ from the rest its least count and whether the value is an array, each member of which counts.  A bucket is
    there only if its parent is: ranks within a parent are taken level by level, over counts, not over rows.
    """
    best = best or {}
    names = [level[0] for level in levels]
    flat = hits.select(*[level[1].alias(level[0]) for level in levels], *[m.alias(k) for k, m in best.items()])
    for name, *more in levels:
        if more[4:] and more[4]:
            flat = flat.withColumn(name, F.explode_outer(F.array_distinct(name)))
    kinds = dict(flat.dtypes)
    out, chosen = None, None
    for depth, (name, _, limit, order, *more) in enumerate(levels):
        keys, least = names[: depth + 1], more[0] if more else mincount
        shown = flat if depth + 1 == len(levels) else flat.drop(*names[depth + 1 :])
        if any(level[5:] and level[5] for level in levels[depth + 1 :]):  # rows that deeper arrays repeat
            shown = hits.select(*[level[1].alias(level[0]) for level in levels[: depth + 1]], *[m.alias(k) for k, m in best.items()])
            for n, *rest in levels[: depth + 1]:
                if rest[4:] and rest[4]:
                    shown = shown.withColumn(n, F.explode_outer(F.array_distinct(n)))
        counts = shown.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), *[F.max(k).alias(k) for k in best]).where(F.col("count") >= least)
        if chosen is not None:
            counts = counts.join(chosen, keys[:-1], "left_semi")
        rank = Window.partitionBy(*keys[:-1]).orderBy(*([F.desc("count"), F.asc(name)] if order.startswith("count") else [F.asc(name)]))
        kept = counts.withColumn("rank", F.row_number().over(rank))
        if limit >= 0:
            kept = kept.where(F.col("rank") <= limit)
        chosen = kept.select(*keys)
        level = kept.select(F.lit(depth).alias("depth"), *[F.col(n) if n in keys else F.lit(None).cast(kinds[n]).alias(n) for n in names], F.col("count"), F.col("rank"), *best)
        out = level if out is None else out.unionByName(level)
    return out
