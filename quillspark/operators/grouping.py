"""Result grouping: hits by a field, each group by its best hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facets import distinct_groups


def heads(hits: DataFrame, group: Column, order: list[Column]) -> DataFrame:
    """The first row of each group, rows without a value being one group; columns _group and those of the hits."""
    w = Window.partitionBy("_group").orderBy(*order)
    return hits.withColumn("_group", group).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def grouped(hits: DataFrame, group: Column, main: list[Column], within: list[Column] | None = None, *, limit: int = 1, offset: int = 0, rows: int = 10, start: int = 0) -> DataFrame:
    """The hits shown, with _group, group_rank (of the group by its best hit in main order), group_size and place.

    Groups are paged first, by their heads alone; only the hits of the shown groups are then ranked within, of which each
    task hands on offset + limit a group (Spark's group limit, up to 1000), so that a group of most rows is no hot spot.
    A limit below 0 shows all hits, and one task ranks a group.
    """
    first = heads(hits, group, main)
    page = first.orderBy(*main).limit(start + rows)
    page = page.offset(start) if start else page
    ranked = page.withColumn("group_rank", F.row_number().over(Window.orderBy(*main)) + start).select(F.col("_group").alias("_g"), "group_rank")  # a page, not all groups
    sizes = hits.select(group.alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("group_size"))
    shown = sizes.join(F.broadcast(ranked), F.col("_h").eqNullSafe(F.col("_g"))).drop("_h")
    some = hits.withColumn("_group", group).join(F.broadcast(shown), F.col("_group").eqNullSafe(F.col("_g"))).drop("_g")
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("_group").orderBy(*(within or main))))
    return some.where((F.col("place") > offset) & (F.col("place") <= offset + limit if limit >= 0 else F.lit(True)))


def totals(hits: DataFrame, group: Column) -> DataFrame:
    """matches, ngroups."""
    return hits.select(group.alias("_group")).agg(F.count(F.lit(1)).alias("matches"), distinct_groups(F.col("_group")).alias("ngroups"))


def truncated(hits: DataFrame, group: Column, within: list[Column]) -> DataFrame:
    """The first hit of each group in the order within groups: what facets and statistics see under truncation."""
    return heads(hits, group, within).drop("_group")
