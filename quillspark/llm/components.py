"""Connected components of a link table by alternating large-star and small-star steps (after Kiveris et al.)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component) for every id in ``links`` (a long, b long): the smallest id that its links reach.

    Each step takes minima by groupBy, which combines before the shuffle, and joins them back; the rest stays in tables
    in the shared folder.  Only two sums a round reach the driver.  Loops (a = b) and repeated links do no harm.
    """
    now = staged(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        now = staged(small.where("a <> b").distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    found = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return found.unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
