"""Statistics of numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("min", "max", "count", "missing", "sum", "sumOfSquares", "mean", "stddev")


def field_stats(hits: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """field, min, max, count, missing, sum, sumOfSquares, mean, stddev over present values, all fields in one pass.

    Without values min, max and mean are null, the sums and the deviation 0; so is the deviation of one value.
    """
    aggs = []
    for i, c in enumerate(columns.values()):
        x = c.cast("double")
        aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.count(x).alias(f"c{i}"), F.count_if(x.isNull()).alias(f"d{i}"), F.coalesce(F.sum(x), F.lit(0.0)).alias(f"e{i}"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias(f"f{i}"), F.avg(x).alias(f"g{i}"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"h{i}")]
    rows = [F.struct(F.lit(name).alias("field"), *[F.col(f"{k}{i}").alias(n) for k, n in zip("abcdefgh", NAMES)]) for i, name in enumerate(columns)]
    return hits.agg(*aggs).select(F.inline(F.array(*rows)))
