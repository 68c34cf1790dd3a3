"""Groups at size: a group of most rows must not pass through one task."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import grouping
from quillspark.plans.request import select
from quillspark.queries import _DOCS
from quillspark.sources.core import TableCore


def shuffled(spark, since: int) -> tuple[int, int]:
    """Bytes that stages from the given number on have written to shuffles, and the number of the next stage."""
    store, total = spark.sparkContext._jsc.sc().statusStore(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    while True:
        try:
            total += store.lastStageAttempt(since).shuffleWriteBytes()
        except Exception:
            return total, since
        since += 1


def ready(spark) -> int:
    """The number of the next stage."""
    spark.range(1).collect()
    bus, tracker = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext.statusTracker()
    bus.waitUntilEmpty(30_000)
    return max(s for job in tracker.getJobIdsForGroup(None) for s in tracker.getJobInfo(job).stageIds) + 1


@pytest.fixture(scope="module")
def hot(spark):
    """8000 rows with 2.4 MB of text, 98 % of one group; some have no group."""
    draw = random.Random(5)
    rows = [(i, "en" if i % 50 else ("fr", None)[i // 50 % 2], draw.randrange(1000), "%0300x" % draw.getrandbits(1200), "a") for i in range(8000)]
    return rows, spark.createDataFrame(rows, "doc_id long, lang string, n_chars int, text string, source string").repartition(4).localCheckpoint()


def test_hot_group_stays_where_it_is(spark, hot):
    rows, hits = hot
    since = ready(spark)
    found = grouping.grouped(hits, F.col("lang"), [F.desc("n_chars"), F.asc("doc_id")], limit=2, offset=1).collect()
    assert shuffled(spark, since)[0] < 100_000
    groups = [sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])) for g in ("en", "fr", None)]
    groups.sort(key=lambda own: (-own[0][2], own[0][0]))
    want = [(own[0][1], rank, len(own), place, own[place - 1][0]) for rank, own in enumerate(groups, 1) for place in (2, 3)]
    assert sorted((r["group_rank"], r["place"], r["_group"], r["group_size"], r["doc_id"], len(r["text"])) for r in found) == sorted((rank, place, g, n, key, 300) for g, rank, n, place, key in want)


def test_request_moves_no_group(spark, hot):
    rows, hits = hot
    core = TableCore(_DOCS, hits.withColumn("doc_ord", F.col("doc_id")))
    since = ready(spark)
    out = select(core, {"q": "*:*", "group": "true", "group.field": "lang", "group.limit": 3, "group.ngroups": "true", "sort": "n_chars desc", "fl": "doc_id"})["grouped"]["lang"]
    assert shuffled(spark, since)[0] < 100_000
    assert (out["matches"], out["ngroups"]) == (8000, 3)
    for g in out["groups"]:
        own = sorted((r for r in rows if r[1] == g["groupValue"]), key=lambda r: (-r[2], r[0]))
        assert g["doclist"]["numFound"] == len(own)
        assert g["doclist"]["docs"] == [{"doc_id": r[0]} for r in own[:3]]
