"""Operators 2 and 3 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import vectors
from quillspark.llm.components import components


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumn("block", F.lit(1)).withColumn("many", F.lit(2))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (12, 16))
    data = np.concatenate([c + rng.normal(0, s, (25, 16)) for c, s in zip(centres, np.linspace(0.05, 0.5, 12))])
    data = np.concatenate([data, data[:20], data[:5] * 2])
    out = [(i * 5, [float(x) for x in v]) for i, v in enumerate(data.astype(np.float32))]
    return out + [(7, None), (8, []), (9, [0.0] * 16), (11, [float("nan")] * 16), (20001, [1.0] * 3), (20002, [1.0, 1.0, 1.1]), (13, [float("inf")] + [0.0] * 15)]


def test_top_k(spark, rows):
    got = {}
    for r in vectors.top_k(table(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, np.floor(64 * np.array(v, float))) for i, v in rows if v and np.isfinite(v).all()]
    for q, x in good:
        if q % 20:
            continue
        scores = sorted((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x))[:20]
        assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert set(got) <= {i for i, _ in good}


def test_top_k_ties_and_small_tables(spark):
    same = [(i, [1.0, 2.0]) for i in range(0, 60, 2)]
    got = [r.vec_id for r in vectors.top_k(table(spark, same)).where("query_id = 20").orderBy("rank").collect()]
    assert got == [i for i in range(0, 60, 2) if i != 20][:20]
    assert vectors.top_k(table(spark, [])).collect() == []
    assert vectors.top_k(table(spark, [(20, [1.0])])).collect() == []
    assert [r.vec_id for r in vectors.top_k(table(spark, [(20, [1.0]), (20, [1.0]), (21, [2.0])])).collect()] == [21]


def test_near_duplicates(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "JOIN_BLOCK", 40)
    monkeypatch.setattr(vectors, "LEAF", 8)
    got = {r.vec_id: tuple(r)[1:] for r in vectors.near_duplicates(table(spark, rows)).collect()}
    good = [(i, np.array(v, float)) for i, v in rows if v and np.isfinite(v).all() and any(v)]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(parent, 0)
    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    assert got == {i: (links[i], find(i), find(i) == i) for i in parent}
    assert max(links.values()) > 10


def test_near_duplicates_edges(spark):
    assert vectors.near_duplicates(table(spark, [])).collect() == []
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(table(spark, [(None, [1.0]), (3, [2.0]), (5, [1.0])])).collect()}
    assert got == {None: (0, None, True), 3: (1, 3, True), 5: (1, 3, False)}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (50, 50), (None, 1), (60, 40), (60, 40)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 50: 40, 60: 40}


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


def test_near_duplicates_move_each_vector_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "JOIN_BLOCK", 16)
    monkeypatch.setattr(vectors, "LEAF", 8)
    rng = np.random.default_rng(3)
    data = rng.normal(size=(800, 64)).astype(np.float32)
    data[400:] = data[:400] + rng.normal(0, 0.01, (400, 64))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>").localCheckpoint()
    since = shuffled(spark, 0)[1]
    got = {r.vec_id: tuple(r)[1:] for r in vectors.near_duplicates(df).collect()}
    assert got == {i: (1, i % 400, i < 400) for i in range(800)}
    assert shuffled(spark, since)[0] < 4 * data.nbytes


def test_near_duplicates_of_copies_and_precisions(spark, monkeypatch):
    monkeypatch.setattr(vectors, "JOIN_BLOCK", 7)
    monkeypatch.setattr(vectors, "LEAF", 4)
    rng = np.random.default_rng(4)
    base = [[float(x) for x in v] for v in rng.normal(size=(30, 5))] + [[1.5, -2.0, 0.25, 0.0, 1e300], [1.5, -2.0, 0.25, -0.0, 4.0]]
    rows = [(k * 100 + i, v) for i, v in enumerate(base) for k in range(1 + i % 4)] + [(None, base[0]), (9001, [1.0, None, 1.0, 1.0, 1.0]), (9002, [-0.0] * 5)]
    got = {r.vec_id: tuple(r)[1:] for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()}
    unit = {i: np.array(v) / np.abs(v).max() for i, v in rows if i is not None and i < 9000}
    unit = {i: v / np.sqrt(v @ v) for i, v in unit.items()}
    near = {i: {j for j in unit if j != i and unit[i] @ unit[j] >= 0.95} for i in unit}
    assert {i: got[i][0] for i in unit} == {i: len(near[i]) for i in unit}
    for i in unit:
        reached, more = {i}, {i}
        while more:
            more = set().union(*(near[j] for j in more)) - reached
            reached |= more
        assert got[i][1:] == (min(reached), min(reached) == i)
    assert got[9001] == (0, 9001, True) and got[9002] == (0, 9002, True) and got[None] == (0, None, True)
