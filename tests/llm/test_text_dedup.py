"""Operators 5 and 6 and the pipeline against brute force."""

import re

import pytest

from quillspark.llm import line_dedup, near_dedup, registry

from .conftest import frame, prose


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_lines(rows):
    """(doc_id, text) -> text left; rows of one id and text are one."""
    places = sorted({(d if d is not None else 1 << 62, i, line, d, t) for d, t in rows if t is not None for i, line in enumerate(t.split("\n"))}, key=lambda p: p[:3])
    gone = set()
    for n, (d, i, line, own, text) in enumerate(places):
        words = set(line.split(" ")) - {""}
        for d2, i2, other, *_ in places[:n]:
            w2 = set(other.split(" ")) - {""}
            if (d2, i2) < (d, i) and words and w2 and 5 * len(words & w2) >= 4 * len(words | w2):
                gone.add((own, text, i))
                break
    return {(d, t): None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, t, i) not in gone) for d, t in rows}


@pytest.fixture(scope="module")
def lines():
    import random

    rng = random.Random(8)
    pool = [prose(rng, rng.randrange(1, 30)) for _ in range(25)] + ["", "   ", "a", "a b", "b a", "a b c d e", "a b c d"]
    near = []
    for line in pool[:20]:
        words = line.split(" ")
        words[rng.randrange(len(words))] = "other"
        near.append(" ".join(words))
    texts = ["\n".join(rng.choice(pool + near) for _ in range(rng.randrange(1, 8))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (None, texts[0]), (3, texts[3]), (4, "a b c d e f\nzz")]
    return rows


def test_lines(spark, lines):
    got = line_dedup.dedup(frame(spark, lines)).collect()
    want = brute_lines(lines)
    assert sorted(repr((r.doc_id, r.text)) for r in got) == sorted(repr((d, want[d, t])) for d, t in lines)
    assert {"n_lines", "n_removed", "bucket"} <= set(got[0].asDict())
    assert all(r.n_removed >= 0 and (r.text is not None or r.n_lines == 0) for r in got)


def test_no_lines(spark):
    assert line_dedup.dedup(frame(spark, [])).collect() == []
    assert [r.text for r in line_dedup.dedup(frame(spark, [(1, None)])).collect()] == [None]


def test_order_of_tokens_by_a_sample(spark):
    texts = [f"common words of all lines\nonly {i} here" for i in range(640)] + ["\n", "\n\n", "", "x\n", None]
    docs = frame(spark, list(enumerate(texts)))
    bare = docs.selectExpr("doc_id as doc", "xxhash64(text) as hash", "text").where("text is not null")
    top = max(spark.range(1).select(line_dedup.rarity(bare)).first()[0]) >> 24
    assert 0 < top < 30  # 37 if all 640 were counted
    sets = bare.selectExpr("doc as id", "1 as n", "array(1) as prefix", "0L as sketch", "0L as sketch2")
    plan = line_dedup.candidates(sets, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 2
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup(docs).collect()}
    assert got == {i: (None, 0, 0) if t is None else (t if i == 0 or i >= 640 else t.split("\n")[1], t.count("\n") + 1, int(0 < i < 640)) for i, t in enumerate(texts)}


def test_copies_and_parts_of_the_join(spark):
    import random

    rng = random.Random(5)
    base = [[f"w{rng.randrange(300)}" for _ in range(n)] for n in range(1, 60)]
    near = [[w for w in b if rng.random() > 0.08] + ["x"] * rng.randrange(2) for b in base for _ in range(3)]
    texts = [" ".join(b) for b in base + near if b]
    rows = [*enumerate(texts), (900, "\n".join(texts)), (7, "again\n" + texts[7]), (7, texts[7]), (901, "  \na  b\nb a ")]
    docs = frame(spark, rows).selectExpr("cast(doc_id as long) as doc", "xxhash64(text) as hash", "text")
    lines = line_dedup.line_sets(docs).withColumn("id", line_dedup.F.monotonically_increasing_id())
    lines = line_dedup.staged(lines, "test-lines")
    found = lines.join(docs.distinct(), ["doc", "hash"]).selectExpr("*", "split(text, '\n')[line] as words").collect()
    assert all((r.nth == 1) == (r.prefix is not None) for r in found)  # no token of a copy is looked at
    sets = {r.id: set(r.words.split(" ")) - {""} for r in found if r.nth == 1}
    assert {r.id: len(sets[r.id]) for r in found if r.nth == 1} == {r.id: r.n for r in found if r.nth == 1}
    assert len(sets) == len({x for _, t in rows for x in t.split("\n") if x.strip()})
    parts = [{tuple(sorted((r.a, r.b))) for r in line_dedup.candidates(lines.where("nth = 1"), part).collect()} for part in range(line_dedup.ROUNDS)]
    assert not parts[0] & parts[1]  # each pair is met in one part
    like = {(i, j) for i in sets for j in sets if i < j and jaccard(sets[i], sets[j]) >= 0.8}
    assert like <= parts[0] | parts[1] and len(like) > 50
    got = line_dedup.dedup(frame(spark, rows)).collect()
    want = brute_lines(rows)
    assert sorted((r.doc_id, r.text) for r in got) == sorted((d, want[d, t]) for d, t in rows)


def words_of(text):
    return [w for w in re.split(r"[^0-9a-z\u0080-\U0010ffff]+", (text or "").lower()) if w]


def test_near(spark, corpus):
    got = {r.doc_id: r for r in near_dedup.clusters(frame(spark, corpus)).collect()}
    texts = dict(corpus)
    shingles = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in texts.items() if (w := words_of(t))}
    for a in shingles:
        for b in shingles:
            if a < b:
                j = jaccard(shingles[a], shingles[b])
                if j > 0.85:
                    assert got[a].class_id == got[b].class_id, (a, b, j)
                if j < 0.5 and max(jaccard(shingles[a], shingles[c]) for c in shingles if c != a) < 0.5:
                    assert got[a].class_id == a and got[a].kept
    for d, t in texts.items():
        if not words_of(t):
            assert got[d].class_id == d and got[d].kept
    assert any(not r.kept for r in got.values())


def test_near_rows(spark, corpus):
    rows = corpus + [(None, "one two three four five six"), (2, "one two three four five six")]
    kept = near_dedup.dedup(frame(spark, rows)).collect()
    texts = [r.text for r in kept]
    assert texts.count("one two three four five six") == 1 and "bucket" in kept[0].asDict()
    assert near_dedup.dedup(frame(spark, [])).collect() == []


def test_weighted_jaccard():
    import numpy as np

    a, b = np.array([1, 3, 5], np.uint64), np.array([3, 5, 9], np.uint64)
    assert near_dedup.weighted_jaccard(a, np.array([1, 2, 3], np.float32), b, np.array([1, 4, 1], np.float32)) == pytest.approx(4 / (6 + 6 - 4))


def test_blocks_of_rests(spark, monkeypatch):
    """Variants of one text that are far from the leader still find each other."""
    import random

    rng = random.Random(6)
    base = prose(rng, 100).split()
    rows = []
    for i in range(30):
        words = list(base)
        for _ in range(i // 3):
            words[rng.randrange(100)] = f"w{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-1] + ["end"]))]
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    got = {r.doc_id: r.class_id for r in near_dedup.clusters(frame(spark, rows)).collect()}
    assert all(got[2 * i] == got[2 * i + 1] for i in range(30))


def test_registry_names():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES} == set(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from quillspark.llm.common import staged

    docs = staged(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "docs")
    names = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = staged(stage(spark, docs, ""), name)
        assert docs.columns == names
        after = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        assert set(after) <= set(before) and len(after) > 0.6 * len(before)
        if name == "line_dedup":
            want = brute_lines(list(before.items()))
            assert all(after.get(d, "").strip() == want[d, t].strip() for d, t in before.items())
        assert docs.where("n_chars <> char_length(text)").count() == 0
    rows = pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in rows} == set(after)
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() == len(rows)
