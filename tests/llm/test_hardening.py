"""Long regular words, clashing names, many lengths and languages, missing settings: what once crashed or gave wrong rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import bpe, common, language, line_dedup, near_dedup, packing, substring_dedup, suffix_dedup, vectors

from .conftest import frame, prose

CLASHING = ("lang_pred", "lang_rejected", "lang_score", "n_lines", "n_removed", "_", "_id", "_hash", "hash", "row", "class", "doc", "c0", "end", "hit", "gone", "bits", "kept", "cut_id", "lines", "place")


def mirrored(n: int, a: str, b: str) -> str:
    """A sequence of two signs whose sums against its mirror image vanish in polynomial hashes modulo a power of two."""
    return "".join(b if bin(i).count("1") & 1 else a for i in range(n))


@pytest.fixture(scope="module")
def collision(spark):
    rng = random.Random(8)
    left, right = prose(rng, 30), prose(rng, 30)
    rows = [(1, f"{left} {mirrored(2048, 'a', 'b')} {right}"), (2, f"{left} {mirrored(2048, 'b', 'a')} {right}")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_words_of_equal_sums_are_different_words(collision):
    rows, df = collision
    assert [r.n_removed for r in substring_dedup.dedup(df).collect()] == [0, 0]
    assert {r.class_id for r in near_dedup.clusters(df).collect()} == {1, 2}
    words = bpe.vocabulary(packing.rank_path())
    text = f" {mirrored(1024, 'a', 'b')} {mirrored(1024, 'b', 'a')}"
    assert words.decode(np.array(words.encode(text))).tobytes().decode() == text
    for r in bpe.digests(df, packing.rank_path()).collect():
        assert r.decoded_sha256 == hashlib.sha256(dict(rows)[r.doc_id].encode()).hexdigest()


def test_bytes_of_equal_sums_are_different_bytes(collision):
    rows, df = collision
    seen, want = set(), {}
    for i, text in rows:  # brute force over windows of 100 bytes
        raw, gone = text.encode(), np.zeros(len(text.encode()), bool)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(raw[k : k + 100])
        want[i] = int(gone.sum())
    assert {r.doc_id: r.n_removed for r in suffix_dedup.dedup(df, with_text=False).collect()} == want


def test_hashes_of_ranges_depend_on_every_value():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 4, 4000).astype(np.uint8)
    lo, size = rng.integers(0, 3000, 3000), rng.integers(8, 200, 3000)
    by_bytes, by_hash, by_codes = {}, common.bytes_hash(data, lo, size), common.chain_hash(common.BYTE_CODES[data], lo, size)
    for i, (a, n) in enumerate(zip(lo.tolist(), size.tolist())):
        by_bytes.setdefault(data[a : a + n].tobytes(), set()).add((int(by_hash[i]), int(by_codes[i])))
    assert all(len(v) == 1 for v in by_bytes.values())
    assert len({h for v in by_bytes.values() for h, _ in v}) == len({c for v in by_bytes.values() for _, c in v}) == len(by_bytes)


def test_long_texts_are_encoded_in_steps(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice(["a", "b ", " ", "  ", "\n", "'s", "é", "1", "日", " word", "don't we'll", "."]) for _ in range(4000))
    words = bpe.Vocabulary(packing.rank_path())
    whole = words.encode(text)
    monkeypatch.setattr(bpe, "STEP_BYTES", 300)
    assert words.encode(text) == whole
    data = np.frombuffer(text.encode(), np.uint8)
    pieces = bpe.cuts(data, 300)
    assert len(pieces) > 5 and [a for a, _ in pieces[1:]] == [b for _, b in pieces[:-1]] and pieces[-1][1] == len(data)
    assert bpe.cuts(np.frombuffer(b"x" * 5000, np.uint8), 300) == [(0, 5000)]


def test_known_words_are_forgotten_without_loss(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    words, rng = bpe.Vocabulary(packing.rank_path()), random.Random(6)
    texts = [prose(rng, 60) for _ in range(6)]
    assert [words.encode(t) for t in texts * 2] == [bpe.Vocabulary(packing.rank_path()).encode(t) for t in texts] * 2


@pytest.mark.parametrize("empty", [False, True])
def test_stages_keep_columns_of_any_name(spark, corpus, empty):
    rows = corpus + [(None, "some words of nobody"), (None, "other words of nobody at all"), (900, "one line\nanother line\none line"), (901, "one line\nanother line\none line")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.char_length("text").cast("long"))
    for name in CLASHING:
        df = df.withColumn(name, F.lit(7))
    docs = df.limit(0) if empty else df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = common.staged(stage(spark, docs, ""), name)
        assert found.columns == df.columns
        assert found.select(*CLASHING).distinct().count() <= 1
        assert found.where("n_chars <> char_length(text)").count() == 0
        if empty:
            assert found.count() == 0
        else:
            assert 0 < found.count() <= docs.count()
        docs = found
    assert (corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0) == empty


def test_line_columns_give_way(spark, corpus):
    df = frame(spark, corpus).withColumn("n_lines", F.lit("x")).withColumn("n_removed", F.lit("x"))
    found = line_dedup.dedup(df)
    assert sorted(found.columns) == sorted(df.columns) and dict(found.dtypes)["n_lines"] == "bigint"
    assert found.where("text is null").select("n_lines", "n_removed").distinct().collect() == [(0, 0)]


def test_long_lines_and_sketches(spark):
    """Lines on both sides of the length with a second sketch, against brute force."""
    rng = random.Random(11)
    base = [[f"w{rng.randrange(900)}" for _ in range(n)] for n in (20, 60, 64, 65, 70, 130, 260, 500) for _ in range(4)]
    lines = [" ".join(b) for b in base]
    for b in base:
        for share in (0.02, 0.08, 0.12, 0.2):
            lines.append(" ".join(w if rng.random() > share else f"v{rng.randrange(99999)}" for w in b))
    rng.shuffle(lines)
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    sets = [set(x.split()) for x in lines]
    want = {i: int(any(10 * len(sets[i] & s) >= 8 * len(sets[i] | s) for s in sets[:i])) for i in range(len(sets))}
    assert got == want and 20 < sum(want.values()) < len(want) - 20


def test_more_languages_than_a_model_once_held(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}q " * 30, f"l{i % 230}") for i in range(1400)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 230


def test_vectors_of_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(vectors, "FITTED", 2)
    rows = [(10 * n + k, [1.0] * n + [0.001 * k]) for n in range(1, 12) for k in range(3)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert all(r.n_links == 2 and r.component_id == r.vec_id // 10 * 10 for r in got) and len(got) == 33


def test_folder_of_a_session_without_a_setting(spark):
    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf, sparkContext, _jvm, _jsc = Conf(), spark.sparkContext, spark._jvm, spark._jsc

    kept = dict(common._folders)
    try:
        common._folders.clear()
        path = common.shared_dir(Session())
        assert path.startswith("file:/") and common.shared_dir(Session()) == path
    finally:
        common._folders.clear()
        common._folders.update(kept)


def test_a_staged_table_can_be_discarded(spark):
    found = common.staged(spark.range(5), "test")
    assert found.count() == 5
    common.discard(found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found.staged_at)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
