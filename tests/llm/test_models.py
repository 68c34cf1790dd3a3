"""Operators 1 and 10: held-out accuracy, bounds and edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import language, quality

SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert len(found) == 1000 and set(held.index) and (held.lang_pred == held.lang).mean() > 0.97
    assert ((found.score >= 0) & (found.score <= 1)).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(found.doc_id, found.held_out))


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "de"), (4, "the of and the", "en"), (5, "der die das und", "de"), (None, "the and of", None), (6, "É", None), (4, "the of and the", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_score", F.lit(1))
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs)).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].lang_rejected and by[6].lang_pred in ("en", "de")
    empty = docs.limit(0)
    assert language.fit(empty) is None
    assert {r.lang_pred for r in language.identify(docs.select("doc_id", "text"), None).collect()} == {"und"}


def test_neighbours_do_not_matter():
    data = [b"hello there", b"", b"ab", b"a", "é".encode() * 30]
    model = language.train([b"the and of in to", b"der die das und"] * 10, ["en", "de"] * 10)
    joined = np.frombuffer(b"".join(data), np.uint8)
    offsets = np.append(0, np.cumsum([len(d) for d in data]))
    together = model.logits(joined, offsets)
    alone = np.concatenate([model.logits(np.frombuffer(d, np.uint8), np.array([0, len(d)])) for d in data])
    assert np.allclose(together, alone)


def test_quality_accuracy(spark):
    found = quality.query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.predicted == held.quality).mean() > 0.93
    assert ((found.score >= 0) & (found.score <= 1)).all() and ((found.score >= 0.5) == (found.predicted == 1)).all()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (None, "y"), (3, "x")], "doc_id long, text string").withColumn("stats", F.lit(0)).withColumn("quality", F.lit(9))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.classify(docs, none).collect()] == [0.5] * 5
    one = spark.createDataFrame([(2, 1, 0), (3, 1, 0), (2, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.classify(docs, one).collect()) == 5
    assert quality.classify(docs.limit(0), one).collect() == []


def test_isotonic():
    assert np.allclose(quality.isotonic(np.array([1.0, 0, 1, 2]), np.array([1.0, 1, 1, 2])), [0.5, 0.5, 1, 1])


@pytest.mark.parametrize("n", [1, 3])
def test_statistics_by_text(n):
    texts = ["", "One two two.\nOne two two.\n", "###", "É a"][: n + 1]
    raw = [t.encode() for t in texts]
    together = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    alone = np.concatenate([quality.statistics(np.frombuffer(r, np.uint8), np.array([0, len(r)])) for r in raw])
    assert np.allclose(together, alone) and (together[0] == 0).all()
