"""What the queries over plain tables write and shuffle before they search."""

import pytest
from pyspark.sql import functions as F

from quillspark import queries as own
from quillspark.errors import RequestError

from .test_grouping import ready, shuffled
from .test_queries import SF, duck, pytestmark, rows  # noqa: F401

WORDLESS = "p01_match_all p02_no_query p03_term_string p11_range_int p11_range_float p11_range_string p12_exists p13_set p15_frange p15_frange_missing c09_func_score rq_multi_select rq_facet_range rq_json_facet rq_json_max rq_stats rq_groups rq_fq_frange".split()


@pytest.mark.parametrize("name", WORDLESS)
def test_queries_without_words_write_no_index(spark, duck, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(own, "_INDEXES", {})
    df, want = own.QUERIES[name](spark, SF), duck.sql(own.ORACLES[name])
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), list(want.columns))
    assert own._INDEXES == {}


def test_a_word_asked_of_a_plain_table_is_an_error(spark):
    with pytest.raises(RequestError):
        own.found(own.plain_documents(spark, SF), "text:license", "doc_id")
    with pytest.raises(RequestError):
        own.found(own.plain_documents(spark, SF), "license", "doc_id")


@pytest.mark.parametrize("texts", [False, True])
def test_a_large_table_is_indexed_without_a_shuffle(spark, monkeypatch, texts):
    monkeypatch.setattr(own, "_INDEXES", {})
    monkeypatch.setattr(own, "SMALL", 0)
    since = ready(spark)
    found = own.indexed(spark, SF, "documents", "text", texts=texts)
    assert shuffled(spark, since)[0] == 0
    assert ("text" in found.columns) == texts
    docs = own.read(spark, SF, "documents")
    want = docs.select("doc_id", "lang", "source", "n_chars", own.simple_tokens(F.col("text")).alias("text__terms"))
    assert sorted(found.select(want.columns).collect()) == sorted(want.collect())


@pytest.mark.parametrize("name", ["p14_filters", "rq_facet_fields"])
def test_queries_of_words_write_terms_alone(spark, duck, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(own, "_INDEXES", {})
    monkeypatch.setattr(own, "SMALL", 0)
    df, want = own.QUERIES[name](spark, SF), duck.sql(own.ORACLES[name])
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), list(want.columns))
    (path,) = own._INDEXES.values()
    assert "text" not in spark.read.parquet(path).columns


def test_indexes_of_other_columns_are_others(spark, monkeypatch):
    monkeypatch.setattr(own, "_INDEXES", {})
    assert "p_type__terms" not in own.indexed(spark, SF, "part", "p_name").columns
    assert "p_type__terms" in own.indexed(spark, SF, "part", "p_name", "p_type").columns
