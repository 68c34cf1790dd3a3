"""Cores from documents to answers: small corpora with known scores, counts and orders."""

import json

import pytest

from quillspark.errors import RequestError
from quillspark.plans.request import select
from quillspark.sources.core import Core
from quillspark.sources.schema import Schema, build

SCHEMA = """
[core]
name = "books"
unique_key = "id"
default_field = "body"
[[fields]]
name = "id"
type = "string"
stored = true
fast = true
required = true
[[fields]]
name = "body"
type = "text_en"
stored = true
[[fields]]
name = "category"
type = "string"
stored = true
fast = true
multi_valued = true
[[fields]]
name = "kind"
type = "string"
stored = true
fast = true
[[fields]]
name = "views"
type = "int"
stored = true
fast = true
[[fields]]
name = "price"
type = "float"
stored = true
fast = true
[[fields]]
name = "created"
type = "date"
stored = true
fast = true
[[fields]]
name = "loc"
type = "location"
stored = true
[[fields]]
name = "span"
type = "date_range"
stored = true
[[fields]]
name = "paid"
type = "boost_term_payload"
multi_valued = true
[[dynamic_fields]]
pattern = "*_s"
type = "string"
stored = true
fast = true
"""
DOCS = [
    {"id": "doc1", "body": "the quick brown fox jumps over the lazy dog", "category": ["animals", "classic"], "kind": "a", "views": 5, "price": 1.5, "created": "2020-01-02T00:00:00Z", "loc": "40.0,-74.0", "span": "2020", "paid": ["fox|2.0", "fox|4.0"]},
    {"id": "doc2", "body": "a lazy afternoon in the garden", "category": ["garden"], "kind": "a", "views": 15, "price": 2.5, "created": "2020-01-03T00:00:00Z", "loc": "41.0,-74.0", "span": "2020-06", "paid": ["fox"]},
    {"id": "doc3", "body": "quick thinking saves the day", "category": ["misc", "classic"], "kind": "b", "views": 25, "created": "2020-01-03T12:00:00Z", "span": "[2021 TO *]"},
    {"id": "doc4", "body": "dogs and cats living together", "category": ["animals"], "kind": "b", "views": 35, "price": 0.5, "extra_s": "x"},
    {"id": "doc5", "body": "nothing much here at all"},
]


@pytest.fixture(scope="module")
def core(spark, tmp_path_factory):
    made = Core.open(spark, str(tmp_path_factory.mktemp("core")), Schema.from_toml(SCHEMA))
    made.add(DOCS)
    made.commit()
    return made


def ids(answer):
    return [d["id"] for d in answer["response"]["docs"]]


def test_known_scores(core):
    out = select(core, {"q": "lazy", "fl": "id,score"})
    assert ids(out) == ["doc2", "doc1"]
    assert [d["score"] for d in out["response"]["docs"]] == pytest.approx([0.4574896, 0.3204711], abs=1e-6)
    out = select(core, {"q": "quick", "fl": "id,score"})
    assert [d["score"] for d in out["response"]["docs"]] == pytest.approx([0.4133114, 0.3204711], abs=1e-6)


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("*:*", ["doc1", "doc2", "doc3", "doc4", "doc5"]),
        ("dog", ["doc1", "doc4"]),
        ('"quick fox"', []),
        ('"brown fox"', ["doc1"]),
        ("category:animals -kind:b", ["doc1"]),
        ("-category:animals", ["doc2", "doc3", "doc5"]),
        ("views:[15 TO 25]", ["doc2", "doc3"]),
        ("views:{15 TO *]", ["doc3", "doc4"]),
        ("price:*", ["doc1", "doc2", "doc4"]),
        ("created:[2020-01-03T00:00:00Z TO *]", ["doc2", "doc3"]),
        ("ga*", ["doc2"]),
        ("qick~1", ["doc1", "doc3"]),
        ("kind:/[ab]/ AND lazy", ["doc1", "doc2"]),
        ("span:2020-06", ["doc1", "doc2"]),
        ("{!field f=span op=Within}2020", ["doc1", "doc2"]),
        ("{!field f=span op=Contains}2022", ["doc3"]),
        ("{!frange l=10 u=30}views", ["doc2", "doc3"]),
        ("{!geofilt sfield=loc pt=40.0,-74.0 d=50}", ["doc1"]),
        ("{!bbox sfield=loc pt=40.5,-74.0 d=60}", ["doc1", "doc2"]),
        ("extra_s:x", ["doc4"]),
        ("kind: IN [b c]", ["doc3", "doc4"]),
    ],
)
def test_matches(core, q, want):
    assert sorted(ids(select(core, {"q": q}))) == want


def test_no_query_matches_nothing(core):
    assert select(core, {})["response"]["numFound"] == 0


def test_functions_and_payloads(core):
    out = select(core, {"q": "{!func}sum(views,1)", "fl": "id,score", "fq": "views:*"})
    assert [(d["id"], d["score"]) for d in out["response"]["docs"]] == [("doc4", 36.0), ("doc3", 26.0), ("doc2", 16.0), ("doc1", 6.0)]
    out = select(core, {"q": "{!payload_score f=paid func=average}fox", "fl": "id,score"})
    assert [(d["id"], d["score"]) for d in out["response"]["docs"]] == [("doc1", 3.0), ("doc2", 1.0)]
    out = select(core, {"q": "{!boost b=views}lazy", "fl": "id,score"})
    assert out["response"]["docs"][0]["score"] == pytest.approx(15 * 0.4574896, abs=1e-5)


def test_edismax(core):
    out = select(core, {"q": "quick lazy", "defType": "edismax", "qf": "body", "mm": "2"})
    assert ids(out) == ["doc1"]
    assert select(core, {"q": "x", "defType": "edismax", "qf": "nope"})["error"]["code"] == 400


def test_sort_and_page(core):
    assert ids(select(core, {"q": "*:*", "sort": "views desc"})) == ["doc4", "doc3", "doc2", "doc1", "doc5"]
    assert ids(select(core, {"q": "*:*", "sort": "kind desc, views asc", "start": 1, "rows": 2})) == ["doc4", "doc1"]
    assert ids(select(core, {"q": "*:*", "sort": "category asc", "rows": 2})) == ["doc1", "doc4"]
    assert "error" in select(core, {"q": "*:*", "sort": "body asc"})


def test_facets(core):
    out = select(core, {"q": "*:*", "rows": 0, "facet": "true", "facet.field": "category", "facet.query": "views:[10 TO *]", "facet.range": "views", "facet.range.start": 0, "facet.range.end": 35, "facet.range.gap": 10})["facet_counts"]
    assert out["facet_fields"]["category"] == ["animals", 2, "classic", 2, "garden", 1, "misc", 1]
    assert out["facet_queries"] == {"views:[10 TO *]": 3}
    assert out["facet_ranges"]["views"] == {"counts": ["0", 1, "10", 1, "20", 1, "30", 1], "gap": "10", "start": 0, "end": 40}
    out = select(core, [("q", "*:*"), ("fq", "{!tag=k}kind:a"), ("facet", "true"), ("facet.field", "{!ex=k}kind"), ("facet.field", "category"), ("facet.mincount", 1), ("f.kind.facet.missing", "true")])
    assert out["response"]["numFound"] == 2
    assert out["facet_counts"]["facet_fields"]["kind"] == ["a", 2, "b", 2, None, 1]
    assert out["facet_counts"]["facet_fields"]["category"] == ["animals", 1, "classic", 1, "garden", 1]
    out = select(core, {"q": "*:*", "facet": "true", "facet.heatmap": "loc", "facet.heatmap.gridLevel": 1})["facet_counts"]["facet_heatmaps"]["loc"]
    assert sum(sum(r) for r in out["counts_ints2D"] if r) == 2 and (out["columns"], out["rows"]) == (8, 4)


def test_json_facets_and_stats(core):
    spec = {"k": {"type": "terms", "field": "kind", "facet": {"top": "max(views)"}}}
    out = select(core, {"q": "*:*", "json.facet": json.dumps(spec)})["facets"]
    assert out == {"count": 5, "k": {"buckets": [{"val": "a", "count": 2, "top": 15}, {"val": "b", "count": 2, "top": 35}]}}
    out = select(core, {"q": "*:*", "stats": "true", "stats.field": "price"})["stats"]["stats_fields"]["price"]
    assert (out["count"], out["missing"], out["sum"], out["min"]) == (3, 2, 4.5, 0.5)
    out = select(core, {"q": "doc9", "stats": "true", "stats.field": "price"})["stats"]["stats_fields"]["price"]
    assert out == {"min": None, "max": None, "count": 0, "missing": 0, "sum": 0.0, "sumOfSquares": 0.0, "mean": "NaN", "stddev": 0.0}


def test_groups(core):
    out = select(core, {"q": "*:*", "group": "true", "group.field": "kind", "group.limit": 2, "group.ngroups": "true", "sort": "views desc"})["grouped"]["kind"]
    assert (out["matches"], out["ngroups"]) == (5, 3)
    assert [(g["groupValue"], [d["id"] for d in g["doclist"]["docs"]]) for g in out["groups"]] == [("b", ["doc4", "doc3"]), ("a", ["doc2", "doc1"]), (None, ["doc5"])]
    out = select(core, {"q": "*:*", "group": "true", "group.field": "kind", "group.truncate": "true", "sort": "views desc", "facet": "true", "facet.field": "category", "facet.mincount": 1})
    assert out["facet_counts"]["facet_fields"]["category"] == ["animals", 1, "garden", 1]


def test_highlight_and_spelling(core):
    out = select(core, {"q": "lazy", "hl": "true"})
    assert out["highlighting"]["doc2"]["body"] == ["a <em>lazy</em> afternoon in the garden"]
    out = select(core, {"q": "gardn", "spellcheck": "true"})["spellcheck"]
    assert out["suggestions"][0]["suggestion"] == "garden" and out["collations"] == ["garden"]


def test_updates(spark, tmp_path):
    core = Core.open(spark, str(tmp_path / "c"), Schema.from_toml(SCHEMA))
    core.update('{"add": {"doc": {"id": "a", "views": 1}}, "add": {"doc": {"id": "a", "views": 2}}, "add": {"doc": {"id": "b"}}}')
    assert core.docs().count() == 0
    core.commit()
    assert select(core, {"q": "id:a"})["response"]["docs"] == [{"id": "a", "views": 2}]
    core.update('{"delete": {"query": "views:[2 TO *]"}, "add": {"doc": {"id": "b", "views": 9}, "overwrite": false}, "commit": {}}')
    assert select(core, {"q": "*:*"})["response"]["numFound"] == 2
    core.update('{"delete": ["b"]}', {"commit": "true"})
    assert core.docs().count() == 0
    for bad in ("{", '{"nope": 1}', '[{"views": 1}]', '[{"id": "x", "views": "1"}]', '[{"id": "x", "zzz": 1}]'):
        with pytest.raises(RequestError):
            core.update(bad)
    core.pending.clear()
    core.update('[{"id": "z"}]', {"commit": "true"})
    core.snapshot(str(tmp_path / "copy"))
    assert Core.open(spark, str(tmp_path / "copy"), Schema.from_toml(SCHEMA)).docs().count() == 1
    other = Schema.from_toml(SCHEMA.replace('type = "int"', 'type = "float"'))
    with pytest.raises(RequestError):
        Core.open(spark, str(tmp_path / "copy"), other)


def test_synonyms(core):
    core.set_synonyms([["fox", "reynard"]])
    assert ids(select(core, {"q": "reynard"})) == ["doc1"]
    core.set_synonyms([["a1", "a2"]])
    assert ids(select(core, {"q": "reynard"})) == []


def test_build_rules():
    schema = Schema.from_toml(SCHEMA)
    assert build(schema, {"id": "a", "views": [1], "body": None}) == {"id": "a", "views": 1}
    for bad in ({"id": "a", "views": [1, 2]}, {"id": "a", "price": "1"}, {"id": "a", "created": "2020"}, {"id": "a", "loc": "x"}, {"views": 1}):
        with pytest.raises(RequestError):
            build(schema, bad)
    with pytest.raises(RequestError):
        Schema.from_toml(SCHEMA.replace("required = true", "required = false"))
