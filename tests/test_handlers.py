"""Handlers, nested blocks, one-scan JSON facets, frames and deadlines, over a core of a few documents."""

import time

import pytest

from quillspark.errors import RequestError
from quillspark.plans import handlers
from quillspark.plans.grammar import parse_query
from quillspark.plans.request import select
from quillspark.sources.core import Core, work_folder
from quillspark.sources.schema import Schema

FIELDS = [
    {"name": "id", "type": "string", "stored": True, "fast": True, "required": True},
    {"name": "body", "type": "text_general", "stored": True},
    {"name": "kind", "type": "string", "stored": True, "fast": True},
    {"name": "tags", "type": "string", "stored": True, "fast": True, "multi_valued": True},
    {"name": "size", "type": "int", "stored": True, "fast": True},
]
DOCS = [
    {"id": "1", "body": "red wine from old hills", "kind": "a", "tags": ["x", "y"], "size": 4},
    {"id": "2", "body": "red wide river from hills", "kind": "a", "tags": ["x"], "size": 9},
    {"id": "3", "body": "green river and old wine", "kind": "b", "tags": ["y", "y"], "size": 1},
    {"id": "4", "body": "wine wine wine hills", "kind": "a", "tags": ["z"], "size": 7},
    {"id": "5", "body": "nothing alike", "kind": "c"},
]


def schema(**more):
    return Schema.from_dict({"unique_key": "id", "default_field": "body", "fields": FIELDS, **more})


@pytest.fixture(scope="module")
def core(spark, tmp_path_factory):
    core = Core.open(spark, str(tmp_path_factory.mktemp("handlers")), schema())
    core.add(DOCS)
    core.commit()
    return core


def ids(block):
    return [d["id"] for d in block["docs"]]


def test_nested_blocks_take_the_text_up_to_white_space(core):
    assert ids(select(core, {"q": "+{!edismax qf=body}wine +kind:a", "sort": "size asc"})["response"]) == ["1", "4"]
    assert ids(select(core, {"q": "({!edismax qf=body v='green river'}) OR size:9", "sort": "size asc"})["response"]) == ["3", "2"]
    assert ids(select(core, {"q": "{!tag=t}kind:b OR {!tag=u}size:9", "sort": "size asc"})["response"]) == ["3", "2"]
    with pytest.raises(RequestError):
        parse_query("a {!edismax qf=body}b")
    assert "error" in select(core, {"q": "a AND {!strange}b"})


def test_json_facets_nest_over_arrays_and_single_values(core):
    spec = '{"k": {"type": "terms", "field": "kind", "facet": {"top": "max(size)", "t": {"type": "terms", "field": "tags", "sort": "index asc", "facet": {"top": "max(size)"}}}}}'
    found = select(core, {"q": "*:*", "rows": 0, "json.facet": spec})["facets"]
    assert found["count"] == 5
    a, b, c = found["k"]["buckets"]
    assert (a["val"], a["count"], a["top"]) == ("a", 3, 9) and (b["val"], b["count"], b["top"]) == ("b", 1, 1) and "top" not in c
    assert [(t["val"], t["count"], t["top"]) for t in a["t"]["buckets"]] == [("x", 2, 9), ("y", 1, 4), ("z", 1, 7)]
    assert [(t["val"], t["count"]) for t in b["t"]["buckets"]] == [("y", 1)] and c["t"] == {"buckets": []}
    for bad in ('{"k": {"type": "terms", "field": "kind", "odd": 1}}', '{"k": "min(size)"}', '{"k": "max(body)"}'):
        assert "error" in select(core, {"q": "*:*", "json.facet": bad})


def test_warnings_lead_the_header(core):
    header = select(core, {"q": "*:*", "rows": 0, "facet": "true", "facet.field": "size"})["responseHeader"]
    assert next(iter(header)) == "warnings" and "size" in header["warnings"][0]
    assert "warnings" not in select(core, {"q": "*:*", "rows": 0, "facet": "true", "facet.field": "kind"})["responseHeader"]


def test_more_like_this(core):
    p = {"q": "id:1", "mlt.fl": "body", "mlt.mintf": 1, "mlt.mindf": 2, "fl": "id,score", "mlt.interestingTerms": "list"}
    found = handlers.more_like_this(core, p)
    assert ids(found["match"]) == ["1"] and set(ids(found["response"])) == {"2", "3", "4"}
    scores = [d["score"] for d in found["response"]["docs"]]
    assert scores == sorted(scores, reverse=True) and found["response"]["maxScore"] == scores[0]
    assert set(found["interestingTerms"]) == {"body:" + t for t in ("red", "wine", "from", "old", "hills")}
    assert ids(handlers.more_like_this(core, p | {"fq": "kind:b"})["response"]) == ["3"]  # filters leave the seed alone
    assert handlers.more_like_this(core, {"q": "id:none"})["response"] is None
    assert "error" in handlers.more_like_this(core, {"q": "id:1", "mlt.fl": "kind"})


def test_terms_and_suggestions(core):
    assert handlers.terms(core, {"terms.fl": "body", "terms.limit": 2})["terms"]["body"] == ["hills", 3, "wine", 3]
    assert handlers.terms(core, {"terms.fl": ["body", "none"], "terms.prefix": "wi", "json.nl": "map"})["terms"] == {"body": {"wine": 3, "wide": 1}, "none": {}}
    assert "error" in handlers.terms(core, {"terms.fl": "kind"})
    p = {"suggest.q": "red wi", "suggest.field": "body", "suggest.context": "tags"}
    shown = handlers.suggest(core, p)["suggest"]["und"]["red wi"]
    assert [s["term"] for s in shown["suggestions"]] == ["<b>red</b> <b>wi</b>ne from old hills", "<b>red</b> <b>wi</b>de river from hills"]
    one = handlers.suggest(core, p | {"suggest.cfq": "+y"})["suggest"]["und"]["red wi"]
    assert [s["term"] for s in one["suggestions"]] == ["red wine from old hills"]
    assert "error" in handlers.suggest(core, p | {"suggest.dictionary": "xx"}) and "error" in handlers.suggest(core, p | {"suggest.count": 0})
    assert handlers.suggest(core, {"suggest.build": "true"})["command"] == "build"


def test_luke_and_field_types(core):
    found = handlers.luke(core, {})
    assert found["index"]["numDocs"] == 5 and found["fields"]["tags"]["multiValued"]
    assert {t["name"] for t in handlers.field_types(core, {})["fieldTypes"]} == {"string", "text", "int"}


def test_frames_and_deadlines(spark, tmp_path):
    core = Core.open(spark, str(tmp_path / "c"), schema(), auto_ms=0, background=True)
    core.add(DOCS[:2])
    for _ in range(100):
        if not core.pending and core.docs().count() == 2:
            break
        time.sleep(0.2)
    assert core.docs().count() == 2
    core.auto_ms = None
    core.add_frame(spark.createDataFrame([("2", "blue sky", 3), ("9", "blue sea", 5)], "id string, body string, size long"))
    core.commit()
    assert ids(select(core, {"q": "blue", "sort": "size asc"})["response"]) == ["2", "9"] and core.docs().count() == 3
    core.add([DOCS[4]])
    core.commit()
    assert core.docs().count() == 4 and core.docs().select("doc_ord").distinct().count() == 4
    with pytest.raises(RequestError):
        core.add_frame(spark.range(1).toDF("other"))


def test_other_rules_are_other_tables():
    rule = lambda kind: schema(dynamic_fields=[{"pattern": "*_x", "type": kind, "stored": True}])
    assert rule("string").fingerprint() != rule("int").fingerprint() != schema().fingerprint()


def test_work_folder_of_a_session_without_one(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert work_folder(spark) == (before or work_folder(spark))
