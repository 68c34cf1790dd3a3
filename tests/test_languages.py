"""The pure sub-languages: parameters, query grammar, dates, functions, minimum match, analysis."""

from datetime import UTC, datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillspark.errors import RequestError
from quillspark.functions import analysis, dates, numeric, stemming
from quillspark.operators import components, facets
from quillspark.operators.ordering import parse_sort
from quillspark.plans import ast
from quillspark.plans.compile import osa, wildcard_pattern
from quillspark.plans.edismax import minimum
from quillspark.plans.grammar import parse_query
from quillspark.plans.params import Params, parse_bool, parse_local


def test_params_decode_and_order():
    p = Params.parse("q=a+b&x=%41%zz&q=c", "y=1")
    assert p.get("q") == "a b" and p.all("q") == ["a b", "c"] and p.get("x") == "A%zz" and p.get("y") == "1"
    assert p.echo() == {"q": ["a b", "c"], "x": "A%zz", "y": "1"}


@pytest.mark.parametrize(("text", "want"), [("true", True), ("ONE", True), ("yes", True), ("false", False), ("off", False), ("no", False)])
def test_booleans(text, want):
    assert parse_bool(text) is want


def test_bad_boolean():
    with pytest.raises(RequestError):
        parse_bool("nope")


def test_local_params():
    found = parse_local("{!frange l=1 u='a b' l=2}sum(x,1)")
    assert (found.kind, found.values, found.rest) == ("frange", {"l": "1", "u": "a b"}, "sum(x,1)")
    assert parse_local("{!tag=a,b}f:1").tags("tag") == {"a", "b"}
    assert parse_local("{!open") is None and parse_local("x") is None


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a", ast.Term(None, "a")),
        ("f:a", ast.Term("f", "a")),
        ("*:*", ast.MatchAll()),
        ("f:*", ast.Exists("f")),
        ("f:[* TO *]", ast.Exists("f")),
        ("f:{1 TO 5]", ast.Range("f", "1", "5", False, True)),
        ("a~", ast.Fuzzy(None, "a", 2)),
        ("a~7", ast.Fuzzy(None, "a", 2)),
        ('"a b"~3', ast.Phrase(None, "a b", 3)),
        ("x^2", ast.Boost(ast.Term(None, "x"), 2.0)),
        ("f:/a.b/", ast.Regex("f", "a.b")),
        ("a AND b", ast.Bool(((ast.MUST, ast.Term(None, "a")), (ast.MUST, ast.Term(None, "b"))))),
        ("a OR b", ast.Bool(((ast.SHOULD, ast.Term(None, "a")), (ast.SHOULD, ast.Term(None, "b"))))),
    ],
)
def test_grammar(text, want):
    assert parse_query(text) == want


@pytest.mark.parametrize("text", ["(a", "a)", '"a', "/x/", "f:/x", "x^y", "AND a", "a AND", "f:[1 TO"])
def test_grammar_refuses(text):
    with pytest.raises(RequestError):
        parse_query(text)


@given(st.text("abc*~^\"()[]:/+- ", max_size=12))
def test_grammar_never_breaks(text):
    try:
        parse_query(text)
    except RequestError:
        pass


def test_dates():
    day = 86_400_000
    assert dates.truncated("1970") == (0, 365 * day - 1)
    assert dates.truncated("1970-01-02") == (day, 2 * day - 1)
    assert dates.interval("[* TO 1970-01-01]")[1] == day - 1
    now = datetime(2024, 3, 31, 15, 30, tzinfo=UTC)
    assert dates.date_math("NOW/DAY", now) == dates.instant("2024-03-31T00:00:00Z")
    assert dates.date_math("NOW-1MONTH/MONTH", now) == dates.instant("2024-02-01T00:00:00Z")
    assert dates.date_math("NOW/WEEK", now) == dates.instant("2024-03-25T00:00:00Z")
    for bad in ("2020-13", "x", "NOW/FOO", "[2021 TO 2020]"):
        with pytest.raises(RequestError):
            dates.interval(bad) if bad.startswith("[") else dates.date_math(bad)


def test_functions_parse():
    call = numeric.parse_function("sum(a, product(2,b), recip(x,1,2,3))")
    assert numeric.fields_of(call) == {"a", "b", "x"}
    for bad in ("sum(a", "foo(a)", "recip(a,1)", "", "a b"):
        with pytest.raises(RequestError):
            numeric.parse_function(bad)


@pytest.mark.parametrize(("spec", "n", "want"), [("2", 4, 2), ("-1", 4, 3), ("75%", 4, 3), ("-25%", 5, 4), ("2<75%", 2, 2), ("2<75%", 8, 6), ("3<-1 5<80%", 10, 8), ("9", 3, 3), ("-9", 3, 0)])
def test_minimum(spec, n, want):
    assert minimum(spec, n) == want


def test_sort_spec():
    assert [(k.name, k.descending) for k in parse_sort("a asc, geodist() desc")] == [("a", False), ("geodist()", True)]
    for bad in ("a", "a up", "a asc,"):
        with pytest.raises(RequestError):
            parse_sort(bad)


def test_alignment_distance():
    assert osa("ca", "abc", 3) == 3 and osa("abcd", "abdc") == 1 and osa("a", "abcd") == 3


def test_wildcards():
    assert wildcard_pattern("a*b?.") == r"(?s)^a.*b.\.$"


def test_stems_and_chains():
    words = {"caresses": "caress", "ponies": "poni", "running": "run", "hoping": "hope", "relational": "relat", "generally": "general", "skies": "sky"}
    assert {w: stemming.english(w) for w in words} == words
    assert [t.term for t in analysis.CHAINS["text_en"]("The Quick foxes")] == ["quick", "fox"]
    assert [t.term for t in analysis.CHAINS["text_general"]("Crème BRÛLÉE")] == ["creme", "brulee"]
    assert [(t.term, t.pos) for t in analysis.delimit([analysis.Token("PowerShot500", 0, 0, 12)])] == [("PowerShot500", 0), ("Power", 0), ("Shot", 1), ("500", 2)]
    assert analysis.lower("İX") == "ix"
    assert analysis.payload_of("a|b|2.5") == ("a|b", 2.5) and analysis.payload_of("a|inf") == ("a|inf", None)


def test_grid():
    assert facets.grid(1) == (8, 4) and facets.grid(2) == (32, 32)
    assert facets.range_edges(0, 25, 10) == (3, 30)


def test_fragments():
    h = components.Highlight(frozenset(["fox"]), size=0)
    assert components.fragments("a fox ran", analysis.CHAINS["simple"], h) == ["a <em>fox</em> ran"]
    long = "word " * 60 + "fox here"
    (one,) = components.fragments(long, analysis.CHAINS["simple"], components.Highlight(frozenset(["fox"])))
    assert "<em>fox</em>" in one and len(one) < 180
    assert components.suggest_highlight("quick brown fox", "quick br") == "<b>quick</b> <b>br</b>own fox"
