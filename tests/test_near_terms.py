"""Words near others in large dictionaries: none may be lost, wherever in the alphabet it stands."""

import itertools

import pytest
from pyspark.sql import functions as F

from quillspark.operators import components
from quillspark.plans import ast, compile
from quillspark.plans.compile import Index, near_terms


def test_all_terms_within_the_distance(spark):
    far = ["".join(c) for c in itertools.islice(itertools.product("abcdefhjklm", repeat=4), 12_000)]
    terms = spark.createDataFrame([(t, 1) for t in [*far, "zing", "rign"]], "term string, df long")
    assert near_terms(terms, "ring", 2) == [("rign", 1, 1), ("zing", 1, 1)]


@pytest.mark.parametrize("kind", ["text", "string"])
def test_many_terms_match_and_score_as_few(spark, monkeypatch, kind):
    words = ["ring", "rings", "rign", "zing", "king", "far", "away"]
    rows = [(i, [words[i % 7], words[i * 3 % 7], words[i * 5 % 7], "ring"][: 1 + i % 4]) for i in range(40)]
    docs = spark.createDataFrame(rows, "id int, f__terms array<string>")

    class One:
        name, array, fast, tokens = "f", True, True, "f__tokens"

    One.kind = kind
    index = lambda: Index(docs.withColumn("f", F.col("f__terms")), None, "f")
    monkeypatch.setattr(Index, "field", lambda self, name: One)

    def run():
        one = index()
        c = compile._fuzzy(one, ast.Fuzzy("f", "ring", 2))
        return {r.id: (r.m, r.s) for r in one.docs.select("id", c.match.alias("m"), c.score.alias("s")).collect()}

    few = run()
    monkeypatch.setattr(compile, "FEW", 0)
    many = run()
    assert {i: m for i, (m, _) in few.items()} == {i: m for i, (m, _) in many.items()} and len({m for m, _ in few.values()}) == 2
    assert all(abs(few[i][1] - many[i][1]) < 1e-9 for i in few)


def test_spelling_finds_the_nearest_of_many(spark):
    """A swapped pair is one step, though thousands of terms before it are as near by single letters."""
    signs = "0123456789abcdefghijklmnopq"
    far = {a + "ign"[:k] + b + "ign"[k + 1 :] for a in signs for k in range(3) for b in signs + "rstuvwxyz" if b != "ign"[k]} - {"irgn"}
    counts = spark.createDataFrame([(t, 3) for t in [*far, "ring", "gizmo"]], "term string, df long")
    assert len(far) > 2000
    got = components.spellcheck(counts, "Rign gizmo")
    assert got == [{"word": "rign", "start": 0, "end": 4, "suggestion": "ring", "freq": 3}]
