"""From query trees to column expressions over a document table.

Every node becomes a boolean column (does it match?) and a score column.  Nothing is joined or shuffled: tokens lie in
array columns of the document table, and the corpus counts that BM25 needs come from one aggregate over the named terms.
Filters on plain columns therefore reach the file scan.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InternalError, RequestError
from ..functions import dates, numeric
from ..sources.schema import Field, Schema
from . import ast

K1, B = 1.2, 0.75
#: A fuzzy word's terms, up to so many, are conditions of their own; more are looked up, which decides the form only.
FEW = 64


@dataclass
class Index:
    """A document table with its schema; ``default`` is the field of words without one."""

    docs: DataFrame
    schema: Schema
    default: str | None = None
    synonyms: list[list[str]] = field(default_factory=list)
    stats: dict = field(default_factory=dict)

    def field(self, name: str | None) -> Field:
        name = name or self.default or self.schema.default_field
        f = self.schema.find(name) if name else None
        if f is None:
            raise RequestError(f"undefined field {name}")
        return f

    def column(self, name: str) -> Column:
        if name not in self.docs.columns:
            return F.lit(None).cast(self.field(name).type)
        return F.col(f"`{name}`")

    def number(self, name: str) -> Column:
        """A field as function queries see it: its first value."""
        f = self.field(name)
        if f.kind not in ("int", "float", "date") or not f.fast:
            raise RequestError(f"field {name} can't be used in a function")
        c = F.get(self.column(name), 0) if f.array else self.column(name)
        return F.unix_millis(c).cast("double") if f.kind == "date" else c.cast("double")

    def terms(self, f: Field) -> Column:
        """Indexed terms of a field as an array; null counts as none."""
        if f"{f.name}__terms" in self.docs.columns:
            terms = F.col(f"`{f.name}__terms`")
        elif f.kind in ("text", "payload"):
            terms = F.col(f"`{f.tokens}`")["term"] if f.tokens in self.docs.columns else F.array().cast("array<string>")
        else:
            c = self.column(f.name)
            terms = c if f.array else F.when(c.isNotNull(), F.array(c))
        return F.coalesce(terms.cast("array<string>"), F.array().cast("array<string>"))


def prepare(index: Index, nodes: list[ast.Node]) -> None:
    """Corpus counts of all terms in the trees, by one aggregate over the table."""
    wanted: dict[tuple[str, str], None] = {}
    for node in (x for n in nodes for x in ast.leaves(n)):
        if isinstance(node, (ast.Term, ast.Phrase)):
            f = index.field(node.field)
            if f.kind == "text":
                for t in f.chain(node.text):
                    wanted[f.name, t.term] = None
                    for g in index.synonyms:
                        if t.term in g:
                            wanted.update({(f.name, s): None for s in g})
            elif f.kind == "string":
                wanted[f.name, node.text] = None
    wanted = {k: None for k in wanted if k not in index.stats}
    if not wanted:
        return
    names = list({f for f, _ in wanted})
    aggs = []
    for name in names:
        size = F.size(index.terms(index.schema.find(name)))
        aggs += [F.count_if(size > 0), F.sum(F.when(size > 0, size))]
    keys = list(wanted)
    aggs += [F.count_if(F.array_contains(index.terms(index.schema.find(f)), t)) for f, t in keys]
    row = index.docs.agg(*[a.alias(f"c{i}") for i, a in enumerate(aggs)]).first()
    for i, name in enumerate(names):
        n = row[2 * i] or 0
        index.stats[name] = (n, (row[2 * i + 1] or 0) / n if n else 1.0)
    for i, key in enumerate(keys):
        index.stats[key] = row[2 * len(names) + i]


def idf(n: int, df: int) -> float:
    return math.log(1 + (max(n - df, 0) + 0.5) / (df + 0.5))


def bm25(tf: Column, length: Column, n: int, average: float, df: int) -> Column:
    return F.lit(idf(n, df)) * tf / (tf + K1 * (1 - B + B * length / max(average, 1e-9)))




@dataclass
class Compiled:
    match: Column
    score: Column


def compile_query(index: Index, node: ast.Node) -> Compiled:
    prepare(index, [node])
    return _compile(index, node)


def _flat(match: Column, score: float = 1.0) -> Compiled:
    match = F.coalesce(match, F.lit(False))
    return Compiled(match, F.when(match, F.lit(score)).otherwise(F.lit(0.0)))


def _compile(index: Index, node: ast.Node) -> Compiled:
    match node:
        case ast.MatchAll():
            return Compiled(F.lit(True), F.lit(1.0))
        case ast.MatchNone():
            return Compiled(F.lit(False), F.lit(0.0))
        case ast.Term():
            return _term(index, node)
        case ast.Phrase():
            return _phrase(index, node)
        case ast.Fuzzy():
            return _fuzzy(index, node)
        case ast.Wildcard():
            f = index.field(node.field)
            if f.kind not in ("text", "string"):
                raise RequestError(f"wildcards need a text field, not {f.name}")
            pattern = node.pattern.lower() if f.kind == "text" else node.pattern
            if re.fullmatch(r"[^*?\\]+\*", pattern):
                return _flat(F.exists(index.terms(f), lambda t: t.startswith(pattern[:-1])))
            return _flat(F.exists(index.terms(f), lambda t: t.rlike(wildcard_pattern(pattern))))
        case ast.Regex():
            f = index.field(node.field)
            try:
                re.compile(node.pattern)
            except re.error as e:
                raise InternalError(f"bad regular expression: {e}") from None
            return _flat(F.exists(index.terms(f), lambda t: t.rlike(f"^(?:{node.pattern})$")))
        case ast.Range():
            return _flat(_range(index, node))
        case ast.Exists():
            f = index.field(node.field)
            c = index.column(f.name)
            return _flat((F.size(index.terms(f)) > 0) if f.kind == "text" else (c.isNotNull() & (F.size(c) > 0)) if f.array else c.isNotNull())
        case ast.SetOf():
            f = index.field(node.field)
            if f.kind == "date_range":
                raise RequestError("sets are not for date ranges")
            parts = [_compile(index, ast.Term(node.field, v)).match for v in node.values]
            out = F.lit(False)
            for p in parts:
                out = out | p
            return _flat(out)
        case ast.Bool():
            return _bool(index, node)
        case ast.Boost():
            inner = _compile(index, node.inner)
            return Compiled(inner.match, inner.score * node.factor)
        case ast.Const():
            return _flat(_compile(index, node.inner).match, node.score)
        case ast.DisMax():
            parts = [_compile(index, p) for p in node.parts]
            if not parts:
                return Compiled(F.lit(False), F.lit(0.0))
            match, total = F.lit(False), F.lit(0.0)
            for p in parts:
                match, total = match | p.match, total + p.score
            top = F.greatest(*[p.score for p in parts]) if len(parts) > 1 else parts[0].score
            return Compiled(match, top + node.tie * (total - top))
        case ast.FuncScore():
            return Compiled(F.lit(True), numeric.value(numeric.parse_function(node.function), index.number).cast("float").cast("double"))
        case ast.FuncBoost():
            inner = _compile(index, node.inner)
            f = numeric.value(numeric.parse_function(node.function), index.number)
            return Compiled(inner.match, F.when(inner.match, inner.score + f if node.add else inner.score * f).otherwise(0.0))
        case ast.FuncRange():
            call = numeric.parse_function(node.function)
            x = numeric.value(call, index.number)
            match = numeric.exists(call, index.number)
            if node.low is not None:
                match = match & ((x >= node.low) if node.include_low else (x > node.low))
            if node.high is not None:
                match = match & ((x <= node.high) if node.include_high else (x < node.high))
            return _flat(match)
        case ast.Geo():
            lat, lon = _point(index, node.field)
            near = numeric.in_box if node.box else numeric.in_circle
            return _flat(near(lat, lon, node.lat, node.lon, node.km))
        case ast.Rectangle():
            lat, lon = _point(index, node.field)
            return _flat(lat.between(node.min_lat, node.max_lat) & lon.between(node.min_lon, node.max_lon))
        case ast.Interval():
            return _flat(interval_match(index.column(node.field), node.start, node.end, node.op))
        case ast.Payload():
            f = index.field(node.field)
            if f.kind != "payload":
                raise RequestError(f"field {f.name} has no payloads")
            words = node.text.split()
            if len(words) != 1:
                return Compiled(F.lit(False), F.lit(0.0))
            return payload_score(index.column(f.name), words[0], node.function)
    raise RequestError(f"unknown query {node}")


def wildcard_pattern(pattern: str) -> str:
    """An anchored regular expression for ``*`` and ``?``."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append({"*": ".*", "?": "."}.get(c, re.escape(c)))
        i += 1
    return f"(?s)^{''.join(out)}$"


def _point(index: Index, name: str) -> tuple[Column, Column]:
    f = index.field(name)
    if f.kind != "location":
        raise RequestError(f"field {name} is no location")
    c = F.get(index.column(name), 0) if f.array else index.column(name)
    return c["lat"], c["lon"]


def _one_term(index: Index, f: Field, term: str) -> Compiled:
    """BM25 of one indexed term; strings have neither counts nor lengths."""
    n, average = index.stats.get(f.name, (0, 1.0))
    df = index.stats.get((f.name, term), 0)
    terms = index.terms(f)
    if f.kind == "string":
        match = F.array_contains(terms, term) if f.array else index.column(f.name) == term
        return _flat(match, idf(n, df) / (1 + K1))
    match = F.array_contains(terms, term)
    tf = F.size(F.filter(terms, lambda t: t == term)).cast("double")
    return Compiled(match, F.when(match, bm25(tf, F.size(terms), n, average, df)).otherwise(0.0))


def _term(index: Index, node: ast.Term) -> Compiled:
    f = index.field(node.field)
    if f.kind == "text":
        places: dict[int, list[str]] = {}
        for t in f.chain(node.text):
            places.setdefault(t.pos, []).append(t.term)
            for g in index.synonyms:
                if t.term in g:
                    places[t.pos] += [s for s in g if s not in places[t.pos]]
        if not places:
            return Compiled(F.lit(False), F.lit(0.0))
        match, score = F.lit(True), F.lit(0.0)
        for terms in places.values():
            some, total = F.lit(False), F.lit(0.0)
            for term in dict.fromkeys(terms):
                one = _one_term(index, f, term)
                some, total = some | one.match, total + one.score
            match, score = match & some, score + total
        return Compiled(match, F.when(match, score).otherwise(0.0))
    if f.kind == "string":
        return _one_term(index, f, node.text)
    if f.kind == "date_range":
        start, end = dates.interval(node.text)
        return _compile(index, ast.Interval(f.name, start, end))
    if f.kind == "payload":
        return _flat(F.array_contains(index.terms(f), node.text))
    value = literal(f, node.text)
    c = index.column(f.name)
    return _flat(F.array_contains(c, value) if f.array else c == value)


def literal(f: Field, text: str) -> Column:
    """A range end or value of a typed field; what doesn't parse is refused."""
    try:
        if f.kind == "int":
            return F.lit(int(text)).cast("long")
        if f.kind == "float":
            return F.lit(float(text))
    except ValueError:
        raise RequestError(f"field {f.name}: bad number {text}") from None
    if f.kind == "date":
        return F.timestamp_millis(F.lit(dates.instant(text)).cast("long"))
    return F.lit(text)


def _range(index: Index, node: ast.Range) -> Column:
    f = index.field(node.field)
    if f.kind == "date_range":
        start, end = dates.interval(f"[{node.low or '*'} TO {node.high or '*'}]")
        return interval_match(index.column(f.name), start, end, "intersects")
    if f.kind in ("location", "payload"):
        raise RequestError(f"no ranges over {f.name}")
    low = None if node.low is None else literal(f, node.low)
    high = None if node.high is None else literal(f, node.high)

    def inside(c: Column) -> Column:
        out = c.isNotNull()
        if low is not None:
            out = out & ((c >= low) if node.include_low else (c > low))
        if high is not None:
            out = out & ((c <= high) if node.include_high else (c < high))
        return out

    if f.kind == "text":
        return F.exists(index.terms(f), inside)
    return F.exists(index.column(f.name), inside) if f.array else inside(index.column(f.name))


def _phrase(index: Index, node: ast.Phrase) -> Compiled:
    f = index.field(node.field)
    if f.kind != "text":
        return _term(index, ast.Term(node.field, node.text))
    words = f.chain(node.text)
    places = sorted({t.pos for t in words})
    if not places:
        return Compiled(F.lit(False), F.lit(0.0))
    if len(places) == 1 and not node.prefix:
        return _term(index, ast.Term(node.field, node.text))
    groups = [[t.term for t in words if t.pos == p] for p in places]
    if f.tokens in index.docs.columns:
        tokens = F.col(f"`{f.tokens}`")
    else:  # a plain list of terms, whose places are their numbers
        tokens = F.transform(index.terms(f), lambda t, i: F.struct(t.alias("term"), i.alias("pos")))

    def at(k: int) -> Column:
        def fits(t: Column) -> Column:
            if node.prefix and k == len(groups) - 1:
                return F.exists(F.array(*[F.lit(g) for g in groups[k]]), lambda g: t["term"].startswith(g))
            return t["term"].isin(groups[k])

        return F.transform(F.filter(tokens, fits), lambda t: t["pos"])

    first = at(0)
    others = [(at(k), places[k] - places[0]) for k in range(1, len(places))]

    def starts(p: Column) -> Column:
        out = F.lit(True)
        for found, shift in others:
            if node.slop:
                out = out & F.exists(F.transform(found, lambda x: F.abs(x - p - shift)), lambda d: d <= node.slop)  # noqa: B023
            else:
                out = out & F.array_contains(found, p + shift)
        return out

    hits = F.size(F.filter(first, starts))
    match = F.coalesce(hits > 0, F.lit(False))
    n, average = index.stats.get(f.name, (0, 1.0))
    weight = sum(idf(n, index.stats.get((f.name, g[0]), 0)) for g in groups)
    tf = hits.cast("double")
    length = F.size(index.terms(f))
    return Compiled(match, F.when(match, F.lit(weight) * tf / (tf + K1 * (1 - B + B * length / max(average, 1e-9)))).otherwise(0.0))


def osa(a: str, b: str, most: int = 2) -> int:
    """Optimal string alignment distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most and (before is None or min(last) > most):
            return most + 1
        before, last = last, now
    return min(last[-1], most + 1)


def with_distance(candidates: DataFrame, most: int) -> DataFrame:
    """Rows (term, df, word) with the distance of term and word, those within ``most``; computed by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [osa(t, w, most) for t, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            near = pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], ["term", "df", "word", "distance"])
            yield near.filter(pa.array([d <= most for d in found], pa.bool_()))

    return candidates.select("term", F.col("df").cast("long").alias("df"), "word").mapInArrow(run, "term string, df long, word string, distance int")


def near_terms(terms: DataFrame, word: str, most: int) -> list[tuple[str, int, int]]:
    """(term, distance, df) of all dictionary rows (term, df) within ``most``; only these come to the driver."""
    some = terms.where(F.levenshtein(F.col("term"), F.lit(word), 2 * most) >= 0).withColumn("word", F.lit(word))
    return [(r["term"], r["distance"], r["df"]) for r in with_distance(some, most).orderBy("term").collect()]


def dictionary(index: Index, f: Field) -> DataFrame:
    """(term, df) of a field."""
    return index.docs.select(F.explode(F.array_distinct(index.terms(f))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _fuzzy(index: Index, node: ast.Fuzzy) -> Compiled:
    f = index.field(node.field)
    if f.kind not in ("text", "string"):
        return Compiled(F.lit(False), F.lit(0.0))
    word = node.text.lower() if f.kind == "text" else node.text
    near = near_terms(dictionary(index, f), word, node.distance)
    if not near:
        return Compiled(F.lit(False), F.lit(0.0))
    if f.name not in index.stats:
        size = F.size(index.terms(f))
        n, total = index.docs.agg(F.count_if(size > 0), F.sum(F.when(size > 0, size))).first()
        index.stats[f.name] = (n or 0, (total or 0) / n if n else 1.0)
    index.stats.update({(f.name, term): df for term, _, df in near})
    if len(near) <= FEW:
        match, score = F.lit(False), F.lit(0.0)
        for term, _, _df in near:
            one = _one_term(index, f, term)
            match, score = match | one.match, score + one.score
        return Compiled(match, score)
    # any number of terms: they and their weights are one constant each, met by hash
    n, average = index.stats[f.name]
    wanted = F.split(F.lit("\0".join(term for term, *_ in near)), "\0", -1)
    weights = F.map_from_arrays(wanted, F.split(F.lit(" ".join(repr(idf(n, df)) for *_, df in near)), " ").cast("array<double>"))
    terms = index.terms(f)
    match = F.arrays_overlap(terms, wanted)

    def one_score(t: Column) -> Column:
        if f.kind == "string":
            return F.element_at(weights, t) / (1 + K1)
        tf = F.size(F.filter(terms, lambda x: x == t)).cast("double")
        return F.element_at(weights, t) * tf / (tf + K1 * (1 - B + B * F.size(terms) / max(average, 1e-9)))

    score = F.aggregate(F.array_intersect(terms, wanted), F.lit(0.0), lambda total, t: total + one_score(t))
    return Compiled(F.coalesce(match, F.lit(False)), F.when(match, score).otherwise(0.0))


def _bool(index: Index, node: ast.Bool) -> Compiled:
    """Of optional clauses one must match where no other is required; a clause of exclusions alone starts from all."""
    if not node.clauses:
        return Compiled(F.lit(False), F.lit(0.0))
    match, score = F.lit(True), F.lit(0.0)
    optional = []
    for occur, inner in node.clauses:
        c = _compile(index, inner)
        if occur == ast.MUST_NOT:
            match = match & ~c.match
            continue
        score = score + F.when(c.match, c.score).otherwise(0.0)
        if occur == ast.MUST:
            match = match & c.match
        else:
            optional.append(c.match)
    required = any(o == ast.MUST for o, _ in node.clauses)
    if not required and not optional:
        return Compiled(match, F.when(match, F.lit(1.0)).otherwise(0.0))
    least = node.least if node.least is not None else (0 if required else 1)
    if optional and least == 1:
        some = optional[0]
        for m in optional[1:]:
            some = some | m
        match = match & some
    elif least > 0:
        match = match & (sum((m.cast("int") for m in optional), F.lit(0)) >= least)
    return Compiled(match, F.when(match, score).otherwise(0.0))


def interval_match(spans: Column, start: int, end: int, op: str) -> Column:
    """Over an array of spans: any member meets the interval; all members lie in it; their merged runs cover it."""
    if op == "intersects":
        return F.exists(spans, lambda s: (s["start_ms"] <= end) & (s["end_ms"] >= start))
    if op == "within":
        return (F.size(spans) > 0) & F.forall(spans, lambda s: (s["start_ms"] >= start) & (s["end_ms"] <= end))
    if op == "contains":
        # walk the members by their start; the run that holds ``start`` grows while the next one begins at its end
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start_ms"].alias("a"), s["end_ms"].alias("b"))))
        reach = F.aggregate(ordered, F.lit(start - 1).cast("long"), lambda r, s: F.when((s["a"] <= r + 1) & (s["b"] > r), s["b"]).otherwise(r))
        return reach >= end
    raise RequestError(f"unknown interval operation {op}")


def payload_score(paid: Column, term: str, function: str) -> Compiled:
    """The least, greatest, mean or sum of the payloads of a term; an occurrence without one counts 1."""
    values = F.transform(F.filter(paid, lambda p: p["term"] == term), lambda p: F.coalesce(p["payload"], F.lit(1.0)).cast("double"))
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    scores = {"min": F.array_min(values), "max": F.array_max(values), "sum": total, "average": F.try_divide(total, F.size(values).cast("double"))}
    if function not in scores:
        raise RequestError(f"unknown payload function {function}")
    match = F.coalesce(F.size(values) > 0, F.lit(False))
    return Compiled(match, F.when(match, scores[function]).otherwise(0.0))
