"""Handlers beside search: documents like one, terms of fields, suggestions, and what a core holds."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..errors import RequestError
from ..operators import components, ordering
from ..sources.core import Core, stored
from .compile import dictionary
from .params import Params
from .request import Search, named_list

#: Suggesters that a request may name: the undetermined language and two-letter codes.
LANGUAGES = "und ar bg bn ca cs cy da de el en es et eu fa fi fr ga gl he hi hr hu hy id is it ja ko lt lv nb nl nn no pl pt ro ru sk sl sr sv th tr uk zh".split()


def answered(run):
    """Takes parameters in any form; refusals become an error block."""

    @functools.wraps(run)
    def handler(core: Core, params: Params | dict | str) -> dict:
        p = params if isinstance(params, Params) else Params.parse(params) if isinstance(params, str) else Params.of(params)
        try:
            head = {} if p.flag("omitHeader") else {"responseHeader": {"status": 0}}
            return head | run(core, p)
        except RequestError as e:
            return e.envelope({})

    return handler


def _optional(p: Params, name: str) -> int | None:
    return None if p.get(name) is None else p.number(name, 0)


@answered
def more_like_this(core: Core, p: Params) -> dict:
    """Documents that share the seed's best terms.  The seed is a hit of ``q`` (``mlt.match.offset``), whatever the filters say.

    Terms are mined field by field (``mlt.fl``, or the default field) and the fields' scores added; filters narrow the result.
    """
    fl = ",".join(p.all("fl")) or None
    score = bool(fl) and "score" in fl.replace(" ", ",").split(",")
    plain = Search(core, Params([(k, v) for k, v in p.pairs if k not in ("fq", "facet", "json.facet")]))
    key, fields = core.schema.unique_key, stored(core.schema, plain.index.docs.columns, fl)
    at, start, rows = p.number("mlt.match.offset", 0), p.number("start", 0), min(p.number("rows", ordering.ROWS), ordering.ROWS_CAP)
    hits = plain.hits()
    total = hits.agg(F.count(F.lit(1)).alias("n"), F.max("_score").alias("m")).first()
    keys = plain.order(plain.keys)
    shown = [*[F.col(f"`{f.name}`") for f in fields], "_score", F.col("doc_ord").alias("_ord")]
    seed = ordering.page(hits, keys[:-1], keys[-1], at, 1).select(*shown).collect()
    block = lambda n, first, best, docs: {"numFound": n, "start": first} | ({"maxScore": best} if score and n else {}) | {"docs": docs}
    out = {"match": block(total["n"], at, total["m"], plain.render(seed, fields, score, {}))}
    if p.get("mlt.match.include") == "false":
        out = {}
    if not seed:
        return out | {"response": None}
    options = components.MoreLikeThis(
        p.number("mlt.mintf", 2), p.number("mlt.mindf", 5), _optional(p, "mlt.maxdf"), p.number("mlt.minwl", 0), p.number("mlt.maxwl", 0), p.number("mlt.maxqt", 25), p.number("mlt.maxntp", 5000), p.flag("mlt.boost")
    )
    index, found, best = plain.index, None, []
    own = F.col("doc_ord") == seed[0]["_ord"]
    for name in (p.get("mlt.fl") or index.field(None).name).replace(",", " ").split():
        f = index.field(name)
        if f.kind != "text":
            raise RequestError(f"mlt.fl: {name} is no text field")
        some = components.more_like(index.docs, "doc_ord", own, index.terms(f), options)
        found = some if found is None else found.unionAll(some)
        if p.get("mlt.interestingTerms") in ("list", "details"):
            best += [(f"{name}:{r['term']}", r["weight"]) for r in components.interesting_terms(index.docs, index.docs.where(own), index.terms(f), options).collect()]
    narrowed = Search(core, Params([("q", "*:*"), *[(k, v) for k, v in p.pairs if k in ("fq", "df")]])).hits().drop("_score")
    alike = narrowed.join(found.groupBy("doc_ord").agg(F.sum("score").alias("_score")), "doc_ord")
    total = alike.agg(F.count(F.lit(1)).alias("n"), F.max("_score").alias("m")).first()
    page = ordering.page(alike, [F.desc("_score")], F.asc("doc_ord"), start, rows).select(*shown).collect() if rows else []
    out["response"] = block(total["n"], start, total["m"], plain.render(page, fields, score, {}))
    if p.get("mlt.interestingTerms") == "list":
        out["interestingTerms"] = [t for t, _ in best]
    elif p.get("mlt.interestingTerms") == "details":
        out["interestingTerms"] = named_list(best, p.get("json.nl", "flat"))
    return out


@answered
def terms(core: Core, p: Params) -> dict:
    """Indexed terms of the fields ``terms.fl`` with their document counts, the most frequent first; unknown fields have none."""
    if not p.flag("terms", True):
        return {}
    index, out = core.index(p.get("df")), {}
    for name in p.all("terms.fl"):
        f = core.schema.find(name)
        if f is None:
            out[name] = named_list([], p.get("json.nl", "flat"))
            continue
        if f.kind != "text":
            raise RequestError(f"terms.fl: {name} is no text field")
        found = components.enumerate_terms(dictionary(index, f), p.get("terms.prefix", ""), p.number("terms.limit", 10)).collect()
        out[name] = named_list([(r["term"], r["df"]) for r in found], p.get("json.nl", "flat"))
    return {"terms": out} if p.all("terms.fl") else {}


@answered
def suggest(core: Core, p: Params) -> dict:
    """Stored phrases (``suggest.field``) that hold the typed words, the last as a prefix, in document order.

    A context filter on ``suggest.context`` tags turns highlighting off.  Building a dictionary is a no-op that is echoed.
    """
    typed = p.get("suggest.q")
    if typed is None:
        done = [c for c in ("buildAll", "reloadAll", "build", "reload") if p.flag(f"suggest.{c}")]
        return {"command": done[0]} if done else {}
    names = p.all("suggest.dictionary") or ["und"]
    for name in names:
        if name not in LANGUAGES:
            raise RequestError(f"no suggester {name}")
    index = core.index(None)
    f, context = index.field(p.get("suggest.field", "twm_suggest")), p.get("suggest.cfq")
    tag = core.schema.find(p.get("suggest.context", "sm_context_tags"))
    tags = None if tag is None or tag.name not in index.docs.columns else index.column(tag.name) if tag.array else F.array(index.column(tag.name).cast("string"))
    found = components.suggest(index.docs, index.terms(f), typed, F.asc("doc_ord"), p.number("suggest.count", 10), tags, context).select(F.col(f"`{f.name}`").alias("phrase")).collect()
    mark = p.flag("suggest.highlight", True) and not context
    phrases = [x for r in found for x in (r["phrase"] if isinstance(r["phrase"], list) else [r["phrase"]])]
    shown = [{"term": components.suggest_highlight(x, typed) if mark else x, "weight": 0, "payload": ""} for x in phrases]
    return {"suggest": {name: {typed: {"numFound": len(shown), "suggestions": shown}} for name in names}}


@answered
def luke(core: Core, p: Params) -> dict:
    """Counts of documents, and type and flags of every field."""
    docs = core.index(None).docs
    flags = lambda f: {"type": f.kind, "stored": f.stored, "fast": f.fast, "multiValued": f.array}
    names = [c for c in docs.columns if core.schema.find(c) is not None]
    return {"index": {"numDocs": docs.count(), "deletedDocs": 0}, "fields": {n: flags(core.schema.find(n)) for n in sorted(names)}}


@answered
def field_types(core: Core, p: Params) -> dict:
    """Kinds of fields that the schema uses, and the fields of each."""
    kinds: dict[str, list[str]] = {}
    for name, f in core.schema.fields.items():
        kinds.setdefault(f.kind, []).append(name)
    return {"fieldTypes": [{"name": k, "fields": sorted(v)} for k, v in sorted(kinds.items())]}
