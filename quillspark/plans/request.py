"""A whole search request: query, filters, page, facets, statistics, groups, highlighting and spelling in one answer."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import UTC

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions import dates, numeric
from ..operators import components, facets, grouping, ordering, stats
from ..sources.core import Core, stored
from ..sources.schema import Field
from . import ast
from .compile import Compiled, Index, compile_query, dictionary
from .edismax import edismax
from .grammar import parse_query
from .params import Local, Params, parse_local, strip_inert


def _number(text: str | None) -> float | None:
    return None if text in (None, "", "*") else float(text)


def geo_node(local: Local, params: Params, box: bool) -> ast.Node:
    read = lambda k: local.values.get(k) or params.get(k)
    if not read("sfield") or read("d") is None:
        raise RequestError("a spatial filter needs sfield, pt and d")
    lat, lon = numeric.parse_point(read("pt"))
    return ast.Geo(read("sfield"), lat, lon, float(read("d")), box)


def parse_any(text: str, index: Index, params: Params) -> ast.Node:
    """A block at the start decides the kind of query; otherwise it is the boolean language."""
    local = parse_local(text)
    inner = lambda block: parse_any(block, index, params)
    if local is None or local.kind is None:
        return parse_query(local.rest if local else text, inner)
    body = local.values.get("v", local.rest)
    if body.startswith("$"):
        body = params.get(body[1:], "")
    match local.kind:
        case "func":
            return ast.FuncScore(body)
        case "boost":
            return ast.FuncBoost(parse_any(body, index, params), local.values.get("b", "1"))
        case "frange":
            v = local.values
            flag = lambda k: v.get(k, "true") != "false"
            return ast.FuncRange(body, _number(v.get("l")), _number(v.get("u")), flag("incl"), flag("incu"))
        case "geofilt" | "bbox":
            return geo_node(local, params, local.kind == "bbox")
        case "payload_score":
            return ast.Payload(local.values["f"], body, local.values.get("func", ""))
        case "field":
            start, end = dates.interval(body)
            op = local.values.get("op", "Intersects").lower()
            return ast.Interval(local.values["f"], start, end, "within" if op == "iswithin" else op)
        case "edismax":
            v = local.values
            return edismax(body, index.schema, qf=v.get("qf", params.get("qf", "")), pf=v.get("pf", params.get("pf", "")), tie=float(v.get("tie", params.get("tie", "0"))), mm=v.get("mm", params.get("mm")))
        case "lucene":
            return parse_query(body, inner)
    raise RequestError(f"unknown query type {local.kind}")


@dataclass
class Filter:
    flag: str
    tags: set[str]
    match: Column


class Search:
    """One request on one generation.  ``base`` has one row for each document that may count anywhere, with its flags."""

    def __init__(self, core: Core, params: Params) -> None:
        self.core, self.params = core, params
        self.warnings: list[str] = []
        self.keys = ordering.parse_sort(params.get("sort", ""))
        self.index = core.index(params.get("df"))
        q = params.get("q")
        if q is None:
            tree: ast.Node = ast.MatchNone()
        elif params.get("defType") == "edismax" and not q.startswith("{!"):
            tree = edismax(q, core.schema, qf=params.get("qf", ""), pf=params.get("pf", ""), tie=float(params.get("tie", "0")), mm=params.get("mm"), bq=params.all("bq"), boost=params.all("boost"), bf=params.all("bf"))
        else:
            tree = parse_any(q, self.index, params)
        self.tree = tree
        self.query: Compiled = compile_query(self.index, tree)
        self.filters = []
        for i, text in enumerate(params.all("fq")):
            text, tags = strip_inert(text)
            self.filters.append(Filter(f"_f{i}", tags, compile_query(self.index, parse_any(text, self.index, params)).match))
        # without exclusions filters narrow the scan itself
        self.excludes = any("ex=" in v for k, v in params.pairs if k.startswith(("facet", "json")))
        docs = self.index.docs.where(self.query.match)
        if not self.excludes:
            for f in self.filters:
                docs = docs.where(f.match)
        else:
            docs = docs.withColumns({f.flag: F.coalesce(f.match, F.lit(False)) for f in self.filters})
        self.base = docs.withColumn("_score", self.query.score.cast("double"))

    def hits(self, exclude: set[str] = frozenset()) -> DataFrame:
        found = self.base
        if self.excludes:
            for f in self.filters:
                if not f.tags & exclude:
                    found = found.where(F.col(f.flag))
        return found

    def fast(self, name: str, what: str) -> Field:
        f = self.core.schema.find(name)
        if f is None:
            raise RequestError(f"{what}: undefined field {name}")
        if not f.fast:
            raise RequestError(f"{what}: field {name} is not fast")
        return f

    def order(self, keys: list[ordering.Key]) -> list[Column]:
        out = []
        for k in keys:
            if k.name == "score":
                out.append(F.desc("_score") if k.descending else F.asc("_score"))
            elif k.name.startswith("geodist"):
                out.append(ordering.function_key(self.distance(), k.descending))
            else:
                f = self.fast(k.name, "sort")
                if f.kind == "date_range":
                    raise RequestError(f"can't sort by {k.name}")
                c = self.index.column(k.name)
                if f.kind == "date":
                    c = F.transform(c, F.unix_millis) if f.array else F.unix_millis(c)
                out.append((ordering.text_key if f.kind in ("string", "text") else ordering.number_key)(c, k.descending, f.array))
        return (out or [F.desc("_score")]) + [F.asc("doc_ord")]

    def distance(self) -> Column:
        lat, lon = numeric.parse_point(self.params.get("pt", ""))
        c = self.index.column(self.params.get("sfield", ""))
        return numeric.distance_km(c["lat"], c["lon"], lat, lon)

    # -------------------------------------------------------------- blocks

    def render(self, rows: list, fields: list[Field], score: bool, computed: dict[str, Column]) -> list[dict]:
        out = []
        for r in rows:
            doc = {}
            for f in fields:
                v = r[f.name]
                if v is None:
                    continue
                one = (lambda x: x["raw"]) if f.kind == "date_range" else (lambda x: x.astimezone(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z").replace(".000Z", "Z")) if f.kind == "date" else (lambda x: x["term"] if x["payload"] is None else f"{x['term']}|{x['payload']}") if f.kind == "payload" else (lambda x: x)
                values = [one(x) for x in v] if f.array else one(v)
                doc[f.name] = values if f.multi or not f.array else values[0] if len(values) == 1 else values
            for name in computed:
                if r[name] is not None:
                    doc[name] = r[name]
            if score:
                doc["score"] = r["_score"]
            out.append(doc)
        return out

    def run(self) -> dict:
        p = self.params
        start, rows = p.number("start", 0), min(p.number("rows", ordering.ROWS), ordering.ROWS_CAP)
        if start < 0 or rows < 0:
            raise RequestError("start and rows can't be negative")
        header = {"status": 0}
        out: dict = {} if p.flag("omitHeader") else {"responseHeader": header | ({"params": p.echo()} if p.get("echoParams") == "all" else {})}
        fl = ",".join(p.all("fl")) or None
        fields = stored(self.core.schema, self.index.docs.columns, fl)
        score = bool(fl) and any(n == "score" for n in fl.replace(" ", ",").split(","))
        computed = {part.split(":")[0].strip(): self.distance() for part in (fl or "").split(",") if part.strip().endswith(":geodist()")}
        seen = self.hits()
        if p.flag("group"):
            out["grouped"] = self.groups(seen, fields, score, computed, start, rows)
            if p.flag("group.truncate") and p.all("group.field"):
                f = self.fast(p.all("group.field")[0], "group")
                seen = grouping.truncated(seen, self.index.column(f.name), self.order(ordering.parse_sort(p.get("group.sort", p.get("sort", "")))))
            page = None
        else:
            total = seen.agg(F.count(F.lit(1)).alias("n"), F.max("_score").alias("m")).first()
            page = seen
            for name, c in computed.items():
                page = page.withColumn(name, c)
            keys = self.order(self.keys)
            page = ordering.page(page, keys[:-1], keys[-1], start, rows)
            found = page.select(*[F.col(f"`{f.name}`") for f in fields], *computed, "_score", F.col(f"`{self.core.schema.unique_key}`").alias("_key")).collect() if rows else []
            out["response"] = {"numFound": total["n"], "start": start} | ({"maxScore": total["m"]} if score and total["n"] else {}) | {"docs": self.render(found, fields, score, computed)}
        if p.flag("facet"):
            out["facet_counts"] = self.facet_counts(seen)
        if p.get("json.facet"):
            out["facets"] = self.json_facets(seen, json.loads(p.get("json.facet")))
        if p.flag("stats"):
            out["stats"] = {"stats_fields": self.stats(seen)}
        if p.flag("hl") and page is not None:
            out["highlighting"] = self.highlight(page)
        if p.flag("spellcheck") and (p.get("spellcheck.q") or p.get("q")):
            f = self.index.field(p.get("spellcheck.dictionary") if self.core.schema.find(p.get("spellcheck.dictionary", "")) else None)
            found = components.spellcheck(dictionary(self.index, f), p.get("spellcheck.q") or p.get("q"))
            out["spellcheck"] = {"suggestions": found, "collations": [components.collation(p.get("spellcheck.q") or p.get("q"), found)] if found else []}
        if self.warnings and "responseHeader" in out:
            out["responseHeader"] = {"warnings": self.warnings} | out["responseHeader"]
        return out

    def groups(self, seen: DataFrame, fields, score, computed, start: int, rows: int) -> dict:
        p, out = self.params, {}
        names = p.all("group.field")
        if not names:
            raise RequestError("group.field is missing")
        main = self.order(self.keys)
        within = self.order(ordering.parse_sort(p.get("group.sort"))) if p.get("group.sort") else main
        for name in names:
            f = self.fast(name, "group")
            if f.array:
                raise RequestError(f"can't group by {name}")
            c = self.index.column(name)
            total = grouping.totals(seen, c).first()
            some = seen
            for alias, d in computed.items():
                some = some.withColumn(alias, d)
            found = grouping.grouped(some, c, main, within, limit=p.number("group.limit", 1), offset=p.number("group.offset", 0), rows=rows, start=start)
            found = found.select(*[F.col(f"`{f.name}`") for f in fields], *computed, "_score", "_group", "group_rank", "group_size", "place").orderBy("group_rank", "place").collect()
            blocks: dict = {}
            for r in found:
                blocks.setdefault(r["group_rank"], []).append(r)
            shown = [{"groupValue": rs[0]["_group"], "doclist": {"numFound": rs[0]["group_size"], "start": p.number("group.offset", 0), "docs": self.render(rs, fields, score, computed)}} for _, rs in sorted(blocks.items())]
            out[name] = {"matches": total["matches"]} | ({"ngroups": total["ngroups"]} if p.flag("group.ngroups") else {}) | {"groups": shown}
        return out

    def facet_counts(self, seen: DataFrame) -> dict:
        p = self.params
        group = self.index.column(p.all("group.field")[0]) if p.flag("group") and p.flag("group.facet") and p.all("group.field") else None
        ranges = {}
        for text in p.all("facet.range"):
            local = parse_local(text)
            name = local.rest if local else text
            hits = self.hits(local.tags("ex")) if local and local.tags("ex") else seen
            f = self.core.schema.fields.get(name)
            if f is None or not f.fast or f.kind not in ("int", "float", "date") or f.array:
                raise RequestError(f"facet.range: no range facets over {name}")
            read = lambda k: p.for_field(name, f"facet.range.{k}", local.values if local else None)  # noqa: B023, E731
            if None in (read("start"), read("end"), read("gap")):
                raise RequestError("facet.range needs start, end and gap")
            if f.kind == "date":
                low, high, gap = dates.instant(read("start")), dates.instant(read("end")), facets.date_gap_ms(read("gap"))
                value = F.unix_millis(self.index.column(name))
            else:
                low, high, gap = float(read("start")), float(read("end")), float(read("gap"))
                value = self.index.column(name)
            _, end = facets.range_edges(low, high, gap)
            found = facets.ranges(hits, value, low, high, gap).orderBy("lower").collect()
            show = (lambda v: instant_text(int(v))) if f.kind == "date" else (lambda v: int(v) if f.kind == "int" else float(v))  # noqa: B023
            counts = [x for r in found for x in (str(show(r["lower"])), r["count"])]
            ranges[local.values.get("key", name) if local else name] = {"counts": counts, "gap": read("gap"), "start": show(low), "end": show(end)}
        plain = {}
        for text in p.all("facet.query"):
            local = parse_local(text)
            hits = self.hits(local.tags("ex")) if local and local.tags("ex") else seen
            match = compile_query(self.index, parse_any(text, self.index, p)).match
            plain[text] = facets.queries(hits, {text: match}).first()["count"] if group is None else hits.where(match).agg(facets.distinct_groups(group)).first()[0] or 0
        maps = {}
        for name in p.all("facet.heatmap"):
            f = self.core.schema.find(name)
            if f is None or f.kind != "location":
                raise RequestError(f"facet.heatmap: {name} is no location")
            level = p.number("facet.heatmap.gridLevel", facets.default_level(360, 180))
            cols, n_rows = facets.grid(level)
            if cols * n_rows > facets.CELL_CAP:
                raise RequestError("too many cells")
            c = self.index.column(name)
            cells = facets.heatmap(seen, c["lat"], c["lon"], level).collect()
            maps[name] = {"gridLevel": level, "columns": cols, "rows": n_rows, "minX": -180.0, "maxX": 180.0, "minY": -90.0, "maxY": 90.0, "counts_ints2D": facets.heatmap_grid(cells, n_rows, cols)}
        named: dict = {}
        for text in p.all("facet.field"):
            local = parse_local(text)
            name = local.rest if local else text
            label = local.values.get("key", name) if local else name
            if label in named:
                raise RequestError(f"facet.field: {label} is used twice")
            f = self.fast(name, "facet.field")
            hits = self.hits(local.tags("ex")) if local and local.tags("ex") else seen
            read = lambda k, d: p.for_field(name, f"facet.{k}", {f"facet.{a}": b for a, b in local.values.items()} if local else None) or d  # noqa: B023, E731
            if f.kind == "date_range":
                named[label] = []
                continue
            c = self.index.column(name)
            if f.kind not in ("string", "text") and int(read("mincount", "0")) <= 0:
                self.warnings.append(f"facet.mincount of {name} counts as 1: a field of numbers or dates has no list of terms")
            known = self.index.docs.select((F.explode(c) if f.array else c).alias("value")).where("value is not null") if f.kind in ("string", "text") else None
            limit = int(read("limit", "100"))
            found = facets.terms(hits, c, multi=f.array, dictionary=known, limit=limit, mincount=int(read("mincount", "0")), sort=p.for_field(name, "facet.sort") or ("count" if limit > 0 else "index"), distinct=group).collect()
            entries = [(instant_text(int(r["value"].timestamp() * 1000)) if f.kind == "date" else str(r["value"]), r["count"]) for r in found]
            if read("missing", "false") == "true":
                entries.append((None, hits.agg(facets.missing(c) if not f.array else F.count_if(c.isNull() | (F.size(c) == 0))).first()[0]))
            named[label] = named_list(entries, p.get("json.nl", "flat"))
        return {"facet_queries": plain, "facet_fields": named, "facet_ranges": ranges, "facet_intervals": {}, "facet_heatmaps": maps}

    def json_facets(self, seen: DataFrame, spec: dict) -> dict:
        """One job for the counts and maxima of each node of the request, however many buckets it has."""

        def best(label: str, s: str) -> Column:
            if not (s.startswith("max(") and s.endswith(")")):
                raise RequestError(f"json.facet: unknown aggregation {s}")
            name = s[4:-1].strip()
            if name == "_version_":
                return F.col("_version_")
            f = self.fast(name, "json.facet")
            if f.kind not in ("int", "float") or f.array:
                raise RequestError(f"json.facet: no maximum of {name}")
            return self.index.column(f.name)

        def level(depth: int, s: dict) -> tuple:
            for k in s:
                if k not in ("type", "field", "limit", "mincount", "sort", "facet"):
                    raise RequestError(f"json.facet: unknown key {k}")
            if s.get("type") != "terms" or "field" not in s:
                raise RequestError("json.facet: only terms facets")
            f = self.fast(s["field"], "json.facet")
            order = s.get("sort", "count desc")
            if order not in ("count desc", "index asc"):
                raise RequestError(f"json.facet: bad sort {order}")
            c = self.index.column(f.name)
            return f"level{depth}", c, s.get("limit", 10), order, max(1, s.get("mincount", 1)), f.array

        def parted(part: dict, depth: int) -> tuple[dict[str, Column], dict[str, tuple]]:
            maxima = {k: best(k, s) for k, s in part.items() if isinstance(s, str)}
            return maxima, {k: (s, level(depth, s)) for k, s in part.items() if not isinstance(s, str)}

        def walk(part: dict, path: list[tuple], parents: dict[tuple, dict]) -> None:
            _, below = parted(part, len(path))
            for label, (s, own) in below.items():
                maxima, _ = parted(s.get("facet", {}), len(path) + 1)
                for bucket in parents.values():
                    bucket[label] = {"buckets": []}
                levels = [*path, own]
                rows = facets.nested(seen, levels, {f"best_{i}": c for i, c in enumerate(maxima.values())}).where(F.col("depth") == len(path)).orderBy("rank").collect()
                found = {}
                for r in rows:
                    values = tuple(r[f"level{i}"] for i in range(len(levels)))
                    bucket = {"val": values[-1], "count": r["count"]} | {k: r[f"best_{i}"] for i, k in enumerate(maxima) if r[f"best_{i}"] is not None}
                    parents[values[:-1]][label]["buckets"].append(bucket)
                    found[values] = bucket
                if s.get("facet"):
                    walk(s["facet"], levels, found)

        maxima, _ = parted(spec, 0)
        row = seen.agg(F.count(F.lit(1)).alias("count"), *[F.max(c).alias(f"best_{i}") for i, c in enumerate(maxima.values())]).first()
        out = {"count": row["count"]} | {k: row[f"best_{i}"] for i, k in enumerate(maxima) if row[f"best_{i}"] is not None}
        walk(spec, [], {(): out})
        return out

    def stats(self, seen: DataFrame) -> dict:
        columns = {}
        for name in self.params.all("stats.field"):
            f = self.core.schema.fields.get(name)
            if name == "_version_":
                columns[name] = F.col("_version_")
            elif f is None or not f.fast or f.kind not in ("int", "float") or f.array:
                raise RequestError(f"stats: no statistics of {name}")
            else:
                columns[name] = self.index.column(name)
        if not columns:
            return {}
        return {r["field"]: {k: ("NaN" if k == "mean" and r[k] is None else r[k]) for k in stats.NAMES} for r in stats.field_stats(seen, columns).collect()}

    def highlight(self, page: DataFrame) -> dict:
        p, key = self.params, self.core.schema.unique_key
        names = (p.get("hl.fl") or self.params.get("df") or self.core.schema.default_field or "").replace(",", " ").split()
        out: dict = {str(r[0]): {} for r in page.select(key).collect()}
        for name in names:
            f = self.core.schema.find(name)
            if f is None or f.kind != "text" or not f.stored:
                raise RequestError(f"can't highlight {name}")
            only_own = p.get("hl.requireFieldMatch") == "true"
            terms = {t.term for n in ast.leaves(self.tree) if isinstance(n, (ast.Term, ast.Phrase)) and (not only_own or (n.field or self.core.schema.default_field) == name) for t in f.chain(n.text)}
            options = components.Highlight(frozenset(terms), p.number("hl.snippets", 1), p.number("hl.fragsize", 150), p.get("hl.simple.pre", "<em>"), p.get("hl.simple.post", "</em>"), p.get("hl.encoder") == "html")
            text = page.withColumn("_text", F.array_join(F.col(name), "\n") if f.array else F.col(name))
            for r in components.highlight_page(text, key, "_text", f.chain, options).collect():
                if r["snippets"]:
                    out[str(r["key"])][name] = r["snippets"]
        return out


def instant_text(ms: int) -> str:
    from datetime import datetime

    return datetime.fromtimestamp(ms / 1000, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z").replace(".000Z", "Z")


def named_list(entries: list[tuple], shape: str):
    """Names and values as a flat list, a map, or pairs."""
    match shape:
        case "map":
            return dict(entries)
        case "arrarr":
            return [list(e) for e in entries]
        case "arrmap":
            return [{k: v} for k, v in entries]
    return [x for e in entries for x in e]


def select(core: Core, params: Params | dict | str) -> dict:
    """The answer to a search request; refusals become an error block."""
    p = params if isinstance(params, Params) else Params.parse(params) if isinstance(params, str) else Params.of(params)
    try:
        return Search(core, p).run()
    except RequestError as e:
        return e.envelope({})
