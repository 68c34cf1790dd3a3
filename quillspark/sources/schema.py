"""Core schemas: fields, dynamic rules, copy rules, their checks, and coercion of JSON values."""

from __future__ import annotations

import hashlib
import json
import math
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..errors import RequestError
from ..functions import analysis, dates

KINDS = {"string": "string", "keyword": "string", "int": "int", "long": "int", "float": "float", "double": "float", "date": "date", "location": "location", "location_rpt": "location", "date_range": "date_range", "boost_term_payload": "payload"}
POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
SPAN = T.StructType([T.StructField("raw", T.StringType()), T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType())])
PAID = T.StructType([T.StructField("term", T.StringType()), T.StructField("payload", T.DoubleType())])
_TYPES = {"text": T.StringType(), "string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "date": T.TimestampType(), "location": POINT, "date_range": SPAN, "payload": PAID}


#: Changes whenever texts are cut into other terms than before, so that older tables are refused.
ANALYSIS = 1


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    stored: bool = True
    fast: bool = False
    multi: bool = False
    required: bool = False
    chain: analysis.Chain | None = None

    @property
    def tokens(self) -> str:
        return f"{self.name}__tokens"

    @property
    def array(self) -> bool:
        return self.multi or self.kind in ("date_range", "payload")

    @property
    def type(self) -> T.DataType:
        return T.ArrayType(_TYPES[self.kind]) if self.array else _TYPES[self.kind]


@dataclass
class Schema:
    name: str
    unique_key: str
    default_field: str | None
    fields: dict[str, Field]
    dynamic: list[tuple[str, Field]] = field(default_factory=list)
    copies: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def from_toml(cls, text: str) -> Schema:
        try:
            return cls.from_dict(tomllib.loads(text))
        except tomllib.TOMLDecodeError as e:
            raise RequestError(f"schema is not TOML: {e}") from None

    @classmethod
    def from_dict(cls, raw: dict) -> Schema:
        chains = dict(analysis.CHAINS)
        for t in raw.get("field_types", []):
            if t["name"] in KINDS or t["name"] in analysis.CHAINS:
                raise RequestError(f"field type {t['name']} is built in")
            if t["name"] in chains:
                raise RequestError(f"field type {t['name']} is given twice")
            if "query_filters" in t and "query_tokenizer" not in t:
                raise RequestError(f"field type {t['name']}: query_filters without query_tokenizer")
            chains[t["name"]] = analysis.custom_chain(t["name"], t.get("filters", ["lowercase"]), t.get("language", "en"))

        def made(spec: dict, name: str) -> Field:
            kind = KINDS.get(spec["type"])
            chain = analysis.CHAINS["payload"] if kind == "payload" else None
            if kind is None:
                if spec["type"] not in chains or spec["type"] in ("simple", "dynamic", "payload"):
                    raise RequestError(f"unknown field type {spec['type']}")
                kind, chain = "text", chains[spec["type"]]
            return Field(name, kind, spec.get("stored", False), spec.get("fast", False), spec.get("multi_valued", False), spec.get("required", False), chain)

        core, fields = raw.get("core", raw), {}
        for spec in raw.get("fields", []):
            if spec["name"] in fields:
                raise RequestError(f"field {spec['name']} is given twice")
            if spec["name"] == "_version_" or (raw.get("dynamic_fields") and spec["name"] in ("_dynamic", "_dynamic_text")):
                raise RequestError(f"field name {spec['name']} is reserved")
            fields[spec["name"]] = made(spec, spec["name"])
        rules = []
        for spec in raw.get("dynamic_fields", []):
            pattern = spec["pattern"]
            if pattern.count("*") != 1 or not (pattern.startswith("*") or pattern.endswith("*")):
                raise RequestError(f"bad pattern {pattern}")
            if pattern in (p for p, _ in rules):
                raise RequestError(f"pattern {pattern} is given twice")
            rules.append((pattern, made(spec, pattern)))
        copies = [(c["source"], c["dest"]) for c in raw.get("copy_fields", [])]
        for c in copies:
            for name in c:
                if name not in fields:
                    raise RequestError(f"copy rule names the undeclared field {name}")
        key, default = core.get("unique_key"), core.get("default_field")
        own = fields.get(key)
        if own is None or own.kind != "string" or own.multi or not own.required:
            raise RequestError("unique_key must be a declared, required, single-valued string field")
        if default is not None and default not in fields:
            raise RequestError(f"default field {default} is not declared")
        return cls(core.get("name", "core"), key, default, fields, rules, copies)

    def find(self, name: str) -> Field | None:
        """The declared field, else one by the longest dynamic pattern that fits, the later of equals."""
        if name in self.fields:
            return self.fields[name]
        best = None
        for pattern, rule in self.dynamic:
            if (name.endswith(pattern[1:]) if pattern.startswith("*") else name.startswith(pattern[:-1])) and (best is None or len(pattern) >= len(best[0])):
                best = pattern, rule
        return None if best is None else Field(name, best[1].kind, best[1].stored, best[1].fast, best[1].multi, False, best[1].chain)

    def fingerprint(self) -> str:
        """Changes with anything that makes stored tables unfit."""
        parts = [[f.name, f.kind, f.multi, f.fast, f.stored, f.chain.name if f.chain else None] for f in self.fields.values()]
        rules = [[p, f.kind, f.multi, f.fast, f.stored, f.chain.name if f.chain else None] for p, f in self.dynamic]
        return hashlib.sha256(json.dumps([ANALYSIS, self.unique_key, sorted(parts), rules, sorted(self.copies)]).encode()).hexdigest()


def coerce(f: Field, value):
    """A JSON value as the field stores it."""
    bad = RequestError(f"field {f.name}: {value!r} is no {f.kind}")
    if f.kind in ("text", "string"):
        if not isinstance(value, str):
            raise bad
        return value
    if f.kind == "int":
        if not isinstance(value, int) or isinstance(value, bool):
            raise bad
        return value
    if f.kind == "float":
        if not isinstance(value, (int, float)) or isinstance(value, bool) or not math.isfinite(value):
            raise bad
        return float(value)
    if not isinstance(value, str):
        raise bad
    if f.kind == "date":
        from datetime import UTC, datetime, timedelta

        return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=dates.instant(value))
    if f.kind == "location":
        from ..functions.numeric import parse_point

        return parse_point(value)
    if f.kind == "date_range":
        return (value, *dates.interval(value))
    return analysis.payload_of(value)


def build(schema: Schema, doc: dict) -> dict:
    """A JSON object as a row: required fields, copies, cardinality and types checked, dynamic names resolved."""
    if not isinstance(doc, dict):
        raise RequestError("a document must be an object")
    for f in schema.fields.values():
        if f.required and f.name not in doc:
            raise RequestError(f"required field {f.name} is missing")
    values: dict[str, list] = {}
    for name, raw in doc.items():
        f = schema.find(name)
        if f is None:
            raise RequestError(f"unknown field {name}")
        some = raw if isinstance(raw, list) else [raw]
        if name in schema.fields:
            some = [v for v in some if v is not None]
        values.setdefault(name, []).extend(coerce(f, v) for v in some)
    for source, dest in schema.copies:
        raw = doc.get(source)
        some = [v for v in (raw if isinstance(raw, list) else [raw]) if v is not None]
        values.setdefault(dest, []).extend(coerce(schema.fields[dest], v) for v in some)
    row = {}
    for name, some in values.items():
        f = schema.find(name)
        if not f.array and len(some) > 1:
            raise RequestError(f"field {name} takes one value")
        if some:
            row[name] = some if f.array else some[0]
    return row
