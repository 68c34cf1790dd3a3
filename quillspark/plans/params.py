"""Request parameters: decoding, booleans, per-field keys and local parameter blocks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..errors import RequestError


def _decode(text: str) -> str:
    raw, out, i = text.replace("+", " ").encode(), bytearray(), 0
    while i < len(raw):
        hexes = raw[i + 1 : i + 3]
        if raw[i : i + 1] == b"%" and re.fullmatch(rb"[0-9A-Fa-f]{2}", hexes):
            out.append(int(hexes, 16))
            i += 3
        else:  # a bad escape is literal
            out.append(raw[i])
            i += 1
    return out.decode("utf-8", "replace")


def parse_bool(text: str) -> bool:
    low = text.lower()
    if low.startswith(("true", "on", "yes")):
        return True
    if low.startswith(("false", "off")) or low == "no":
        return False
    raise RequestError(f"invalid boolean value: {text}")


@dataclass
class Params:
    """Ordered (name, value) pairs; ``get`` gives the first value."""

    pairs: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def parse(cls, query: str, form: str = "") -> Params:
        found = []
        for part in (p for text in (query, form) for p in text.split("&") if p):
            name, _, value = part.partition("=")
            found.append((_decode(name), _decode(value)))
        return cls(found)

    @classmethod
    def of(cls, values: dict | list) -> Params:
        pairs = []
        for name, value in values.items() if isinstance(values, dict) else values:
            for one in value if isinstance(value, (list, tuple)) else [value]:
                pairs.append((name, str(one).lower() if isinstance(one, bool) else str(one)))
        return cls(pairs)

    def get(self, name: str, default: str | None = None) -> str | None:
        return next((v for n, v in self.pairs if n == name), default)

    def all(self, name: str) -> list[str]:
        return [v for n, v in self.pairs if n == name]

    def flag(self, name: str, default: bool = False) -> bool:
        value = self.get(name)
        return default if value is None else parse_bool(value)

    def number(self, name: str, default: int) -> int:
        value = self.get(name)
        if value is None:
            return default
        try:
            return int(value)
        except ValueError:
            raise RequestError(f"{name}: not a number: {value}") from None

    def for_field(self, name: str, key: str, local: dict[str, str] | None = None) -> str | None:
        """``f.<field>.key``, then the local parameter, then the global one."""
        own = self.get(f"f.{name}.{key}")
        if own is not None:
            return own
        if local and key in local:
            return local[key]
        return self.get(key)

    def unknown(self, allowed: set[str]) -> list[str]:
        return [n for n, _ in self.pairs if n not in allowed and not re.match(r"f\..+\.(facet|hl)\.", n)]

    def echo(self) -> dict:
        out: dict = {}
        for name, value in self.pairs:
            if name in out:
                out[name] = [*(out[name] if isinstance(out[name], list) else [out[name]]), value]
            else:
                out[name] = value
        return out


@dataclass(frozen=True)
class Local:
    """A block ``{!type k=v k='v v'}`` and the text after it."""

    kind: str | None
    values: dict[str, str]
    rest: str

    def tags(self, name: str) -> set[str]:
        return {t.strip() for t in self.values.get(name, "").split(",") if t.strip()}


def parse_local(text: str) -> Local | None:
    """The block at the start of ``text``; an unterminated one is none."""
    if not text.startswith("{!"):
        return None
    at, kind, values = 2, None, {}
    while True:
        while at < len(text) and text[at] == " ":
            at += 1
        if at >= len(text):
            return None
        if text[at] == "}":
            return Local(kind, values, text[at + 1 :])
        found = re.compile(r"[^\s=}]+").match(text, at)
        if not found:
            return None
        name, at = found[0], found.end()
        if at < len(text) and text[at] == "=":
            at += 1
            if at < len(text) and text[at] in "'\"":
                quote, out = text[at], []
                at += 1
                while at < len(text) and text[at] != quote:
                    if text[at] == "\\" and at + 1 < len(text):
                        at += 1
                    out.append(text[at])
                    at += 1
                if at >= len(text):
                    return None
                at += 1
                value = "".join(out)
            else:
                found = re.compile(r"[^\s}]*").match(text, at)
                value, at = found[0], found.end()
            values.setdefault(name, value)
        elif kind is None and not values:
            kind = name
        else:
            values.setdefault(name, "")


def strip_inert(text: str) -> tuple[str, set[str]]:
    """Text without its type-less blocks, and their tags."""
    local = parse_local(text)
    if local is not None and local.kind is None:
        return local.rest, local.tags("tag")
    return text, local.tags("tag") if local else set()
