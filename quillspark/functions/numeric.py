"""Function queries over documents, and distances on the sphere, as column expressions."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import RequestError

EARTH_KM = 6371.0087714
KM_PER_DEGREE = EARTH_KM * math.pi / 180


@dataclass(frozen=True)
class Call:
    """A number, a field or a call."""

    kind: str
    value: float | str = 0.0
    args: tuple[Call, ...] = ()


class _Parser:
    NAMES = ("sum", "product", "max", "min", "recip")

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def fail(self, why: str) -> RequestError:
        return RequestError(f"bad function {self.text!r}: {why}", self.at)

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def one(self) -> Call:
        self.space()
        found = re.compile(r"\d+\.?\d*(?:[eE][+-]?\d+)?|-\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+").match(self.text, self.at)
        if found:
            self.at = found.end()
            return Call("number", float(found[0]))
        found = re.compile(r"[A-Za-z_][\w.]*").match(self.text, self.at)
        if not found:
            raise self.fail("a number, field or function is missing")
        self.at = found.end()
        self.space()
        if self.at < len(self.text) and self.text[self.at] == "(":
            if found[0] not in self.NAMES:
                raise self.fail(f"unknown function {found[0]}")
            self.at += 1
            args: list[Call] = []
            self.space()
            while self.at < len(self.text) and self.text[self.at] != ")":
                args.append(self.one())
                self.space()
                if self.at < len(self.text) and self.text[self.at] == ",":
                    self.at += 1
                elif self.at >= len(self.text) or self.text[self.at] != ")":
                    raise self.fail("comma or bracket is missing")
            if self.at >= len(self.text):
                raise self.fail("bracket not closed")
            self.at += 1
            if found[0] == "recip" and len(args) != 4:
                raise self.fail("recip takes four arguments")
            return Call(found[0], args=tuple(args))
        return Call("field", found[0])


def parse_function(text: str) -> Call:
    parser = _Parser(text)
    call = parser.one()
    parser.space()
    if parser.at < len(text):
        raise parser.fail("text after the function")
    return call


def fields_of(call: Call) -> set[str]:
    return {call.value} if call.kind == "field" else set().union(*(fields_of(a) for a in call.args)) if call.args else set()


def value(call: Call, column: Callable[[str], Column]) -> Column:
    """The function's value; a missing field is 0, as are the sums of nothing; ``column`` gives a field as a number."""
    if call.kind == "number":
        return F.lit(float(call.value))
    if call.kind == "field":
        return F.coalesce(column(call.value).cast("double"), F.lit(0.0))
    args = [value(a, column) for a in call.args]
    if call.kind == "sum":
        return sum(args, F.lit(0.0))
    if call.kind == "product":
        out = F.lit(1.0)
        for a in args:
            out = out * a
        return out
    if call.kind in ("max", "min"):
        if not args:
            return F.lit(-math.inf if call.kind == "max" else math.inf)
        return args[0] if len(args) == 1 else (F.greatest if call.kind == "max" else F.least)(*args)
    x, m, a, b = args
    below = m * x + b
    return F.when(below != 0, F.try_divide(a, below)).when(a == 0, F.lit(math.nan)).otherwise(F.when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf)))


def exists(call: Call, column: Callable[[str], Column]) -> Column:
    """A field exists where it has a value; a number always; max and min where any argument does, the rest where all do."""
    if call.kind == "number":
        return F.lit(True)
    if call.kind == "field":
        return column(call.value).isNotNull()
    parts = [exists(a, column) for a in call.args]
    if not parts:
        return F.lit(True)
    out = parts[0]
    for p in parts[1:]:
        out = (out | p) if call.kind in ("max", "min") else (out & p)
    return out


def distance_km(lat: Column, lon: Column, to_lat: float, to_lon: float) -> Column:
    """Great-circle distance to a point by the haversine formula; null without a point."""
    half_lat = F.sin((F.radians(lat) - math.radians(to_lat)) / 2)
    half_lon = F.sin((F.radians(lon) - math.radians(to_lon)) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat)) * math.cos(math.radians(to_lat)) * half_lon * half_lon
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def in_circle(lat: Column, lon: Column, to_lat: float, to_lon: float, km: float) -> Column:
    """Within ``km``; a box on the plain coordinates comes first, so that files and row groups can be skipped."""
    return in_box(lat, lon, to_lat, to_lon, km) & (distance_km(lat, lon, to_lat, to_lon) <= km)


def in_box(lat: Column, lon: Column, to_lat: float, to_lon: float, km: float) -> Column:
    tall = km / KM_PER_DEGREE
    narrow = math.cos(math.radians(to_lat))
    wide = 360.0 if narrow < 1e-9 else km / (KM_PER_DEGREE * narrow)
    inside = lat.between(to_lat - tall, to_lat + tall)
    return inside if wide >= 180 else inside & lon.between(to_lon - wide, to_lon + wide)


def parse_point(text: str) -> tuple[float, float]:
    found = re.fullmatch(r"\s*(-?\d+(?:\.\d*)?)\s*,\s*(-?\d+(?:\.\d*)?)\s*", text or "")
    if not found or abs(float(found[1])) > 90 or abs(float(found[2])) > 180:
        raise RequestError(f"bad point: {text}")
    return float(found[1]), float(found[2])
