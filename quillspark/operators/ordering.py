"""Sort specifications, missing values, ties and pages."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RequestError

ROWS, ROWS_CAP = 10, 10_000


@dataclass(frozen=True)
class Key:
    name: str
    descending: bool


def parse_sort(text: str) -> list[Key]:
    """``key dir[, key dir]``; the direction is looked at before the key."""
    out, at = [], 0
    if not text.strip():
        return out
    for part in re.split(r",(?![^()]*\))", text):
        found = re.fullmatch(r"\s*(\S+(?:\s*\([^)]*\))?)\s+(\S+)\s*", part)
        if not found:
            raise RequestError("a sort key needs a direction", at)
        if found[2].lower() not in ("asc", "desc"):
            raise RequestError(f"bad sort direction {found[2]}", at + found.start(2))
        out.append(Key(found[1], found[2].lower() == "desc"))
        at += len(part) + 1
    return out


def text_key(value: Column, descending: bool, multi: bool = False) -> Column:
    """Strings: without a value last in both directions; arrays go by their least value upwards, greatest downwards."""
    if multi:
        value = F.array_max(value) if descending else F.array_min(value)
    return value.desc_nulls_last() if descending else value.asc_nulls_last()


def number_key(value: Column, descending: bool, multi: bool = False) -> Column:
    """Numbers and dates: without a value as 0."""
    if multi:
        value = F.array_max(value) if descending else F.array_min(value)
    value = F.coalesce(value, F.lit(0))
    return value.desc() if descending else value.asc()


def function_key(value: Column, descending: bool) -> Column:
    return value.desc_nulls_last() if descending else value.asc_nulls_last()


def page(hits: DataFrame, keys: list[Column], tie: Column, start: int = 0, rows: int = ROWS) -> DataFrame:
    """The rows from ``start`` on, in the order of the keys, then of ``tie``; only start + rows of each task move."""
    rows = min(rows, ROWS_CAP)
    top = hits.orderBy(*keys, tie).limit(start + rows)
    return top.offset(start) if start else top
