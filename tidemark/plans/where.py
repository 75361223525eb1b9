"""The filter language: ``field<op>value`` expressions, joined by AND, as a DataFrame filter."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import casefold

FIELDS = ("city", "country", "event", "person", "year")
_EXPRESSION = re.compile(r"^\s*([A-Za-z_]+)\s*(>=|<=|!=|=|>|<)\s*(.+?)\s*$")
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "!=": lambda a, b: a != b, "=": lambda a, b: a == b, ">": lambda a, b: a > b, "<": lambda a, b: a < b,
}


@dataclass(frozen=True)
class Term:
    field: str
    op: str
    value: str


def parse(expressions: list[str]) -> list[Term]:
    """Terms, or ValueError naming what is wrong."""
    out = []
    for e in expressions:
        m = _EXPRESSION.match(e)
        if not m:
            raise ValueError(f"not a filter: {e!r} (field<op>value; fields: {', '.join(FIELDS)})")
        name, op, value = m[1].lower(), m[2], m[3]
        if name not in FIELDS:
            raise ValueError(f"unknown field {m[1]!r} (fields: {', '.join(FIELDS)})")
        if name == "year":
            if not re.fullmatch(r"[+-]?\d+", value):
                raise ValueError(f"year takes a whole number, not {value!r}")
        elif op != "=":
            raise ValueError(f"{name} only takes =, not {op}")
        out.append(Term(name, op, value))
    return out


@dataclass
class Names:
    """How values bind: names of countries and cities in the user's language, and the tables behind person and event."""

    country_codes: DataFrame | None = None  # (folded, cc), see nearest.country_codes
    city_names: DataFrame | None = None  # (folded, geonameid), see nearest.city_names
    persons: DataFrame | None = None  # (file_id, label)
    events: DataFrame | None = None  # (file_id, name)


def apply(df: DataFrame, expressions: list[str], names: Names | None = None, id_col: str = "id") -> DataFrame:
    """The rows that satisfy every expression; none given, all rows. A null year satisfies nothing."""
    names = names or Names()
    for t in parse(expressions):
        folded = F.lit(t.value.casefold())
        if t.field == "year":
            df = df.where(_COMPARE[t.op](F.year("taken_at"), F.lit(int(t.value))))
        elif t.field == "country":
            named = names.country_codes.where(F.col("folded") == folded).first() if names.country_codes is not None else None
            df = df.where(casefold(F.col("country")) == F.lit((named.cc if named else t.value).casefold()))
        elif t.field == "city":
            same = casefold(F.col("city")) == folded
            if names.city_names is None:
                df = df.where(same)
                continue
            # A mark for each city of that name: homonyms are joined, not listed.
            hit = names.city_names.where(F.col("folded") == folded).select(F.col("geonameid").alias("city_geonameid"), F.lit(True).alias("_hit")).distinct()
            df = df.join(hit, "city_geonameid", "left").where(F.col("_hit") | same).drop("_hit").select(*df.columns)
        else:
            side, key = (names.persons, "label") if t.field == "person" else (names.events, "name")
            if side is None:
                df = df.where(F.lit(False))
                continue
            hit = side.where(F.col(key) == t.value) if t.field == "person" else side.where(casefold(F.col(key)) == folded)
            df = df.join(hit.select(F.col("file_id").alias(id_col)), id_col, "left_semi")
    return df
