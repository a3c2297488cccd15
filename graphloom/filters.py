"""The filter micro-language: key{!=,>=,<=,>,<,~,^=,^,=}value, joined by commas."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import ValidationError, WrongType
from .schema import SPARK_TYPES, Prop, ident, property_text, typed

_TOKEN = re.compile(r"\s*([^!<>=~^\s]+)\s*(!=|>=|<=|\^=|[<>=~^])(.*)", re.S)
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


def parse(*texts: str) -> list[tuple[str, str, str]]:
    """(key, operator, value) of each part; the earliest operator counts, the longest there."""
    out = []
    for text in texts:
        for part in text.split(","):
            if not part.strip():
                continue
            if not (m := _TOKEN.fullmatch(part)):
                raise ValidationError(f"no filter: {part!r}")
            out.append((ident(m[1]), "^" if m[2] == "^=" else m[2], m[3].strip()))
    return out


_NUMBER = re.compile(r"[-+]?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?")


def literal(text: str):
    """null, integer, float, truth value, else text (also for 1_000, inf and nan)."""
    if text in ("null", "true", "false"):
        return {"null": None, "true": True, "false": False}[text]
    if not (m := _NUMBER.fullmatch(text)):
        return text
    return float(text) if m[1] or m[2] else int(text)


def typed_value(text: str, prop: Prop | None):
    """A value as its declared type; text that is none raises WrongType, a key without a declaration is a literal."""
    if text == "null":
        return None
    if prop is None:
        return literal(text)
    if SPARK_TYPES[prop.type] == "string" or prop.type == "timestamp":
        return text
    value = literal(text)
    fits = {"int": isinstance(value, int) and not isinstance(value, bool), "float": isinstance(value, int | float) and not isinstance(value, bool), "bool": isinstance(value, bool)}[prop.type]
    if not fits:
        raise WrongType(f"{text!r} is not {prop}")
    return float(value) if prop.type == "float" else value


def pairs(args: list[str], props: dict[str, Prop] | None = None) -> dict[str, object]:
    """key=value arguments, cut at the first =, as values of the declared types (null: None); those without = are left
    out."""
    return {k: typed_value(v, (props or {}).get(k)) for k, sep, v in (a.partition("=") for a in args) if sep}


def condition(key: str, op: str, value: str, props: dict[str, Prop], columns: Collection[str] = ()) -> Column:
    """A filter as a column: numbers, times and truth values compare by type, all else as text. A lacking key is null,
    so no operator selects it. % and _ in a value stand for any text, as in ILIKE. ``columns``: properties that are columns
    of their own (``Graph.table``), so that the filter reaches the files."""
    prop = props.get(key)
    is_text = prop is not None and SPARK_TYPES[prop.type] == "string"
    text = F.col(key) if key in columns and is_text else property_text(key)
    if op in "~^":
        return text.ilike(("%" if op == "~" else "") + value.replace("\\", "\\\\") + "%")
    if prop and not is_text:
        return _COMPARE[op](F.col(key) if key in columns else typed(key, prop), _constant(value, prop))
    return _COMPARE[op](text, F.lit(value))


def _constant(value: str, prop: Prop) -> Column:
    """The value as a constant of the property's type; null if it is none, which no row equals."""
    return F.lit(value).try_cast(SPARK_TYPES[prop.type])


def conjunction(texts: tuple[str, ...] | list[str], props: dict[str, Prop], columns: Collection[str] = ()) -> Column:
    """All filters together."""
    return functools.reduce(lambda a, b: a & b, [condition(*f, props, columns) for f in parse(*texts)], F.lit(True))


def either(*conditions: Column) -> Column:
    """At least one holds; without any, none does."""
    return functools.reduce(lambda a, b: a | b, conditions, F.lit(False))


def lacking(key: str) -> Column:
    """The property is not there, or null."""
    return property_text(key).isNull()
