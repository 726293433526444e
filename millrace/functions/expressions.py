"""The filter and projection language, compiled to columns.

A text is parsed once, when a pipeline is compiled. A filter becomes a condition and
an error text, both columns: a row whose error is not null can't be judged and goes
to the dead letters with that text. On typed payloads a null field counts as missing.

    filter     := true | false | exists(path) | path op literal
    op         := == | != | > | >= | < | <=
    literal    := true | false | number | text, bare or in quotes, without spaces
    projection := * | selector, ...      selector := path | path as alias
    path       := name.name...
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The texts of failure reasons.
NOT_NUMERIC = "aggregate operators require a numeric payload or payload.value field"
UNSUPPORTED_FILTER = "unsupported filter expression: {}"
UNSUPPORTED_OPERATOR = "unsupported filter operator: {}"
UNSUPPORTED_SELECTOR = "unsupported projection selector: {}"
MISSING_FIELD = "missing field {}"
MISSING_ENRICHMENT_KEY = "missing enrichment key field {}"
MISSING_JOIN_KEY = "join key field {} missing"
EMPTY_UPSTREAM = "{} operators received an empty upstream batch"

_COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|inf(?:inity)?|nan)", re.I)


def parse_literal(text: str) -> bool | float | str | None:
    """A boolean, a double, else a string without outer quotes; what is not a finite number is null."""
    if text in ("true", "false"):
        return text == "true"
    if _NUMBER.fullmatch(text):
        x = float(text)
        return x if math.isfinite(x) else None
    return text.strip('"').strip("'")


def at_path(payload: Column, kind: T.DataType, path: str) -> tuple[Column, T.DataType] | None:
    """The column and type at a dotted path of a struct, or None if the type has no such field."""
    here, at = payload, kind
    for name in path.split("."):
        if not isinstance(at, T.StructType) or name not in at.fieldNames():
            return None
        here, at = here.getField(name), at[name].dataType
    return here, at


def numeric(value: Column, kind: T.DataType) -> Column | None:
    """The double that a value stands for: itself, or its field `value`. None if its type has none."""
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    if isinstance(kind, T.StructType):
        inner = at_path(value, kind, "value")
        if inner and isinstance(inner[1], T.NumericType):
            return inner[0].cast("double")
    return None


@dataclass(frozen=True)
class Condition:
    """A condition, the reason why a row can't be judged, and the field that has to be there."""

    holds: Column
    error: Column
    field: Column | None = None

    @property
    def wanted(self) -> Column:
        """True or false for every row; only true where the row can be judged."""
        return F.coalesce(self.plain, F.lit(False))

    @property
    def plain(self) -> Column:
        """For a filter without dead letters, in a form that reaches the scan."""
        return self.holds if self.field is None else self.field.isNotNull() & self.holds


def no_error() -> Column:
    return F.lit(None).cast("string")


def _fails(reason: str) -> Condition:
    return Condition(F.lit(False), F.lit(reason))


def compile_filter(text: str, payload: Column, kind: T.DataType, *, strict: bool = False) -> Condition:
    """`strict` keeps apart whole and decimal numbers: a whole-number field never equals a number literal."""
    text = text.strip()
    if text.lower() in ("true", "false"):
        return Condition(F.lit(text.lower() == "true"), no_error())
    if text.startswith("exists(") and text.endswith(")"):
        found = at_path(payload, kind, text[7:-1].strip())
        return Condition(found[0].isNotNull() if found else F.lit(False), no_error())
    parts = text.split()
    if len(parts) != 3:
        return _fails(UNSUPPORTED_FILTER.format(text))
    path, op, literal = parts[0], parts[1], parse_literal(parts[2])
    found = at_path(payload, kind, path)
    missing = MISSING_FIELD.format(path)
    if found is None:
        return _fails(missing)
    value, at = found
    error = F.when(value.isNull(), F.lit(missing))
    if op in ("==", "!="):
        same = _equal(value, at, literal, strict)
        return Condition(same if op == "==" else ~same, error, value)
    if op not in _COMPARE:
        return Condition(F.lit(False), error.otherwise(F.lit(UNSUPPORTED_OPERATOR.format(op))))
    number = numeric(value, at)
    if number is None or isinstance(literal, (bool, str)) or literal is None:
        return Condition(F.lit(False), error.otherwise(F.lit(NOT_NUMERIC)))
    return Condition(_COMPARE[op](number, F.lit(literal)), error.when(number.isNull(), F.lit(NOT_NUMERIC)))


def _equal(value: Column, kind: T.DataType, literal: bool | float | str | None, strict: bool) -> Column:
    if isinstance(literal, bool):
        return value == F.lit(literal) if isinstance(kind, T.BooleanType) else F.lit(False)
    if isinstance(literal, float):
        if not isinstance(kind, T.NumericType) or strict and isinstance(kind, T.IntegralType):
            return F.lit(False)
        return value == F.lit(int(literal) if literal.is_integer() and isinstance(kind, T.IntegralType) and abs(literal) < 2**63 else literal)
    if isinstance(literal, str) and isinstance(kind, T.StringType):
        return value == F.lit(literal)
    return F.lit(False)


def parse_projection(text: str) -> list[tuple[str, str]] | str | None:
    """(path, name) pairs in order, None for everything, or the reason why the text is not understood."""
    text = text.strip()
    if text == "*":
        return None
    out: list[tuple[str, str]] = []
    for selector in filter(None, map(str.strip, text.split(","))):
        words = selector.split()
        if len(words) == 1:
            out.append((words[0], words[0]))
        elif len(words) == 3 and words[1] == "as":
            out.append((words[0], words[2]))
        else:
            return UNSUPPORTED_SELECTOR.format(selector)
    return out


def compile_projection(text: str, payload: Column, kind: T.DataType) -> tuple[Column, Column]:
    """The projected struct and the error column. Fields that the type lacks are left out; a later selector of a name wins."""
    parsed = parse_projection(text)
    if parsed is None:
        return payload, no_error()
    if isinstance(parsed, str):
        return payload, F.lit(parsed)
    fields: dict[str, Column] = {}
    for path, name in parsed:
        if found := at_path(payload, kind, path):
            fields.pop(name, None)
            fields[name] = found[0].alias(name)
    return (F.struct(*fields.values()) if fields else F.struct(F.lit(None).cast("string").alias("_"))), no_error()
