"""Scalar expressions as two texts of Spark SQL: a value that never raises, and a fault.

The dialect evaluates eagerly: a fault in an operand is not hidden by NULL, AND, OR or IS NULL around it. Spark
may skip operands, so a fault is data: NULL, or a small code, and that of an expression is the first of its
operands' and its own. Expressions that cannot fail have no fault column and cost nothing more than plain Spark.

Text, because Spark's parser reads a whole query at once, and a call for each node of an expression takes longer than
many a query.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from veltra.plans.binding import Expr
from veltra.types import INT64_MIN, Type

#: What a fault means.
FAULTS = {1: "INT64 overflow", 2: "division by zero", 3: "DOUBLE result is not finite", 4: "negation overflow", 5: "SUM out of INT64 range"}

SQL_TYPES = {Type.INT64: "BIGINT", Type.DOUBLE: "DOUBLE", Type.BOOL: "BOOLEAN", Type.STRING: "STRING"}
_TRY = {"+": "try_add", "-": "try_subtract", "*": "try_multiply"}
_PLAIN_TEXT = re.compile(r"[A-Za-z0-9 _.,:-]*").fullmatch


@dataclass
class Lane:
    value: str
    fault: str | None = None


def first_fault(*faults: str | None) -> str | None:
    some = [f for f in faults if f is not None]
    return None if not some else some[0] if len(some) == 1 else f"coalesce({', '.join(some)})"


def finite(x: str) -> str:
    return f"(NOT isnan({x}) AND abs({x}) != DOUBLE('Infinity'))"


def literal(value: object, kind: Type | None) -> str:
    match value:
        case None:
            return f"CAST(NULL AS {SQL_TYPES[kind or Type.BOOL]})"
        case bool():
            return str(value).upper()
        case int():
            return f"{value}L" if value >= 0 else f"CAST('{value}' AS BIGINT)"
        case float():
            return f"DOUBLE('{value!r}')"
    return f"'{value}'" if _PLAIN_TEXT(value) else f"decode(X'{value.encode().hex()}', 'UTF-8')"


def lower(e: Expr, column: Callable[[int], str], aggregate: Callable[[int], str] | None = None) -> Lane:
    """The lanes of ``e``; ``column`` and ``aggregate`` give the names of inputs and the values of finished aggregates."""
    if e.kind == "literal":
        return Lane(literal(e.value, e.type))
    if e.kind == "column":
        return Lane(column(e.index))
    if e.kind == "aggregate":
        return Lane(aggregate(e.index))
    lanes = [lower(a, column, aggregate) for a in e.args]
    below = first_fault(*(x.fault for x in lanes))
    values = [x.value for x in lanes]
    if e.kind == "isnull":
        return Lane(f"({values[0]} {e.op.upper()})", below)
    if e.kind == "cast":
        return Lane(f"CAST({values[0]} AS {SQL_TYPES[e.type]})", below)
    if e.kind == "unary":
        return Lane(f"(NOT {values[0]})", below) if e.op == "not" else _negated(e, values[0], below)
    if e.type is Type.BOOL:
        return Lane(f"({values[0]} {e.op.upper()} {values[1]})", below)
    return _arithmetic(e, *values, below)


def _negated(e: Expr, x: str, below: str | None) -> Lane:
    if e.type is Type.DOUBLE or not e.may_fail:
        return Lane(f"(-{x})", below)
    least = f"({x} = {literal(INT64_MIN, Type.INT64)})"
    return Lane(f"CASE WHEN NOT {least} THEN -{x} END", first_fault(below, f"CASE WHEN {least} THEN 4 END"))


def _arithmetic(e: Expr, a: str, b: str, below: str | None) -> Lane:
    if e.op == "/":
        x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
        raw = f"try_divide({x}, {y})"
        fault = f"CASE WHEN {x} IS NOT NULL AND {y} = 0D THEN 2 WHEN {raw} IS NOT NULL AND NOT {finite(raw)} THEN 3 END"
        return Lane(f"CASE WHEN {finite(raw)} THEN {raw} END", first_fault(below, fault))
    if e.type is Type.DOUBLE:
        raw = f"({a} {e.op} {b})"
        return Lane(f"CASE WHEN {finite(raw)} THEN {raw} END", first_fault(below, f"CASE WHEN {raw} IS NOT NULL AND NOT {finite(raw)} THEN 3 END"))
    raw = f"{_TRY[e.op]}({a}, {b})"
    return Lane(raw, first_fault(below, f"CASE WHEN {raw} IS NULL AND {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END"))
