"""COUNT, SUM, AVG, MIN and MAX with exact integer sums. DOUBLE sums in input order are folded elsewhere."""

from __future__ import annotations

from veltra.functions.lanes import Lane, finite
from veltra.plans.binding import Expr
from veltra.types import INT64_MAX, INT64_MIN, Type

#: Bits at which a LONG is cut for exact sums.
HIGH, LOW = 43, 22


def width(e: Expr) -> int:
    """How many partial results an aggregate has."""
    if e.op in ("count", "min", "max"):
        return 1
    return (3 if e.args[0].type is Type.INT64 else 1) + (e.op == "avg")


def adds_doubles(e: Expr) -> bool:
    return e.op in ("sum", "avg") and e.args[0].type is Type.DOUBLE


def partials(e: Expr, value: str | None) -> list[str]:
    """The Spark aggregates behind one aggregate."""
    if e.op == "count":
        return [f"count({value or 1})"]
    if e.op in ("min", "max"):
        return [f"{e.op}({value})"]
    if adds_doubles(e):
        sums = [f"sum({value})"]
    else:  # three sums of LONG parts: exact for 2**41 rows, and much faster than sums of wide decimals
        sums = [f"sum(shiftright({value}, {HIGH}))", f"sum(shiftright({value}, {LOW}) & {(1 << (HIGH - LOW)) - 1}L)", f"sum({value} & {(1 << LOW) - 1}L)"]
    return sums if e.op == "sum" else [*sums, f"count({value})"]


def finished(e: Expr, parts: list[str]) -> Lane:
    """The aggregate's value and fault from its partial results."""
    if e.op in ("count", "min", "max"):
        return Lane(parts[0])
    total = parts[0]
    if e.args[0].type is Type.DOUBLE:
        bad = f"({total} IS NOT NULL AND NOT {finite(total)})"
        value = f"CASE WHEN {parts[1]} > 0 THEN try_divide({total}, CAST({parts[1]} AS DOUBLE)) END" if e.op == "avg" else total
        return Lane(f"CASE WHEN NOT {bad} THEN {value} END", f"CASE WHEN {bad} THEN 3 END")
    high, mid, low = (f"CAST({p} AS DECIMAL(20,0))" for p in parts[:3])
    total = f"CAST({high} * CAST({1 << HIGH}L AS DECIMAL(14,0)) + {mid} * CAST({1 << LOW}L AS DECIMAL(7,0)) + {low} AS DECIMAL(38,0))"
    if e.op == "avg":
        return Lane(f"try_divide(CAST({total} AS DOUBLE), CAST({parts[3]} AS DOUBLE))")
    inside = f"({total} BETWEEN CAST('{INT64_MIN}' AS DECIMAL(20,0)) AND CAST('{INT64_MAX}' AS DECIMAL(20,0)))"
    return Lane(f"CASE WHEN {inside} THEN CAST({total} AS BIGINT) END", f"CASE WHEN NOT {inside} THEN 5 END")
