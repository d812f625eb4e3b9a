"""The relational operators as Spark SQL, one text for a query, and as steps over frames that are kept.

Inputs get positional column names (c0, c1, ... over both sources, o0 and o1 for row numbers), so that duplicate
and ambiguous output names need no care until the very end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veltra.functions.aggregates import adds_doubles, finished, partials, width
from veltra.functions.lanes import Lane, first_fault, lower
from veltra.plans.binding import Bound, Expr

ROW_NUMBER = "__row"


@dataclass
class Source:
    """A registered table: its columns are those of the catalog, in order, maybe with a row number behind."""

    frame: DataFrame
    names: list[str]
    numbered: bool
    _view: str = field(default="", repr=False)

    def view(self) -> str:
        """The name under which the session's SQL finds the table, from the first time that it is asked for."""
        if not self._view:
            self._view = f"veltra_{uuid.uuid4().hex}"
            self.frame.createOrReplaceTempView(self._view)
        return self._view

    def drop(self) -> None:
        if self._view:
            self.frame.sparkSession.catalog.dropTempView(self._view)
            self._view = ""


def column(i: int) -> str:
    return f"c{i}"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# ---------------------------------------------------------------- rows


def scan(source: Source, first: int, side: int, used: set[int], ordinals: bool) -> str:
    """The columns that the query uses, by position; ``ordinals`` adds the row number."""
    cols = [f"{_quoted(n)} AS c{first + i}" for i, n in enumerate(source.names) if first + i in used]
    if ordinals:
        cols.append(f"{ROW_NUMBER if source.numbered else 'monotonically_increasing_id()'} AS o{side}")
    return f"SELECT {', '.join(cols) or 'TRUE AS present'} FROM {source.view()}"


def joined(left: str, right: str, keys: list[tuple[int, int]], build: str | None) -> str:
    """Inner equi-join; NULL keys never match. ``build`` asks for the side that is hashed."""
    hint = f"/*+ SHUFFLE_HASH({build}_side) */ " if build else ""
    return f"SELECT {hint}* FROM ({left}) left_side JOIN ({right}) right_side ON " + " AND ".join(f"{column(a)} = {column(b)}" for a, b in keys)


def kept(rows: str, conditions: list[Expr]) -> str:
    return f"SELECT * FROM ({rows}) WHERE " + " AND ".join(lower(e, column).value for e in conditions) if conditions else rows


def surviving(q: Bound, left: Source, right: Source | None, ordinals: bool = False, build: str | None = None) -> str:
    """The rows that WHERE keeps. Catalyst moves conjuncts below the join and drops unused columns."""
    rows = scan(left, 0, 0, q.used, ordinals)
    if right is not None:
        rows = joined(rows, scan(right, len(left.names), 1, q.used, ordinals), q.keys, build)
    return kept(rows, [] if q.where is None else [q.where])


def stages(q: Bound, left: Source, right: Source | None, pushed: dict[int, list[Expr]], rest: list[Expr]) -> Iterator[tuple[str, str]]:
    """The operators up to the rows that WHERE keeps, one by one and as the plan shows them: for counting."""
    sides = []
    for side, source in enumerate(s for s in (left, right) if s is not None):
        rows = scan(source, side * len(left.names), side, q.used, False)
        yield "Scan", rows
        if pushed.get(side):
            rows = kept(rows, pushed[side])
            yield "Filter", rows
        sides.append(rows)
    rows = sides[0]
    if right is not None:
        rows = joined(*sides, q.keys, None)
        yield "InnerHashJoin", rows
    if rest:
        yield "Filter", kept(rows, rest)


def ordinal(q: Bound) -> str:
    """A row's place in the input order: left row, then right row."""
    return "struct(o0, o1)" if q.right is not None else "o0"


# ---------------------------------------------------------------- groups


def argument_lanes(q: Bound) -> list[Lane | None]:
    return [lower(a.args[0], column) if a.args else None for a in q.aggregates]


def _key_names(q: Bound) -> dict[int, str]:
    return {c: f"k{i}" for i, c in enumerate(dict.fromkeys(q.groups))}


def _aggregates(q: Bound) -> dict[str, str]:
    """The partial aggregates by their names, and ``n``, the number of a group's rows."""
    found = {f"a{i}_{j}": p for i, (a, lane) in enumerate(zip(q.aggregates, argument_lanes(q), strict=True)) for j, p in enumerate(partials(a, None if lane is None else lane.value))}
    return found | {"n": "count(1)"}


def grouped(q: Bound, rows: str) -> str:
    """One row for each group with its keys and partial aggregates."""
    keys = _key_names(q)
    cols = [*(f"{column(c)} AS {k}" for c, k in keys.items()), *(f"{p} AS {n}" for n, p in _aggregates(q).items())]
    by = f" GROUP BY {', '.join(map(column, keys))}" if keys else ""
    return f"SELECT {', '.join(cols)} FROM ({rows}){by}"


def grouped_rows(q: Bound, rows: DataFrame, order: str | None = None) -> DataFrame:
    """The same of a frame; with ``order``, DOUBLE sums are folded in this order of the rows."""
    keys = _key_names(q)
    own = list(keys.values())
    renamed = rows.withColumns({k: F.col(column(c)) for c, k in keys.items()}) if keys else rows
    plain = renamed.groupBy(*own).agg(*(F.expr(p).alias(n) for n, p in _aggregates(q).items()))
    sums = {f"a{i}_0": lane.value for i, (a, lane) in enumerate(zip(q.aggregates, argument_lanes(q), strict=True)) if adds_doubles(a)}
    if order is None or not sums:
        return plain
    folded = in_order(renamed.selectExpr(*own, f"{order} AS o", *(f"{v} AS f_{n}" for n, v in sums.items())), own, [f"f_{n}" for n in sums])
    folded = folded.selectExpr(*(f"{k} AS f_{k}" for k in own), *(f"f_{n}" for n in sums), "0 AS f_one")
    same = F.expr(" AND ".join(f"{k} <=> f_{k}" for k in own) or "one = f_one")
    both = plain.withColumn("one", F.lit(0)).join(folded, same, "left")
    return both.selectExpr(*own, *(f"f_{c} AS {c}" if c in sums else c for c in plain.columns if c not in own))


def in_order(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """For each group the sums of ``values``, added one by one by ``o``; NULL if there is none.

    A group's rows pass through one task, sorted, and only the running sums are held: what a sum in input order
    allows. Groups are dealt over all tasks; without keys there is one.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.repartition(n, *keys) if keys else rows.coalesce(1)).sortWithinPartitions(*keys, "o").select(*keys, *values)

    def fold(batches):
        key, sums = None, []

        def row() -> pa.RecordBatch:
            cells = [*key, *sums]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names)

        for b in batches:
            names, kinds = b.schema.names, b.schema.types
            if not b.num_rows:
                continue
            change = np.zeros(b.num_rows, bool)
            for k in keys:  # where a key differs from the one above it
                c = b[k]
                null = c.is_null().to_numpy(zero_copy_only=False)
                unlike = pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), False).to_numpy(zero_copy_only=False)
                change[1:] |= unlike | (null[1:] != null[:-1])
            cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                held = tuple(b[k][lo].as_py() for k in keys)
                if key != held:
                    if key is not None:
                        yield row()
                    key, sums = held, [None] * len(values)
                for j, v in enumerate(values):
                    own = b[v].slice(lo, hi - lo).drop_null().to_numpy()
                    if len(own):
                        sums[j] = float(np.add.accumulate(np.concatenate([[0.0 if sums[j] is None else sums[j]], own]))[-1])
        if key is not None:
            yield row()

    return dealt.mapInArrow(fold, dealt.schema)


# ---------------------------------------------------------------- outputs


def output_lanes(q: Bound) -> list[Lane]:
    """Every output expression over surviving rows, or over groups; a group's aggregates bring their own faults."""
    if not q.aggregation:
        return [lower(e, column) for e in q.outputs]
    keys = _key_names(q)
    done = [finished(a, [f"a{i}_{j}" for j in range(width(a))]) for i, a in enumerate(q.aggregates)]
    own = first_fault(*(d.fault for d in done))
    lanes = [lower(e, lambda c: keys[c], lambda i: done[i].value) for e in q.outputs]
    return [Lane(x.value, first_fault(own, x.fault)) for x in lanes]


def output_columns(lanes: list[Lane]) -> list[str]:
    """Outputs r0, r1, ... and the first fault among them."""
    fault = first_fault(*dict.fromkeys(x.fault for x in lanes)) or "CAST(NULL AS INT)"
    return [*(f"{x.value} AS r{i}" for i, x in enumerate(lanes)), f"{fault} AS fault"]


def raising(fault: str) -> str:
    """A condition that holds, or raises if there is a fault."""
    return f"CASE WHEN {fault} IS NOT NULL THEN CAST(raise_error(concat('NUMERIC: fault ', CAST({fault} AS STRING))) AS BOOLEAN) ELSE TRUE END"


def checked(lanes: list[Lane], rows: str) -> str:
    """Outputs whose faults raise: for frames that nobody checks before they run."""
    cols = output_columns(lanes)
    if all(x.fault is None for x in lanes):
        return f"SELECT {', '.join(cols[:-1])} FROM ({rows})"
    return f"SELECT {', '.join(f'r{i}' for i in range(len(lanes)))} FROM (SELECT {', '.join(cols)} FROM ({rows})) WHERE {raising('fault')}"


def guarded(q: Bound, rows: str) -> str:
    """Rows whose aggregate arguments are sound; a fault raises as its row is read."""
    fault = first_fault(*(x.fault for x in argument_lanes(q) if x is not None))
    return rows if fault is None else f"SELECT * FROM ({rows}) WHERE {raising(fault)}"


def order_keys(q: Bound) -> list[str]:
    """NULLS LAST unless asked otherwise."""
    return [f"r{o.column} {'DESC' if o.descending else 'ASC'} NULLS {'FIRST' if o.nulls_first else 'LAST'}" for o in q.order]


def ordered(q: Bound, rows: str, limit: int | None) -> str:
    """ORDER BY outputs and LIMIT; a limit that Spark has no number for cuts nothing."""
    by = f" ORDER BY {', '.join(order_keys(q))}" if q.order else ""
    return f"SELECT * FROM ({rows}){by}" + (f" LIMIT {limit}" if limit is not None and limit < 2**31 else "")
