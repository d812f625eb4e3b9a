"""The engine: a catalog, queries, prepared queries and plans.

``frame`` gives the lazy DataFrame of a query, for data of any size. ``query`` runs one and keeps the dialect's
order of errors: faults count for every row that WHERE keeps, whatever LIMIT cuts off later, and the caps on
result rows and groups hold before LIMIT too.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veltra.errors import EngineError
from veltra.functions.aggregates import adds_doubles
from veltra.functions.lanes import FAULTS, first_fault
from veltra.operators import relational as R
from veltra.plans.binding import Bound, Order, bind
from veltra.plans.rewrite import Options, Plan, plan
from veltra.plans.syntax import parse
from veltra.sources.catalog import Catalog, Table, load_manifest, registered
from veltra.types import Type

#: Defaults of the caps.
MEMORY_LIMIT, RESULT_LIMIT = 512 << 20, 100_000


@dataclass
class Result:
    columns: list[tuple[str, Type]]
    rows: list[tuple]
    plan: Plan
    scanned_rows: int
    filtered_rows: int | None  # rows that WHERE kept; not known without a cap on the result, unless profiled
    operators: list[dict] = field(default_factory=list)
    planning_ns: int = 0
    execution_ns: int = 0
    accounted_bytes: int = 0
    peak_bytes: int = 0


class PreparedQuery:
    """A plan of one engine and one state of its catalog."""

    def __init__(self, engine: Engine, made: Plan, generation: int):
        self._engine, self.plan, self._generation = engine, made, generation

    def release(self) -> Plan:
        """Hands the plan out once; the handle is of no use afterwards."""
        made, self.plan = self.plan, None
        return made


class Engine:
    def __init__(self, spark: SparkSession, memory_limit: int = MEMORY_LIMIT, result_limit: int | None = RESULT_LIMIT):
        self.spark = spark
        self.memory_limit = memory_limit
        self.result_limit = result_limit
        self.catalog = Catalog()

    # catalog

    def load_catalog(self, manifest: str | Path) -> None:
        """Replaces all tables by the manifest's, or none if one of them fails."""
        self.catalog.swap(load_manifest(self.spark, manifest, self.memory_limit))

    def register(self, name: str, df: DataFrame) -> None:
        """Adds a DataFrame as a table; its columns of other types are left out."""
        self.catalog.swap({**self.catalog.tables, name.lower(): registered(df)})

    def table(self, name: str) -> Table:
        return self.catalog.table(name.lower())

    # plans

    def _plan(self, sql: str, options: Options) -> Plan:
        if not 1 <= options.batch_size <= 65536:
            raise EngineError("CLI", "batch size must be in 1..65536")
        q = bind(parse(sql), lambda name: self.catalog.table(name).columns)
        return plan(q, options, self._sizes(q) if q.right is not None else (None, None))

    def _sizes(self, q: Bound) -> tuple[int | None, int | None]:
        """The rows of both tables if they were loaded, else Spark's estimates of their bytes."""
        both = self.catalog.table(q.table), self.catalog.table(q.right)
        if all(t.loaded for t in both):
            return both[0].rows, both[1].rows
        return _estimate(both[0].source.frame), _estimate(both[1].source.frame)

    def explain(self, sql: str, options: Options | None = None) -> Plan:
        return self._plan(sql, options or Options())

    def prepare(self, sql: str, options: Options | None = None) -> PreparedQuery:
        return PreparedQuery(self, self._plan(sql, options or Options()), self.catalog.generation)

    def execute(self, prepared: PreparedQuery) -> Result:
        if prepared.plan is None or prepared._engine is not self:
            raise EngineError("BIND", "the prepared query is empty or of another engine")
        if prepared._generation != self.catalog.generation:
            raise EngineError("BIND", "the catalog has changed since the query was prepared")
        return self._run(prepared.plan)

    def query(self, sql: str, options: Options | None = None) -> Result:
        begin = time.perf_counter_ns()
        made = self._plan(sql, options or Options())
        planned = time.perf_counter_ns()
        out = self._run(made)
        out.planning_ns = planned - begin
        return out

    # frames

    def _sources(self, q: Bound) -> tuple[R.Source, R.Source | None]:
        return self.catalog.table(q.table).source, self.catalog.table(q.right).source if q.right is not None else None

    def _rows(self, made: Plan, ordinals: bool) -> str:
        """A side that was asked for is hinted; if sizes decide, Catalyst decides by them too, and may broadcast."""
        left, right = self._sources(made.bound)
        asked = made.options.build_side
        return R.surviving(made.bound, left, right, ordinals, asked if right is not None and asked != "auto" else None)

    def frame(self, sql: str, options: Options | None = None) -> DataFrame:
        """The query as one lazy DataFrame: sums of DOUBLE in Spark's order, faults raised where they are met."""
        made = self._plan(sql, options or Options(optimizer=True, accumulation="native"))
        q = made.bound
        rows = self._rows(made, False)
        if q.aggregation:
            rows = R.grouped(q, R.guarded(q, rows))
        return self.spark.sql(R.ordered(q, R.checked(R.output_lanes(q), rows), q.limit)).toDF(*q.names)

    # execution

    def _run(self, made: Plan) -> Result:
        begin = time.perf_counter_ns()
        try:
            out = self._executed(made)
        except PySparkException as e:
            raise EngineError("INTERNAL", str(e).splitlines()[0]) from e
        out.execution_ns = time.perf_counter_ns() - begin
        return out

    def _executed(self, made: Plan) -> Result:
        q, cap = made.bound, self.result_limit
        held = sum(self.catalog.table(t).bytes for t in {q.table, q.right} - {None})
        if held > self.memory_limit:
            raise EngineError("RESOURCE", f"tables exceed the memory limit of {self.memory_limit} bytes")
        if q.aggregation and not q.groups and cap is not None and cap < 1:
            raise EngineError("RESOURCE", "the result limit allows no row")
        lanes = R.argument_lanes(q) if q.aggregation else R.output_lanes(q)
        fault = first_fault(*(x.fault for x in lanes if x is not None))
        fold = made.options.accumulation == "ordered" and any(map(adds_doubles, q.aggregates))
        if fault is not None or q.where is not None and q.where.may_fail:
            got, n = self._carefully(made, lanes, fault, fold)
        else:
            got, n = self._directly(made, lanes, fold)
        if q.limit is not None:
            got = got[: q.limit]
        size = held + sum(len(v.encode()) if isinstance(v, str) else 9 for r in got for v in r)
        if size > self.memory_limit:
            raise EngineError("RESOURCE", f"the result exceeds the memory limit of {self.memory_limit} bytes")
        scanned = sum(self._size(t) for t in (q.table, q.right) if t is not None)
        columns = [(name, e.type) for name, e in zip(q.names, q.outputs, strict=True)]
        out = Result(columns, got, made, scanned, n, accounted_bytes=size, peak_bytes=size)
        if made.options.profile:
            out.operators = self._measured(made, len(got))
            out.filtered_rows = next(o["output_rows"] for o in reversed(out.operators) if o["stage"] in ("Scan", "Filter", "InnerHashJoin"))
        return out

    def _directly(self, made: Plan, lanes, fold: bool) -> tuple[list[tuple], int | None]:
        """Nothing can fail before the end: one job, which gives a row more than the cap if there are more.

        Only if there are too many groups does it matter whether a sum in order turned infinite before the last of them.
        """
        q, cap = made.bound, self.result_limit
        rows = self._rows(made, fold)
        limit = q.limit if cap is None else cap + 1  # with a cap all rows count, whatever LIMIT leaves
        if q.aggregation:
            lanes = R.output_lanes(q)
        outputs = R.output_columns(lanes)
        if fold:
            done = R.grouped_rows(q, self.spark.sql(rows), R.ordinal(q)).selectExpr(*outputs, "n")
            done = done.orderBy(*map(_sort_key, q.order)) if q.order else done
            done = done if limit is None or limit >= 2**31 else done.limit(limit)
        else:
            rows = f"SELECT {', '.join(outputs)}, n FROM ({R.grouped(q, rows)})" if q.aggregation else f"SELECT {', '.join(outputs)} FROM ({rows})"
            done = self.spark.sql(R.ordered(q, rows, limit))
        got = _tuples(done)
        if cap is not None and len(got) > cap:
            if fold:
                return self._carefully(made, lanes, None, fold)
            raise EngineError("RESOURCE", f"more than {cap} {'groups' if q.aggregation else 'result rows'}")
        n = len(lanes)
        if bad := next((r[n] for r in got if r[n] is not None), None):
            raise EngineError("NUMERIC", FAULTS[bad])
        seen = sum(r[n + 1] for r in got) if q.aggregation else len(got)
        return [r[:n] for r in got], None if cap is None else seen

    def _carefully(self, made: Plan, lanes, fault: str | None, fold: bool) -> tuple[list[tuple], int]:
        """Faults, caps and sums in the order of the rows: several passes over the rows that WHERE keeps."""
        q = made.bound
        rows = self.spark.sql(self._rows(made, fold or fault is not None)).persist()
        try:
            n = rows.count()
            if q.where is not None and q.where.may_fail and self._reached(made):
                raise EngineError("NUMERIC", FAULTS[4])
            done = self._aggregated(q, rows, fault, fold) if q.aggregation else self._projected(q, rows, n, lanes, fault)
            if q.order:
                done = done.orderBy(*map(_sort_key, q.order))
            if q.limit is not None and q.limit < 2**31:
                done = done.limit(q.limit)
            return [r[: len(q.outputs)] for r in _tuples(done)], n
        finally:
            rows.unpersist()

    def _measured(self, made: Plan, out: int) -> list[dict]:
        """Rows into and out of each physical stage. Profiling counts every stage by a job of its own."""
        q = made.bound
        frames = ((name, self.spark.sql(text)) for name, text in R.stages(q, *self._sources(q), made.pushed, made.rest))
        counts = iter([(name, df.count(), len(df.columns)) for name, df in frames])
        given: dict[int, int] = {}
        found = []
        for s in made.physical:
            kind = s.operator.removeprefix("Vector").removeprefix("Scalar")
            taken = [given[i] for i in s.inputs]
            entry = {"id": s.id, "operator": s.operator, "stage": kind, "source": s.source}
            if kind in ("Scan", "Filter", "InnerHashJoin"):
                _, given[s.id], width = next(counts)
                if kind == "Scan":
                    taken = [given[s.id]]
                    entry |= {"columns_opened": width, "values_read": width * given[s.id]}
                if kind == "InnerHashJoin":
                    build = made.build_side == "right"
                    entry |= {"build_rows": taken[build], "probe_rows": taken[not build]}
            elif kind == "HashAggregate":
                given[s.id] = self.spark.sql(R.grouped(q, self._rows(made, False))).count()
            else:
                given[s.id] = min(taken[0], q.limit) if kind == "Limit" else taken[0]
            found.append({**entry, "input_rows": sum(taken), "output_rows": given[s.id]})
        return found

    def _size(self, name: str) -> int:
        t = self.catalog.table(name)
        if t.rows is None:
            t.rows = t.source.frame.count()
        return t.rows

    def _reached(self, made: Plan) -> bool:
        """Whether any row reaches WHERE, if the constant in it fails for every row."""
        from dataclasses import replace

        rows = R.surviving(replace(made.bound, where=None), *self._sources(made.bound))
        return not self.spark.sql(rows).isEmpty()

    def _projected(self, q: Bound, rows: DataFrame, n: int, lanes, fault: str | None) -> DataFrame:
        cap = self.result_limit
        over = cap is not None and n > cap
        if fault is not None:
            bad = rows.where(f"({fault}) IS NOT NULL")
            if over and cap > 0:  # rows up to the cap are evaluated before it is met
                last = rows.selectExpr(f"{R.ordinal(q)} AS o").orderBy("o").limit(cap).agg(F.max("o").alias("o")).first()["o"]
                bad = bad.where(F.expr(R.ordinal(q)) <= _literal(last))
            if not (over and cap == 0) and not bad.isEmpty():
                raise EngineError("NUMERIC", _reason(bad, fault))
        if over:
            raise EngineError("RESOURCE", f"more than {cap} result rows")
        return rows.selectExpr(*R.output_columns(lanes))

    def _aggregated(self, q: Bound, rows: DataFrame, fault: str | None, fold: bool) -> DataFrame:
        cap, place = self.result_limit, R.ordinal(q) if fold or fault is not None else None
        order = place if fold else None
        limit = None  # first row of the group that is one too many
        keys = [R.column(c) for c in dict.fromkeys(q.groups)]
        if cap is not None and keys:
            if place is None:
                if rows.select(*keys).distinct().limit(cap + 1).count() > cap:
                    raise EngineError("RESOURCE", f"more than {cap} groups")
            else:
                firsts = rows.groupBy(*keys).agg(F.expr(f"min({place}) AS o")).orderBy("o").limit(cap + 1)
                found = firsts.agg(F.count("*").alias("n"), F.max("o").alias("o")).first()
                limit = found["o"] if found["n"] > cap else None
        early = rows if limit is None else rows.where(F.expr(place) < _literal(limit))
        if fault is not None:
            bad = early.where(f"({fault}) IS NOT NULL")
            if not bad.isEmpty():
                raise EngineError("NUMERIC", _reason(bad, fault))
        outputs = R.output_columns(R.output_lanes(q))
        if limit is not None:
            # a sum that turned infinite before the group too many was met
            if fold and not R.grouped_rows(q, early, order).selectExpr(*outputs).where("fault = 3").isEmpty():
                raise EngineError("NUMERIC", FAULTS[3])
            raise EngineError("RESOURCE", f"more than {cap} groups")
        done = R.grouped_rows(q, rows, order).selectExpr(*outputs)
        bad = done.where("fault IS NOT NULL").select("fault").first()
        if bad is not None:
            raise EngineError("NUMERIC", FAULTS[bad["fault"]])
        return done


def _sort_key(o: Order):
    c = F.col(f"r{o.column}")
    return {(False, False): c.asc_nulls_last, (False, True): c.asc_nulls_first, (True, False): c.desc_nulls_last, (True, True): c.desc_nulls_first}[o.descending, o.nulls_first]()


def _literal(x):
    return F.struct(*(F.lit(v) for v in x)) if isinstance(x, tuple) else F.lit(x)


def _reason(bad: DataFrame, fault: str) -> str:
    return FAULTS[bad.selectExpr(f"{fault} AS f").first()["f"]]


def _tuples(df: DataFrame) -> list[tuple]:
    """All rows, column by column through Arrow: much faster than row objects."""
    return list(zip(*(c.to_pylist() for c in df.toArrow().columns), strict=True))


def _estimate(df: DataFrame) -> int | None:
    """Spark's estimate of a frame's bytes; None where the session has no plan to ask."""
    inner = getattr(df, "_jdf", None)
    return None if inner is None else int(str(inner.queryExecution().optimizedPlan().stats().sizeInBytes()))
