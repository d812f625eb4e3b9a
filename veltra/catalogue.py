"""The registered queries of the dialect, each with SQL that gives the same rows elsewhere.

A query is one text for both engines: ``ISUM`` stands for a sum of INT64, which other engines widen, and literals
carry exponents so that none of them takes them for decimals. The tables are projections of the test tables that
add NULLs and BOOLs and widen narrow integers.
"""

from __future__ import annotations

import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veltra.engine import RESULT_LIMIT, Engine, Result
from veltra.errors import EngineError
from veltra.plans.rewrite import Options
from veltra.types import Type

TABLES: dict[str, tuple[str, list[str]]] = {
    "items": (
        "lineitem",
        [
            "l_orderkey AS id",
            "l_partkey AS part",
            "l_suppkey AS supp",
            "CAST(l_linenumber AS BIGINT) AS line",
            "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_partkey - 1000 END AS n",
            "l_quantity AS q",
            "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_quantity / 4 END AS d",
            "CASE WHEN l_orderkey % 10 <> 0 THEN NULL ELSE l_quantity END AS sparse",
            "l_returnflag = 'R' AS r",
            "CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_linestatus = 'O' END AS b",
            "l_returnflag AS flag",
            "CASE WHEN l_linenumber % 6 = 0 THEN NULL ELSE l_linestatus END AS s",
            "l_orderkey % 1000 AS bucket",
            "l_partkey % 16 AS low",
            "l_partkey % 2048 AS high",
        ],
    ),
    "buys": (
        "orders",
        [
            "o_orderkey AS oid",
            "o_custkey AS cust",
            "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS ncust",
            "CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 8 ELSE o_custkey END AS skewed",
            "o_orderstatus AS status",
            "o_totalprice AS price",
            "o_orderpriority AS prio",
            "o_orderkey % 1000 AS bucket",
        ],
    ),
    "people": (
        "customer",
        [
            "c_custkey AS pid",
            "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS npid",
            "c_name AS name",
            "CAST(c_nationkey AS BIGINT) AS nation",
            "c_acctbal AS bal",
            "c_mktsegment AS seg",
            "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS nseg",
        ],
    ),
    # both signs of the widest numbers: partial sums leave INT64, whole ones come back
    "wides": ("orders", ["o_orderkey AS oid", "o_orderstatus AS status", "PAIR(9223372036854775807, 1 - 9223372036854775807) AS wide"]),
    "lands": ("nation", ["CAST(n_nationkey AS BIGINT) AS land", "n_name AS lname", "CAST(n_regionkey AS BIGINT) AS region"]),
}

FLAGSHIP = "SELECT flag, COUNT(*) AS n, SUM(q) AS qty FROM items WHERE q >= 25e0 GROUP BY flag ORDER BY flag"

QUERIES: dict[str, str] = {
    "flagship": FLAGSHIP,
    # scans and projections
    "scan_star": "SELECT * FROM lands",
    "scan_alias_star": "SELECT p.* FROM people AS p WHERE p.nation = 3",
    "projection_columns": "SELECT id, line, flag FROM items",
    "projection_arith": "SELECT id, line, part + supp AS added, part - supp AS less, line * 3 AS tripled FROM items",
    "projection_double_arith": "SELECT id, line, q + 5e-1 AS a, q - 25e-2 AS b, d * 2e0 AS c FROM items",
    "int_division": "SELECT id, line, part / 4 AS quarter, n / line AS ratio FROM items",
    "double_division": "SELECT id, line, d / q AS ratio FROM items",
    "unary_minus": "SELECT id, line, -n AS neg, -d AS negd, -(-line) AS back FROM items",
    "precedence": "SELECT id, line, 1 + line * 2 - 3 AS x, (1 + line) * (2 - 3) AS y FROM items",
    "cast_int_double": "SELECT id, line, CAST(n AS DOUBLE) AS x, CAST(line AS DOUBLE) + d AS y FROM items",
    "typed_nulls": "SELECT land, CAST(NULL AS BIGINT) AS a, CAST(NULL AS DOUBLE) AS b, CAST(NULL AS BOOLEAN) AS c, CAST(NULL AS VARCHAR) AS d FROM lands",
    "inferred_nulls": "SELECT land, land + NULL AS a, NULL = land AS b, NOT NULL AS c, NULL AND TRUE AS d FROM lands",
    "literals": "SELECT land, 42 AS i, 15e-1 AS d, TRUE AS t, FALSE AS f, 'it''s' AS s FROM lands",
    # comparisons and logic
    "compare_int": "SELECT id, line, n = 5 AS eq, n <> 5 AS ne, n < 5 AS lt, n <= 5 AS le, n > 5 AS gt, n >= 5 AS ge FROM items",
    "compare_double": "SELECT id, line, d = 25e-1 AS eq, d != 25e-1 AS ne, d < 25e-1 AS lt, d >= 25e-1 AS ge FROM items",
    "compare_string": "SELECT id, line, s = 'O' AS eq, s < 'O' AS lt, flag >= s AS ge FROM items",
    "compare_bool": "SELECT id, line, r = b AS eq, r < b AS lt, b >= TRUE AS ge FROM items",
    "three_valued_logic": "SELECT id, line, r AND b AS a, r OR b AS o, NOT b AS x, b AND NULL AS y, b OR NULL AS z FROM items",
    "is_null": "SELECT id, line, n IS NULL AS a, d IS NOT NULL AS b, (n + 1) IS NULL AS c FROM items",
    # filters
    "filter_int": "SELECT id, line, n FROM items WHERE n > 100",
    "filter_negative_literal": "SELECT id, line, n FROM items WHERE n < -500",
    "filter_and_or_not": "SELECT id, line FROM items WHERE (n > 0 AND NOT b) OR (flag = 'A' AND d <= 5e0)",
    "filter_string": "SELECT id, line, s FROM items WHERE s = 'O' AND flag <> 'N'",
    "filter_bool_atom": "SELECT id, line FROM items WHERE b",
    "filter_true": "SELECT land FROM lands WHERE TRUE",
    "filter_null": "SELECT land FROM lands WHERE NULL",
    "filter_is_null": "SELECT id, line FROM items WHERE n IS NULL AND d IS NOT NULL",
    "filter_columns": "SELECT id, line FROM items WHERE n > part",
    # aggregates
    "count_star": "SELECT COUNT(*) AS n FROM items",
    "count_expr": "SELECT COUNT(n) AS n, COUNT(n + 1) AS m, COUNT(NULL) AS z, COUNT(b) AS k FROM items",
    "sum_int": "SELECT ISUM(n) AS total, ISUM(line) AS lines FROM items",
    "sum_double": "SELECT SUM(q) AS total, SUM(d) AS quarters FROM items",
    "avg_int": "SELECT AVG(line) AS a, AVG(n) AS b FROM items",
    "avg_double": "SELECT AVG(q) AS a, AVG(d) AS b FROM items",
    "min_max_int": "SELECT MIN(n) AS a, MAX(n) AS b FROM items",
    "min_max_double": "SELECT MIN(d) AS a, MAX(d) AS b FROM items",
    "min_max_bool": "SELECT MIN(b) AS a, MAX(b) AS b FROM items",
    "min_max_string": "SELECT MIN(s) AS a, MAX(flag) AS b FROM items",
    "global_agg_empty": "SELECT COUNT(*) AS n, ISUM(n) AS total, AVG(d) AS mean, MIN(s) AS low FROM items WHERE FALSE",
    "group_single": "SELECT flag, COUNT(*) AS n, ISUM(n) AS total, AVG(d) AS mean FROM items GROUP BY flag",
    "group_composite": "SELECT flag, r, line, COUNT(*) AS n, MAX(d) AS high FROM items GROUP BY flag, r, line",
    "group_null_key": "SELECT s, COUNT(*) AS n, COUNT(n) AS m FROM items GROUP BY s",
    "group_bool": "SELECT b, COUNT(*) AS n FROM items GROUP BY b",
    "group_no_agg": "SELECT flag, s FROM items GROUP BY flag, s",
    "group_key_expr": "SELECT line * 10 AS x, line + 1 AS y, COUNT(*) AS n FROM items GROUP BY line",
    "agg_arith": "SELECT flag, ISUM(line) + COUNT(*) AS x, SUM(q) / CAST(COUNT(*) AS DOUBLE) AS y, MAX(n) - MIN(n) AS z FROM items GROUP BY flag",
    "agg_of_expr": "SELECT flag, ISUM(line * 2 + 1) AS x, SUM(q * 2e0) AS y, MAX(-n) AS z FROM items GROUP BY flag",
    "agg_predicate": "SELECT flag, COUNT(*) > 100 AS many, MIN(n) IS NULL AS none FROM items GROUP BY flag",
    # whole tables in order, and limits
    "order_name": "SELECT oid, price FROM buys ORDER BY price DESC, oid",
    "order_position": "SELECT status, oid FROM buys ORDER BY 2 DESC",
    "order_nulls_first": "SELECT ncust, oid FROM buys ORDER BY ncust NULLS FIRST, oid",
    "order_nulls_last": "SELECT ncust, oid FROM buys ORDER BY ncust DESC NULLS LAST, oid",
    "order_multi": "SELECT prio, status, oid FROM buys ORDER BY prio, status DESC, oid",
    "limit_cuts": "SELECT TRUE AS t, 'row' AS s FROM buys LIMIT 7",
    "limit_plain": "SELECT COUNT(*) AS n FROM buys LIMIT 5",
    "limit_zero": "SELECT oid FROM buys LIMIT 0",
    # joins
    "join_single_key": "SELECT o.oid, p.name FROM buys AS o INNER JOIN people AS p ON o.cust = p.pid",
    "join_reversed_key": "SELECT o.oid, p.seg FROM buys AS o INNER JOIN people AS p ON p.pid = o.cust WHERE p.bal > 0e0",
    "join_composite": "SELECT a.id, a.line, z.q FROM items AS a INNER JOIN items AS z ON a.id = z.id AND a.line = z.line AND a.flag = z.flag",
    "join_null_keys": "SELECT o.oid, p.pid FROM buys AS o INNER JOIN people AS p ON o.ncust = p.npid",
    "join_string_key": "SELECT COUNT(*) AS n FROM people AS p INNER JOIN people AS z ON p.seg = z.nseg AND p.nation = z.nation",
    "join_bool_key": "SELECT COUNT(*) AS n, ISUM(a.line) AS lines FROM items AS a INNER JOIN items AS z ON a.id = z.id AND a.r = z.b",
    "join_self": "SELECT a.oid AS one, z.oid AS two FROM buys AS a INNER JOIN buys AS z ON a.cust = z.cust",
    "join_star": "SELECT * FROM people AS p INNER JOIN lands AS l ON p.nation = l.land",
    "join_alias_star": "SELECT l.*, p.pid FROM people AS p INNER JOIN lands AS l ON p.nation = l.land",
    "join_filter_residual": "SELECT a.id, a.line AS x, z.line AS y FROM items AS a INNER JOIN items AS z ON a.id = z.id WHERE a.line < z.line AND a.q > 25e0",
    "join_group": "SELECT l.lname, COUNT(*) AS n, COUNT(p.npid) AS m, MAX(p.bal) AS high FROM people AS p INNER JOIN lands AS l ON p.nation = l.land GROUP BY l.lname",
    "join_order_limit": "SELECT o.oid, p.name, o.price FROM buys AS o INNER JOIN people AS p ON o.cust = p.pid ORDER BY price DESC, oid LIMIT 25",
    "join_agg_global": "SELECT COUNT(*) AS n, ISUM(o.bucket) AS total FROM buys AS o INNER JOIN people AS p ON o.cust = p.pid WHERE p.seg = 'BUILDING'",
    # benchmark shapes
    "bench_scan_selective": "SELECT COUNT(*) AS n, SUM(d) AS revenue FROM items WHERE bucket < 10",
    "bench_scan_broad": "SELECT COUNT(*) AS n, SUM(d) AS revenue FROM items WHERE bucket < 900",
    "bench_projection_narrow": "SELECT id, line FROM items",
    "bench_projection_wide": "SELECT * FROM items",
    "bench_null_light": "SELECT COUNT(d) AS present, SUM(d) AS total, AVG(d) AS mean FROM items",
    "bench_null_heavy": "SELECT COUNT(sparse) AS present, SUM(sparse) AS total, AVG(sparse) AS mean FROM items",
    "bench_group_low": "SELECT low, COUNT(*) AS n, ISUM(line) AS units FROM items GROUP BY low ORDER BY low",
    "bench_group_high": "SELECT high, COUNT(*) AS n, ISUM(line) AS units FROM items GROUP BY high ORDER BY high",
    "bench_group_string": "SELECT s, COUNT(*) AS n, SUM(d) AS revenue FROM items GROUP BY s ORDER BY s NULLS LAST",
    "bench_sort_limit": "SELECT oid, price FROM buys ORDER BY price DESC NULLS LAST, oid LIMIT 1000",
    "bench_join_uniform": "SELECT p.seg, COUNT(*) AS n, ISUM(o.bucket) AS units FROM buys AS o INNER JOIN people AS p ON o.cust = p.pid WHERE o.bucket < 500 GROUP BY p.seg ORDER BY 1",
    "bench_join_skew": "SELECT p.seg, COUNT(*) AS n, ISUM(o.bucket) AS units FROM buys AS o INNER JOIN people AS p ON o.skewed = p.pid WHERE o.bucket < 500 GROUP BY p.seg ORDER BY 1",
}


#: Run by ``Engine.query``: caps, the order of errors, and DOUBLE sums in the order of rows.
BY_QUERY: dict[str, str] = {
    "query_flagship": FLAGSHIP,
    "query_sum_wide": "SELECT status, ISUM(wide) AS total, AVG(wide) AS mean, COUNT(*) AS n FROM wides GROUP BY status",
    "query_sum_wide_global": "SELECT ISUM(wide) AS total FROM wides",
    "query_sum_double_in_order": "SELECT flag, s, SUM(d) AS total, AVG(q) AS mean, COUNT(d) AS n FROM items GROUP BY flag, s",
    "query_sum_double_global": "SELECT SUM(d) AS total, AVG(sparse) AS mean, MAX(n) AS high FROM items",
    "query_sum_double_of_join": "SELECT p.nseg, SUM(p.bal) AS total, COUNT(*) AS n FROM people AS p INNER JOIN lands AS l ON p.nation = l.land WHERE p.bal < 0e0 AND p.bal > 0e0 GROUP BY p.nseg",
    "query_fault_free_division": "SELECT flag, MAX(part / line) AS high, MIN(n + part) AS low FROM items GROUP BY flag",
    "query_limit_after_all": "SELECT land, land * 2 AS twice FROM lands ORDER BY land DESC LIMIT 3",
    "query_join_group": "SELECT l.lname, COUNT(*) AS n, COUNT(p.npid) AS m FROM people AS p INNER JOIN lands AS l ON p.nation = l.land GROUP BY l.lname ORDER BY n DESC, lname",
    "query_null_groups": "SELECT nseg, COUNT(*) AS n, MIN(bal) AS low FROM people GROUP BY nseg ORDER BY nseg NULLS FIRST",
}

#: Default labels: the statement, and the same with its labels written out.
LABELS = (
    "SELECT line, COUNT(*), SUM(part + 1), MAX(-n), COUNT(*) IS NULL FROM items GROUP BY line",
    'SELECT line, COUNT(*) AS "count(*)", CAST(SUM(part + 1) AS BIGINT) AS "sum((part + 1))", MAX(-n) AS "max(-(n))", COUNT(*) IS NULL AS "count(*) is null" FROM items GROUP BY line',
)

#: Statements that fail, or would but for their rows: with the result limit, and what the rows say the code is.
CODES: dict[str, tuple[str, int | None, str]] = {
    "code_division_by_zero": ("SELECT 1 / n AS x FROM items", None, "CASE WHEN COUNT(*) FILTER (n = 0) > 0 THEN 'NUMERIC' ELSE 'ok' END"),
    "code_zero_behind_and": ("SELECT FALSE AND 1 / n > 0e0 AS x FROM items LIMIT 0", None, "CASE WHEN COUNT(*) FILTER (n = 0) > 0 THEN 'NUMERIC' ELSE 'ok' END"),
    "code_zero_filtered": ("SELECT COUNT(1 / n) AS x FROM items WHERE n <> 0", None, "CASE WHEN COUNT(*) FILTER (n <> 0) > 0 THEN 'ok' ELSE 'ok' END"),
    "code_overflow": ("SELECT part + 9223372036854775807 AS x FROM items", None, "CASE WHEN MAX(part) > 0 THEN 'NUMERIC' ELSE 'ok' END"),
    "code_sum_overflow": ("SELECT SUM(wide) AS x FROM wides WHERE wide > 0", None, "CASE WHEN COUNT(*) FILTER (wide > 0) > 1 THEN 'NUMERIC' ELSE 'ok' END"),
    "code_infinite_product": ("SELECT q * 1e308 * 1e308 AS x FROM items", None, "CASE WHEN MAX(q) > 0 THEN 'NUMERIC' ELSE 'ok' END"),
    "code_result_cap": ("SELECT oid FROM buys LIMIT 1", 100, "CASE WHEN COUNT(*) > 100 THEN 'RESOURCE' ELSE 'ok' END"),
    "code_group_cap": ("SELECT cust, COUNT(*) AS n FROM buys GROUP BY cust ORDER BY cust LIMIT 1", 100, "CASE WHEN COUNT(DISTINCT cust) > 100 THEN 'RESOURCE' ELSE 'ok' END"),
    "code_types_differ": ("SELECT line + q AS x FROM items", None, "CASE WHEN COUNT(*) >= 0 THEN 'TYPE' END"),
    "code_unknown_column": ("SELECT nothing FROM items", None, "CASE WHEN COUNT(*) >= 0 THEN 'BIND' END"),
    "code_left_of_double_sum": ("SELECT SUM(a.price) AS x FROM buys AS a INNER JOIN people AS p ON a.cust = p.pid", None, "CASE WHEN COUNT(*) >= 0 THEN 'UNSUPPORTED' END"),
}

#: Tables that go through a strict CSV file and a manifest, and the queries over them.
AS_CSV = "people"
CSV_QUERIES: dict[str, str] = {
    "csv_scan": "SELECT * FROM people",
    "csv_group": "SELECT nseg, nation, COUNT(*) AS n, COUNT(npid) AS m, ISUM(pid) AS total FROM people WHERE bal > 0e0 GROUP BY nseg, nation",
}


def spark_sql(text: str) -> str:
    return re.sub(r"PAIR\(([^,]*), ([^()]*)\)", r"explode(array(\1, \2))", text)


def other_sql(text: str) -> str:
    return re.sub(r"PAIR\(([^,]*), ([^()]*)\)", r"unnest([\1, \2])", text)


def engine(spark: SparkSession, sf_dir: str, names: set[str] | None = None, result_limit: int | None = None) -> Engine:
    """An engine over the tables of a folder, without caps unless asked."""
    out = Engine(spark, memory_limit=1 << 40, result_limit=result_limit)
    for name, (table, columns) in TABLES.items():
        if names is None or name in names:
            out.register(name, spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*map(spark_sql, columns)))
    return out


def _names(sql: str) -> set[str]:
    return {n for n in TABLES if re.search(rf"\b{n}\b", sql)}


def dialect(sql: str) -> str:
    return sql.replace("ISUM(", "SUM(")


def run(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir, _names(sql)).frame(dialect(sql))


def as_frame(spark: SparkSession, result: Result) -> DataFrame:
    schema = T.StructType([T.StructField(n, k.spark) for n, k in result.columns])
    return spark.createDataFrame(result.rows, schema)


def run_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: as_frame(spark, engine(spark, sf_dir, _names(sql), RESULT_LIMIT).query(dialect(sql)))


def run_code(sql: str, limit: int | None) -> Callable[[SparkSession, str], DataFrame]:
    """The code that a statement fails with; a join hashes its left side."""

    def code(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = "ok"
        try:
            engine(spark, sf_dir, _names(sql), limit).query(sql, Options(build_side="left" if "JOIN" in sql else "auto"))
        except EngineError as e:
            found = e.code
        return spark.createDataFrame([(found,)], "code string")

    return code


def run_csv(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """Writes a table as a CSV file with its manifest beside the session's shared files, loads and queries it."""

    def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = engine(spark, sf_dir, {AS_CSV}).table(AS_CSV)
        root = (spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()).removeprefix("file:")
        folder = Path("/" + root.lstrip("/")) / f"csv-{uuid.uuid4().hex[:12]}"
        quoted = lambda n: F.concat(F.lit('"'), F.replace(F.col(n), F.lit('"'), F.lit('""')), F.lit('"'))
        cells = [F.coalesce(quoted(n) if k is Type.STRING else F.col(n).cast("string"), F.lit("\\N")) for n, k in table.columns]
        body = table.source.frame.select(F.concat_ws(",", *cells).alias("value"))
        body.coalesce(1).write.text(f"file://{folder}/rows")
        part = next((folder / "rows").glob("part-*"))
        with open(folder / "table.csv", "wb") as out, open(part, "rb") as rows:
            out.write(",".join(n for n, _ in table.columns).encode() + b"\n")
            shutil.copyfileobj(rows, out)
        columns = [{"name": n, "type": k.value, "nullable": True} for n, k in table.columns]
        (folder / "catalog.json").write_text(json.dumps({"tables": [{"name": AS_CSV, "path": "table.csv", "columns": columns}]}))
        e = Engine(spark, memory_limit=1 << 40, result_limit=None)
        e.load_catalog(folder / "catalog.json")
        return e.frame(dialect(sql))

    return loaded


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(FLAGSHIP)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: run(sql) for name, sql in QUERIES.items()}
    found |= {name: run_query(sql) for name, sql in BY_QUERY.items()}
    found |= {name: run_code(sql, limit) for name, (sql, limit, _) in CODES.items()}
    found |= {name: run_csv(sql) for name, sql in CSV_QUERIES.items()}
    return found | {"query_labels": run_query(LABELS[0])}


def _elsewhere(sql: str) -> str:
    views = ", ".join(f"{n} AS (SELECT {', '.join(map(other_sql, TABLES[n][1]))} FROM {TABLES[n][0]})" for n in sorted(_names(sql)))
    return f"WITH {views} " + re.sub(r"ISUM\(([^()]*)\)", r"CAST(SUM(\1) AS BIGINT)", sql)


def oracle_sql() -> dict[str, str]:
    found = {name: _elsewhere(sql) for name, sql in (QUERIES | BY_QUERY | CSV_QUERIES).items()}
    for name, (sql, _, code) in CODES.items():
        table = re.search(r"FROM (\w+)", sql)[1]
        found[name] = _elsewhere(f"SELECT {code.replace('FILTER (', 'FILTER (WHERE ')} AS code FROM {table}")
    return found | {"query_labels": _elsewhere(LABELS[1])}
