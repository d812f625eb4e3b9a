"""The typed catalog: JSON manifests of CSV tables, and DataFrames registered under a name."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veltra.errors import EngineError
from veltra.operators.relational import ROW_NUMBER, Source
from veltra.sources import csvfile
from veltra.types import Type, logical

#: Limits.
MOST_MANIFEST, MOST_NESTING, MOST_COLUMNS = 1 << 20, 128, 4096

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_ARROW = {Type.INT64: pa.int64(), Type.DOUBLE: pa.float64(), Type.BOOL: pa.bool_(), Type.STRING: pa.string()}


@dataclass
class Table:
    columns: list[tuple[str, Type]]
    source: Source
    rows: int | None = None  # known for loaded tables
    bytes: int = 0
    loaded: bool = False


@dataclass
class Catalog:
    tables: dict[str, Table] = field(default_factory=dict)
    generation: int = 0

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise EngineError("BIND", f"unknown table: {name}")
        return self.tables[name]

    def swap(self, tables: dict[str, Table]) -> None:
        stay = {id(t) for t in tables.values()}
        for t in self.tables.values():
            if id(t) not in stay:
                t.source.drop()
                if t.loaded:
                    t.source.frame.unpersist()
        self.tables, self.generation = tables, self.generation + 1


def read_bounded(path: Path, most: int) -> bytes:
    try:
        with open(path, "rb") as f:
            raw = f.read(most + 1)
    except OSError as e:
        raise EngineError("IO", f"cannot read {path}: {e.strerror}") from None
    if len(raw) > most:
        raise EngineError("RESOURCE", f"{path} exceeds {most} bytes")
    return raw


def nesting(raw: bytes) -> int:
    """How deep brackets outside strings nest."""
    deep = most = 0
    for m in re.finditer(rb'"(?:[^"\\]|\\.)*"?|[\[{]|[\]}]', raw, re.S):
        t = m.group()
        if t in b"[{":
            deep += 1
            most = max(most, deep)
        elif t in b"]}":
            deep -= 1
    return most


def bounded_json(raw: bytes, code: str):
    if nesting(raw) > MOST_NESTING:
        raise EngineError("RESOURCE", f"JSON nesting exceeds {MOST_NESTING}")
    try:
        return json.loads(raw.decode("utf-8"))
    except (UnicodeDecodeError, ValueError) as e:
        raise EngineError(code, f"invalid JSON: {e}") from None


def _identifier(name: object) -> str:
    if not isinstance(name, str) or not _IDENTIFIER.fullmatch(name):
        raise EngineError("CATALOG", f"not an identifier: {name}")
    return name.lower()


@dataclass(frozen=True)
class Spec:
    """A table of a manifest."""

    name: str
    path: Path
    names: list[str]
    kinds: list[Type]
    nullable: list[bool]


def specs(path: Path) -> list[Spec]:
    """The tables that a manifest describes, checked as far as that goes without their files."""
    found: list[Spec] = []
    try:
        for t in bounded_json(read_bounded(path, MOST_MANIFEST), "CATALOG")["tables"]:
            name = _identifier(t["name"])
            if any(name == s.name for s in found):
                raise EngineError("CATALOG", f"duplicate table: {name}")
            place = PurePosixPath(t["path"])
            if place.is_absolute() or ".." in place.parts:
                raise EngineError("CATALOG", f"a path must be relative and stay below the manifest: {place}")
            names = [_identifier(c["name"]) for c in t["columns"]]
            if not 1 <= len(names) <= MOST_COLUMNS or len(set(names)) != len(names):
                raise EngineError("CATALOG", f"table {name} needs 1 to {MOST_COLUMNS} columns of different names")
            kinds, nullable = [Type(c["type"]) for c in t["columns"]], [c["nullable"] for c in t["columns"]]
            if not all(isinstance(x, bool) for x in nullable):
                raise EngineError("CATALOG", "nullable must be true or false")
            found.append(Spec(name, path.parent / place, names, kinds, nullable))
    except (KeyError, TypeError, ValueError) as e:
        raise EngineError("CATALOG", f"invalid manifest: {e}") from None
    return found


def load_manifest(spark: SparkSession, path: str | Path, most_bytes: int) -> dict[str, Table]:
    """All tables of a manifest; nothing is changed, and nothing stays, if one of them fails."""
    tables: dict[str, Table] = {}
    try:
        for spec in specs(Path(path)):
            tables[spec.name] = _load(spark, spec, most_bytes - sum(t.bytes for t in tables.values()))
    except EngineError:
        for t in tables.values():
            t.source.frame.unpersist()
        raise
    return tables


#: What a cell takes at least, as memory is accounted for; a STRING takes its bytes too.
CELL_BYTES = {Type.INT64: 8, Type.DOUBLE: 8, Type.BOOL: 1, Type.STRING: 4}
RANGE = 8 << 20
_WRONG = "__wrong"


def _load(spark: SparkSession, spec: Spec, most_bytes: int) -> Table:
    """Parses a file in byte ranges on the executors, which must see its path; the rows stay cached there.

    The limit on bytes is checked before any record is parsed, by the number of records, and again when all are.
    """
    try:
        size = spec.path.stat().st_size
        with open(spec.path, "rb"):
            pass
    except OSError as e:
        raise EngineError("IO", f"cannot read {spec.path}: {e.strerror}") from None
    file, row_bytes = str(spec.path.absolute()), 8 + sum(CELL_BYTES[k] for k in spec.kinds)
    ranges = [(start, min(start + RANGE, size)) for start in range(0, max(size, 1), RANGE)]
    begins = [(0, False)]  # of each range: records that begin before it, and whether a quote is open before its first byte
    if len(ranges) > 1:
        begins += _begins(spark, file, ranges)
        if begins[-1][0] * row_bytes > most_bytes:
            raise EngineError("RESOURCE", f"table {spec.name} exceeds the memory limit")
    names, kinds, nullable = spec.names, spec.kinds, spec.nullable
    arrow = [*(_ARROW[k] for k in kinds), pa.int64(), pa.string()]
    columns = [*names, ROW_NUMBER, _WRONG]

    def parse(batches):
        for b in batches:
            for start, stop, before, quoted in zip(*(b[c].to_pylist() for c in ("start", "stop", "before", "quoted")), strict=True):
                lead = min(start, 1)  # the byte before tells whether a record begins right here
                with open(file, "rb") as f:
                    f.seek(start - lead)
                    raw = f.read(stop - start + lead + csvfile.MOST_RECORD + 2)
                end = stop - start + lead
                at = csvfile.first_record(raw, 0, end - 1, quoted) if start else 0
                if at is None:
                    continue
                cells, wrong = csvfile.parsed(raw, names, kinds, nullable, at, before, end)
                n, header = len(cells[0]), int(before == 0)
                rows = pa.array(range(before + header - 1, before + header - 1 + n), pa.int64())
                for i in range(0, n, 65536):
                    yield pa.RecordBatch.from_arrays([*(pa.array(c[i : i + 65536], t) for c, t in zip(cells, arrow, strict=False)), rows.slice(i, 65536), pa.nulls(min(65536, n - i), pa.string())], columns)
                if wrong:
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in arrow[:-2]), pa.array([start]), pa.array([json.dumps(wrong)])], columns)

    from pyspark.sql import types as T

    schema = T.StructType([*(T.StructField(n, k.spark) for n, k in zip(names, kinds, strict=True)), T.StructField(ROW_NUMBER, T.LongType()), T.StructField(_WRONG, T.StringType())])
    work = [(start, stop, before, quoted) for (start, stop), (before, quoted) in zip(ranges, begins, strict=True)]
    frame = spark.createDataFrame(work, "start long, stop long, before long, quoted boolean").repartition(len(work)).mapInArrow(parse, schema).persist()
    texts = sum((F.coalesce(F.octet_length(n), F.lit(0)) for n, k in zip(names, kinds, strict=True) if k is Type.STRING), F.lit(0).cast("long"))
    wrong = F.min(F.when(F.col(_WRONG).isNotNull(), F.struct(ROW_NUMBER, _WRONG)))
    found = frame.agg(F.count(F.when(F.col(_WRONG).isNull(), 1)).alias("rows"), F.sum(texts).alias("texts"), wrong.alias("wrong")).first()
    held = max(1, found["rows"] * row_bytes + (found["texts"] or 0))
    if found["wrong"] or held > most_bytes:
        frame.unpersist()
        if found["wrong"]:  # that of the first range that has one
            raise csvfile.fault(spec.path.name, *json.loads(found["wrong"][_WRONG]))
        raise EngineError("RESOURCE", f"table {spec.name} exceeds the memory limit")
    return Table(list(zip(names, kinds, strict=True)), Source(frame, names, True), found["rows"], held, True)


def _begins(spark: SparkSession, file: str, ranges: list[tuple[int, int]]) -> list[tuple[int, bool]]:
    """For each range but the first, from three numbers of each that comes before it."""

    def count(batches):
        for b in batches:
            rows = []
            for start, stop in zip(b["start"].to_pylist(), b["stop"].to_pylist(), strict=True):
                lead = min(start, 1)
                with open(file, "rb") as f:
                    f.seek(start - lead)
                    rows.append((start, *csvfile.ends(f.read(stop - start + lead - 1))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["start", "quotes", "free", "other"])

    df = spark.createDataFrame(ranges, "start long, stop long").repartition(len(ranges)).mapInArrow(count, "start long, quotes long, free long, other long")
    out, records, quoted = [], 1, False
    for r in sorted(df.collect())[:-1]:  # one row for each 8 MB of the file
        records += r["other"] if quoted else r["free"]
        quoted ^= bool(r["quotes"] % 2)
        out.append((records, quoted))
    return out


def registered(df: DataFrame) -> Table:
    """A table of a DataFrame: columns of types that the dialect lacks are dropped, narrow ones widened."""
    kinds = {f.name: k for f in df.schema.fields if (k := logical(f.dataType)) is not None}
    if len({n.lower() for n in kinds}) != len(kinds) or not kinds:
        raise EngineError("CATALOG", "a table needs columns of different names")
    plain = df.select(*(F.col(f"`{n}`").cast(k.spark).alias(n.lower()) for n, k in kinds.items()))
    names = [n.lower() for n in kinds]
    return Table(list(zip(names, kinds.values(), strict=True)), Source(plain, names, False))
