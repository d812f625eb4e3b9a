"""The command line: query, explain, session, demo and bench.

Each command has a parser of its own, made of shared groups of flags, and a function; the parser turns every misuse
into an error with the code CLI.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import dataclass, replace
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import SparkSession

from veltra.engine import MEMORY_LIMIT, RESULT_LIMIT, Engine
from veltra.errors import EngineError
from veltra.plans.rewrite import Options
from veltra.plans.syntax import MOST_SQL_BYTES
from veltra.sources.catalog import bounded_json, read_bounded
from veltra.sources.sinks import plan_dict, result_dict, table_text

MOST_REQUEST = 128 << 10


def session_of() -> SparkSession:
    """Small local defaults; a master that is set elsewhere (spark-submit) stays."""
    b = SparkSession.builder.appName("veltra").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    spark = b.config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# ---------------------------------------------------------------- options


class Setting(NamedTuple):
    """An execution option: which values it takes, and what they are stored as."""

    takes: Callable[[object], bool]
    says: str
    stored: Callable[[object], object] = lambda v: v


def _one_of(*words: str) -> Setting:
    return Setting(lambda v: isinstance(v, str) and v in words, " or ".join(words))


_SWITCH = Setting(lambda v: isinstance(v, str) and v in ("on", "off"), "on or off", lambda v: v == "on")
SWITCHES = ("optimizer", "prune", "pushdown", "fold", "join_reorder")
SETTINGS: dict[str, Setting] = {
    "engine": _one_of("scalar", "vector"),
    "build_side": _one_of("auto", "left", "right"),
    "batch_size": Setting(lambda v: type(v) is int and 1 <= v <= 65536, "a whole number from 1 to 65536"),
    "profile": Setting(lambda v: type(v) is bool, "true or false"),
    **dict.fromkeys(SWITCHES, _SWITCH),
}


def merged(options: Options, given: object) -> Options:
    """``options`` with those given; all are checked before any counts."""
    if not isinstance(given, dict):
        raise EngineError("PROTOCOL", "options come as an object")
    if strange := [k for k in given if k not in SETTINGS]:
        raise EngineError("PROTOCOL", f"no option is called {strange[0]}")
    for k, v in given.items():
        if not SETTINGS[k].takes(v):
            raise EngineError("CLI", f"{k} takes {SETTINGS[k].says}")
    return replace(options, **{k: SETTINGS[k].stored(v) for k, v in given.items()})


# ---------------------------------------------------------------- flags


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise EngineError("CLI", f"{self.prog}: {message}")


class _Once(argparse.Action):
    """A flag that may come once; ``const`` is its value if it takes none."""

    def __call__(self, parser, found, values, flag=None):
        if self.dest in found.given:
            parser.error(f"{flag} is given twice")
        found.given.add(self.dest)
        setattr(found, self.dest, values if self.nargs is None else self.const)


def whole(text: str) -> int:
    if not (text.isascii() and text.isdigit()):
        raise argparse.ArgumentTypeError(f"{text!r} is no whole number")
    return int(text)


def _bare(p: _Parser, flag: str, text: str) -> None:
    p.add_argument(flag, action=_Once, nargs=0, const=True, default=False, help=text)


def _catalog(p: _Parser) -> None:
    p.add_argument("--catalog", action=_Once, required=True, metavar="PATH", help="the manifest of the tables")
    p.add_argument("--memory-limit", action=_Once, type=whole, default=MEMORY_LIMIT, metavar="BYTES")
    p.add_argument("--result-limit", action=_Once, type=whole, default=RESULT_LIMIT, metavar="ROWS")


def _execution(p: _Parser) -> None:
    for name in ("engine", "build_side", *SWITCHES):
        p.add_argument("--" + name.replace("_", "-"), action=_Once, metavar=SETTINGS[name].says.replace(" or ", "|"))
    p.add_argument("--batch-size", action=_Once, type=whole, metavar="ROWS")
    _bare(p, "--profile", "measure rows and times of every stage")


def _statement(p: _Parser) -> None:
    text = p.add_mutually_exclusive_group(required=True)
    text.add_argument("--sql", action=_Once, metavar="TEXT")
    text.add_argument("--sql-file", action=_Once, metavar="PATH")
    p.add_argument("--format", action=_Once, choices=("table", "json"), default="table")


@dataclass(frozen=True)
class Command:
    run: Callable[[argparse.Namespace, object], None]
    says: str
    flags: tuple[Callable[[_Parser], None], ...] = ()

    def parse(self, name: str, argv: list[str]) -> argparse.Namespace:
        p = _Parser(prog=f"veltra {name}", description=self.says, add_help=False, allow_abbrev=False)
        for group in self.flags:
            group(p)
        if "--help" in argv:
            return argparse.Namespace(help=p.format_help())
        return p.parse_args(argv, argparse.Namespace(given=set(), help=None))


def options_of(found: argparse.Namespace) -> Options:
    return merged(Options(), {k: getattr(found, k) for k in SETTINGS if k in found.given})


def engine_of(found: argparse.Namespace) -> Engine:
    engine = Engine(session_of(), found.memory_limit, found.result_limit)
    engine.load_catalog(found.catalog)
    return engine


def statement_of(found: argparse.Namespace) -> str:
    return found.sql if found.sql is not None else read_bounded(Path(found.sql_file), MOST_SQL_BYTES).decode("utf-8", "strict")


def line(out, value: dict) -> None:
    out.write(json.dumps(value, ensure_ascii=False) + "\n")


# ---------------------------------------------------------------- commands


def query(found: argparse.Namespace, out) -> None:
    options = options_of(found)
    result = engine_of(found).query(statement_of(found), options)
    if found.format == "json":
        line(out, result_dict(result))
    else:
        out.write(table_text(result))


def explain(found: argparse.Namespace, out) -> None:
    options = options_of(found)
    engine, sql = engine_of(found), statement_of(found)
    shown = plan_dict(engine.explain(sql, options))
    if found.analyze:
        shown["result"] = result_dict(engine.query(sql, replace(options, profile=True)))
    line(out, shown)


def session(found: argparse.Namespace, out) -> None:
    options = options_of(found)
    serve(engine_of(found), options, sys.stdin.buffer, out)


def demo(found: argparse.Namespace, out) -> None:
    here = Path(__file__).parent / "examples"
    engine = Engine(session_of())
    engine.load_catalog(here / "catalog.json")
    out.write(table_text(engine.query((here / "query.sql").read_text())))


def bench(found: argparse.Namespace, out) -> None:
    from veltra import benchmark

    benchmark.run(Path(found.manifest), found.validate_only, out)


def _analyze(p: _Parser) -> None:
    _bare(p, "--analyze", "run the query too, with --profile")


def _stdio(p: _Parser) -> None:
    p.add_argument("--stdio", action=_Once, nargs=0, const=True, required=True, help="requests and responses are JSON lines")


def _manifest(p: _Parser) -> None:
    p.add_argument("--manifest", action=_Once, required=True, metavar="PATH", help="what to measure")
    _bare(p, "--validate-only", "show each case's result instead")


COMMANDS = {
    "query": Command(query, "Run a statement.", (_catalog, _statement, _execution)),
    "explain": Command(explain, "Show the plans of a statement.", (_catalog, _statement, _execution, _analyze)),
    "session": Command(session, "Answer one JSON request a line.", (_catalog, _execution, _stdio)),
    "demo": Command(demo, "Run the example query over the example catalog."),
    "bench": Command(bench, "Measure the cases of a manifest.", (_manifest,)),
}


# ---------------------------------------------------------------- sessions


def answer(engine: Engine, options: Options, raw: bytes) -> dict:
    """The response to one request; whatever is wrong with it is a response too."""
    echo = {}
    try:
        if len(raw) > MOST_REQUEST:
            raise EngineError("RESOURCE", f"a request has at most {MOST_REQUEST} bytes")
        request = bounded_json(raw, "PROTOCOL")
        known = isinstance(request, dict) and request.keys() <= {"id", "sql", "options"}
        if isinstance(request, dict) and "id" in request:
            echo = {"id": request["id"]}
        if not known or not isinstance(request.get("sql"), str):
            raise EngineError("PROTOCOL", "a request is an object with sql, and maybe id and options")
        return echo | result_dict(engine.query(request["sql"], merged(options, request.get("options", {}))))
    except EngineError as e:
        return echo | e.as_dict()


def requests(source):
    """Lines without their ends; of a line that is too long, enough to see that it is."""
    kept = b""
    while part := source.readline(MOST_REQUEST + 1):
        kept = (kept + part)[: MOST_REQUEST + 1]
        if part.endswith(b"\n"):
            yield kept.rstrip(b"\r\n") if len(kept) <= MOST_REQUEST else kept
            kept = b""
    if kept:
        yield kept


def serve(engine: Engine, options: Options, source, sink) -> None:
    for raw in requests(source):
        line(sink, answer(engine, options, raw))
        sink.flush()


# ---------------------------------------------------------------- entry


def usage() -> str:
    return "usage: python -m veltra COMMAND [flags]; COMMAND --help lists the flags\n" + "".join(f"  {n:<9}{c.says}\n" for n, c in COMMANDS.items())


def run(argv: list[str], out=sys.stdout) -> int:
    name, *rest = argv or ["--help"]
    if name in ("--help", "help"):
        out.write(usage())
        return 0
    if name not in COMMANDS:
        raise EngineError("UNSUPPORTED", f"{name} is none of {', '.join(COMMANDS)}")
    found = COMMANDS[name].parse(name, rest)
    if found.help is not None:
        out.write(found.help)
    else:
        COMMANDS[name].run(found, out)
    return 0


def main() -> int:
    try:
        return run(sys.argv[1:])
    except EngineError as e:
        failure = e
    except Exception as e:  # noqa: BLE001  a caller reads one JSON error, whatever went wrong
        failure = EngineError("INTERNAL", str(e))
    line(sys.stdout, failure.as_dict())
    return 1
