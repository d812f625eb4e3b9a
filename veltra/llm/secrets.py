"""Secret scans with DataFrame functions only: fixed patterns, and windows of high Shannon entropy.

Base kinds (leftmost, non-overlapping per kind): ``assign`` (a keyword, a separator and a value of 6 or more
characters), ``access`` (access key ids of 20 or more characters) and ``hex`` (runs of 24 or more hex digits).
The method adds ``entropy_...`` spans: over every candidate string, a window slides by one character, the counts of
the character entering and leaving change, and with them the sum of ``n log2 n`` from which the window's entropy
follows. Runs of windows at or over the class's threshold become spans, unless an allow-list pattern covers the
whole candidate or the candidate is an allowed string. A small alphabet bounds the entropy of a window, so each has
its class and threshold: ``hex`` in either case, ``one_case`` (digits and letters of one case, base32 among them),
``base62`` (digits and letters of both cases) and ``text`` (whole candidates that are not all hex). The first three
look at the longest runs of their characters in a candidate, so that ``key_`` before a key hides nothing; a run that
is allowed by itself counts as words or digits. Spans of different classes may overlap.

Offsets count code points, end exclusive. Positions come from the texts between matches, so no match is looked
up again. All steps take time in proportion to the text, and no pattern repeats a group, which Java's matcher would
follow on its stack (patterns given as ``allowed`` should not either), so a text may have any length. Edge cases: a null text counts as empty and has no spans; rows with equal or null ids are scanned one
by one; other columns pass through ``scan``; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in order, each with its pattern and what a match must hold.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_text", "entropy_one_case", "entropy_base62")

#: Character classes of candidates, their windows and thresholds in bits.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
HEX_ALPHABET = "0123456789abcdefABCDEF"
TEXT_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW, HEX_BITS, TEXT_BITS = 20, 3.0, 3.9
#: Of random keys of 20 characters, one in 200 or fewer have no such window.
ONE_CASE_BITS, BASE62_BITS = 3.25, 3.5
UPPER, LOWER, BASE62 = TEXT_ALPHABET[:26] + TEXT_ALPHABET[52:62], TEXT_ALPHABET[26:62], TEXT_ALPHABET[:62]
#: Each class of runs: its name, the runs in a candidate, what a run must hold, and its alphabet.
RUNS = (
    ("hex", r"[0-9a-fA-F]{20,}", r"", HEX_ALPHABET),
    ("one_case", r"[A-Z0-9]{20,}", r"[G-Z]", UPPER),
    ("one_case", r"[a-z0-9]{20,}", r"[g-z]", LOWER),
    ("base62", r"[A-Za-z0-9]{20,}", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).*[g-zG-Z]", BASE62),
)

#: Whole candidates that are no secrets: UUIDs, words with separators, digits, paths, rulers.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[A-Za-z][A-Za-z+/_=-]*",
    r"[0-9+/_=-]+",
    r"(?!.*//)(?=.*[a-z0-9_-]/)[a-z0-9_/-]+",
    r"[A-Z]?[a-z]+[0-9]{0,4}",
)

BLOCK = 512  # values that one fold gathers: a fold that appends copies its array each time
SEGMENT = 1024  # windows that one pass slides over
CHUNK = 4096  # code points of a text cut for redaction


# ---------------------------------------------------------------- array functions in linear time


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also inside of other lambdas."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine, zero: int = 0) -> Column:
    """For each number of an array what ``combine`` makes of all before it, beginning with ``zero``: folds of blocks,
    begun with what a fold over the blocks' totals gives."""
    start = F.lit(zero).cast("bigint")
    state = lambda at: F.struct(at.alias("at"), F.array().cast("array<bigint>").alias("out"))
    gather = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    fold = lambda part, at: F.aggregate(part, state(at), gather, lambda acc: acc["out"])
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / BLOCK).cast("int")), lambda i: F.slice(v, i * BLOCK + 1, F.lit(BLOCK)))
    totals = lambda blocks: F.transform(blocks, lambda part: F.aggregate(part, start, combine))
    return let(cut(values), lambda blocks: F.flatten(F.zip_with(blocks, fold(totals(blocks), start), fold)))


def matches(text: Column, pattern: str) -> Column:
    """An array of (start, end, found) for the leftmost non-overlapping matches of a pattern that is never empty."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    number = lambda c: F.length(c).cast("bigint")

    def placed(both: Column) -> Column:
        """Spans follow from the lengths of the matches and of what stands between them."""
        gaps, hits = both["gaps"], both["found"]
        before = running(F.zip_with(gaps, hits, lambda g, m: number(g) + number(m)), lambda x, y: x + y)
        starts = F.zip_with(before, gaps, lambda at, g: at + number(g))
        return F.zip_with(starts, hits, lambda at, m: F.struct(at.alias("start"), (at + number(m)).alias("end"), m.alias("found")))

    gaps = lambda hits: F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    spans = let(found, lambda hits: let(F.struct(gaps(hits).alias("gaps"), hits.alias("found")), placed))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,found:string>>"))


def _spans(found: Column, kind: str, rank: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


# ---------------------------------------------------------------- entropy


def entropy_runs(s: Column, alphabet: str, window: int, bits: float) -> Column:
    """Spans of ``s``, a string of characters of ``alphabet``, covered by windows whose entropy reaches ``bits``: an
    array of (from, to).

    The counts of a window's characters are packed into a few 64-bit numbers. As the window slides, the character
    that enters adds one to its count, the one that leaves takes one away, and the sum of n log2 n changes by what
    these two counts say. Long strings are slid over in segments of windows; runs that touch are put together.
    """
    width = window.bit_length()  # bits of a count
    per = 62 // width
    n_cells = -(-len(alphabet) // per)
    rows = [F.struct(F.lit(j // per).alias("cell"), F.lit(j % per * width).alias("shift"), F.lit(1 << (j % per * width)).cast("bigint").alias("one")) for j in range(len(alphabet))]
    place = F.array(*rows)
    log = lambda n: n * math.log2(n) if n else 0.0
    gain = F.array(*[F.lit(log(n + 1) - log(n)) for n in range(window + 1)])  # by which the sum grows with a count of n
    most = F.lit(window * (math.log2(window) - bits) + 1e-7)
    none = F.array().cast("array<struct<from:int,to:int>>")
    minus = F.lit(-1)
    run = lambda a, b: F.struct(a.cast("int").alias("from"), b.cast("int").alias("to"))
    cells = [f"c{j}" for j in range(n_cells)]

    def slide(codes: Column) -> Column:
        """The runs of a segment: ``codes`` has the place of each character's count."""
        zero = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in cells], F.lit(0.0).alias("sum"), minus.alias("from"), minus.alias("to"), none.alias("out"))

        def count(acc: Column, at: Column) -> Column:
            held = F.coalesce(*[F.when(at["cell"] == j, acc[c]) for j, c in enumerate(cells)])
            return F.call_function("shiftright", held, at["shift"]).bitwiseAND(F.lit((1 << width) - 1)).cast("int")

        def step(acc: Column, i: Column) -> Column:
            into, out = F.get(codes, i - 1), F.get(codes, i - 1 - window)
            # the state is that of the window before: i - 1 characters have entered
            full = (i > window) & (acc["sum"] <= most)
            begin = i - 1 - window
            apart = full & (acc["to"] >= 0) & (acc["to"] < begin)
            change = F.when(out.isNull(), F.element_at(gain, count(acc, into) + 1)).when((into["cell"] == out["cell"]) & (into["shift"] == out["shift"]), F.lit(0.0)).otherwise(F.element_at(gain, count(acc, into) + 1) - F.element_at(gain, count(acc, out)))
            moved = [(acc[c] + F.when(into["cell"] == j, into["one"]).otherwise(F.lit(0)) - F.when(out["cell"] == j, out["one"]).otherwise(F.lit(0))).alias(c) for j, c in enumerate(cells)]
            return F.struct(
                *moved,
                (acc["sum"] + F.coalesce(change, F.lit(0.0))).alias("sum"),
                F.when(full & ((acc["to"] < 0) | (acc["to"] < begin)), begin).otherwise(acc["from"]).alias("from"),
                F.when(full, i - 1).otherwise(acc["to"]).alias("to"),
                F.when(apart, F.concat(acc["out"], F.array(run(acc["from"], acc["to"])))).otherwise(acc["out"]).alias("out"),
            )

        last = lambda acc: F.when(acc["to"] >= 0, F.concat(acc["out"], F.array(run(acc["from"], acc["to"])))).otherwise(acc["out"])
        return F.aggregate(F.sequence(F.lit(1), F.size(codes) + 1), zero, step, last)

    def joined(runs: Column) -> Column:
        """Runs that touch as one: where a run starts that no earlier one reaches, and where one ends before the next."""
        starts = F.filter(runs, lambda r, i: (i == 0) | (r["from"] > F.get(runs, i - 1)["to"]))
        ends = F.filter(runs, lambda r, i: (i == F.size(runs) - 1) | (F.get(runs, i + 1)["from"] > r["to"]))
        return F.zip_with(starts, ends, lambda a, b: run(a["from"], b["to"]))

    def segments(codes: Column) -> Column:
        each = lambda q: F.transform(slide(F.slice(codes, q * SEGMENT + 1, F.lit(SEGMENT + window - 1))), lambda r: run(r["from"] + q * SEGMENT, r["to"] + q * SEGMENT))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(codes) - window) / SEGMENT).cast("int")), each))

    codes = F.transform(F.split(s, "", -1), lambda c: F.element_at(place, F.instr(F.lit(alphabet), c)))
    return F.when(F.length(s) >= window, let(let(codes, segments), joined)).otherwise(none)


def entropy_spans(text: Column, allowed: tuple[str, ...] = ALLOWED, allowed_strings: tuple[str, ...] = (), window: int = WINDOW, hex_bits: float = HEX_BITS, text_bits: float = TEXT_BITS, one_case_bits: float = ONE_CASE_BITS, base62_bits: float = BASE62_BITS) -> Column:
    """Spans that the entropy of a candidate's windows gives, by class."""
    ok = lambda c: ~c["found"].rlike("^(?:" + "|".join(f"(?:{a})" for a in allowed) + ")$") & (~c["found"].isin(*allowed_strings) if allowed_strings else F.lit(True))
    bits = {"hex": hex_bits, "one_case": one_case_bits, "base62": base62_bits}

    def of(c: Column, found: Column, name: str, alphabet: str, least: float) -> Column:
        """Spans of the strings ``found`` in candidate ``c``."""
        kind = f"entropy_{name}"
        span = lambda x, r: F.struct((c["start"] + x["start"] + r["from"]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (c["start"] + x["start"] + r["to"]).alias("end"), F.lit(kind).alias("kind"))
        return F.flatten(F.transform(found, lambda x: F.transform(entropy_runs(x["found"], alphabet, window, least), lambda r: span(x, r))))

    def each(c: Column) -> Column:
        whole = F.filter(F.array(F.struct(F.lit(0).cast("bigint").alias("start"), c["found"].alias("found"))), lambda x: ~x["found"].rlike("^[0-9a-fA-F]+$"))
        runs = lambda pattern, holds: F.filter(matches(c["found"], pattern), lambda x: ok(x) & x["found"].rlike(holds))
        return F.concat(of(c, whole, "text", TEXT_ALPHABET, text_bits), *(of(c, runs(pattern, holds), name, alphabet, bits[name]) for name, pattern, holds, alphabet in RUNS))

    return F.flatten(F.transform(F.filter(matches(text, CANDIDATE), ok), each))


def scan(docs: DataFrame, text: str = "text", to: str = "secrets", **options) -> DataFrame:
    """``docs`` with a column ``to`` (replaced if there is one): an array of (start, rank, end, kind), by start, then kind as listed."""
    t = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(matches(t, ASSIGN), lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= 6)
    access = F.filter(matches(t, ACCESS), lambda x: x["end"] - x["start"] >= 20)
    base = F.concat(_spans(assign, "assign", 0), _spans(access, "access", 1), _spans(matches(t, HEX), "hex", 2))
    return docs.withColumn(to, F.array_sort(F.concat(base, entropy_spans(t, **options))))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, the number of spans of each base kind, the digest of the base spans and the list of all spans."""
    d = scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", **options).select("doc_id", "secrets")
    n = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda x: x["rank"] < 3)
    return d.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every secret span of the text replaced by ``mark``; overlapping spans become one. A null text stays null.

    What stays is cut from chunks of the text, so that a piece costs its own length and not that of the text before it.
    """
    d = scan(docs, text, "__secrets", **options)
    t = F.col(text)

    def cleared(x: Column) -> Column:
        spans, chunks = x["spans"], x["chunks"]

        def piece(a: Column, b: Column) -> Column:
            first, last = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
            near = F.array_join(F.slice(chunks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
            return F.when(b > a, F.substring(near, (a % CHUNK + 1).cast("int"), (b - a).cast("int"))).otherwise(F.lit(""))

        before = running(F.transform(spans, lambda r: r["end"]), lambda p, q: F.greatest(p, q))  # the furthest end before each span
        kept = F.filter(F.zip_with(before, spans, lambda p, r: F.struct(p.alias("from"), r["start"].alias("to"))), lambda k: k["to"] >= k["from"])
        tail = piece(F.array_max(F.transform(spans, lambda r: r["end"])), F.length(t).cast("bigint"))
        return F.array_join(F.concat(F.transform(kept, lambda k: piece(k["from"], k["to"])), F.array(tail)), mark)

    parts = F.struct(F.col("__secrets").alias("spans"), F.regexp_extract_all(t, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks"))
    return d.withColumn(text, F.when(F.size("__secrets") > 0, let(parts, cleared)).otherwise(t)).drop("__secrets")
