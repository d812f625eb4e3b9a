"""What several training-data operators share: staged tables, word hashes, token ids, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space, as ``bytes.split()`` sees them.
WORD = r"[^\x20\x09-\x0D]+"
#: While a table is staged: shuffle files go when it is written, and Arrow batches of whole texts stay small.
STAGED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


# ---------------------------------------------------------------- staged tables


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``, which the driver and all executors see.

    Only a local session may lack the setting; it gets a folder of its own then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="veltra-")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + root if spark.sparkContext.master.startswith("local") else root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and rereads it: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = {k: spark.conf.get(k, None) for k in STAGED}
    for k, v in STAGED.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """For results that are run later: Arrow batches of at most 8 MB, unless the session asks for another size than Spark does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, str(8 << 20))


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a staged table when its last reader is done. Tables that stay go with ``spark.checkpoint.dir``."""
    jvm = spark.sparkContext._jvm
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def file_system(uri: str):
    """A pyarrow file system and the path in it: local, HDFS or an object store, by the scheme of ``uri``."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


# ---------------------------------------------------------------- words


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64 on 64-bit integers: one hash for each value and seed."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: ASCII white space, as a table over bytes.
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BASE = 0x9E3779B97F4A7C15
_LETTER = mix(np.arange(256, dtype=np.uint64), 99)  # what a byte adds to its word's hash
_powers: list[np.ndarray] = []


def _powers_of_base(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse; the longest asked for are kept."""
    if not _powers or len(_powers[0]) < n:
        most = max(1 << 16, 1 << (n - 1).bit_length())
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(most, base, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0][:n], _powers[1][:n]


def word_hashes(raw: bytes, step: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of all words of a text, in order, without an object for each word.

    A word's hash is a polynomial of its bytes, taken as a difference of running sums, then mixed. The text is
    worked through in steps that end between words, so memory does not follow the longest text.
    """
    found = []
    at = 0
    while at < len(raw):
        end = min(len(raw), at + step)
        if end < len(raw):  # move to the end of the word
            tail = re.compile(rb"[\x20\x09-\x0D]").search(raw, end)
            end = tail.start() if tail else len(raw)
        u = np.frombuffer(raw, np.uint8, end - at, at)
        edge = np.flatnonzero(np.diff(BLANK[u], prepend=True, append=True))
        s, e = edge[::2], edge[1::2]
        up, down = _powers_of_base(len(u))
        sums = np.zeros(len(u) + 1, np.uint64)
        np.cumsum(_LETTER[u] * up, out=sums[1:])
        found.append(mix((sums[e] - sums[s]) * down[s]))
        at = end
    if len(_powers) and len(_powers[0]) > 4 * step:  # a word of many megabytes
        _powers[:] = []
    return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words; shorter texts with a word have one, of all their words."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i]
    return mix(out, n)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256, most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most so many rows and bytes of text each (a longer text comes alone)."""
    for b in batches:
        size = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        end = np.cumsum(size)
        at = 0
        while at < b.num_rows:
            before = int(end[at - 1]) if at else 0
            n = int(np.searchsorted(end, before + most_bytes, "right")) - at
            n = max(1, min(n, rows))
            yield b.slice(at, n)
            at += n


# ---------------------------------------------------------------- token ids

#: White space beyond ASCII, as the byte-level pre-tokenizer sees it.
_WIDE_SPACE = "\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Classes of bytes for cutting texts into pieces: white space, letters, digits, apostrophe, other ASCII, other bytes.
_SPACE, _LETTER_BYTE, _DIGIT, _APOSTROPHE, _SIGN, _OTHER = range(6)


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[:128] = _SIGN
    for c, kind in (("\t\n\x0b\x0c\r ", _SPACE), ("'", _APOSTROPHE), ("0123456789", _DIGIT)):
        kinds[list(c.encode())] = kind
    kinds[[b for b in range(128) if chr(b).isalpha()]] = _LETTER_BYTE
    return kinds


_KIND = _byte_classes()


class TokenIds(dict):
    """Ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit numbers.

    A pre-token of the byte-level kind never crosses from a non-space to a space, between a single line end and what
    follows it, between letters and digits, from a letter or digit to another ASCII character, or from one of these,
    but for the apostrophe, to a letter or digit. Texts are cut there, all at once; each distinct piece is encoded once
    and remembered, and the ids of the pieces in order are those of the text. A word of plain letters is one pre-token
    and goes to the library's model without another search for pre-tokens; a text that holds an added token of the
    tokenizer's, or white space beyond ASCII, is encoded by the library as a whole. Two generations of at most ``most``
    pieces are remembered: when the younger is full, the older is forgotten; long pieces are not remembered.
    """

    LONG = 40

    def __init__(self, path: str, most: int = 600_000):
        super().__init__()
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.apart = re.compile("|".join([f"[{_WIDE_SPACE}]", *map(re.escape, added)])).search
        self.hints = [x.encode() for x in added] + [bytes([b]) for b in (0xC2, 0xE1, 0xE2, 0xE3)]  # what begins white space beyond ASCII
        self.most, self.older = most, {}
        # byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in plain]
        as_char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.space = as_char[32]
        # letters that two bytes hold, C3 80 to C3 BF, but for the signs of multiplication and division; what stands for
        # their first byte is such a letter itself, and so comes first
        letters = sorted((c for c in map(chr, range(0xC0, 0x100)) if c.isalpha()), key=lambda c: c != as_char[0xC3])
        self.wide = [(c, "".join(as_char[b] for b in c.encode())) for c in letters]

    def _cut(self, raw: bytes, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin in texts put end to end, and whether each is a word of plain letters, maybe behind a space."""
        u = np.frombuffer(raw, np.uint8)
        kind = _KIND[u]
        lead = np.flatnonzero(u[:-1] == 0xC3)
        second = u[lead + 1]
        lead = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER_BYTE
        before, now = kind[:-1], kind[1:]
        cut = np.zeros(len(u), bool)
        letter, digit, space = kind == _LETTER_BYTE, kind == _DIGIT, kind == _SPACE
        sign = kind == _SIGN
        change = (now != before) & (before != _OTHER) & (now != _OTHER) & (before != _APOSTROPHE)
        word = letter | digit
        cut[1:] = change & (word[:-1] | (sign[:-1] & word[1:]))
        cut[1:] |= space[1:] & ~space[:-1]
        ends = np.flatnonzero(u == 10)
        ends = ends[(ends > 0) & (ends < len(u) - 1)]
        cut[ends[~space[ends - 1] & ~space[ends + 1]] + 1] = True
        cut[begins] = True
        starts = np.flatnonzero(cut)
        behind = u[starts] == 32
        odd = np.concatenate([[0], np.cumsum(~letter)])
        stops = np.append(starts[1:], len(u))
        return starts, (odd[stops] - odd[starts] == behind) & (stops - starts > behind)

    def _learned(self, pieces: list[bytes], plain: list[bool]) -> list[bytes]:
        """The ids of distinct pieces; what is new is encoded and remembered."""
        found = list(map(self.get, pieces))
        missing = [i for i, v in enumerate(found) if v is None]
        old = self.older.get
        new = []
        for i in missing:
            v = found[i] = old(pieces[i])
            if v is None:
                new.append(i)
        words = [i for i in new if plain[i]]
        mapped = b"\n".join([pieces[i] for i in words]).decode().replace(" ", self.space)
        if not mapped.isascii():
            for c, as_bytes in self.wide:
                mapped = mapped.replace(c, as_bytes)
        tokenize = self.model.tokenize
        for i, w in zip(words, mapped.split("\n"), strict=False):
            found[i] = array("I", [x.id for x in tokenize(w)]).tobytes()
        for i in new:
            if found[i] is None:
                found[i] = self._whole(pieces[i].decode())
        if len(self) + len(missing) > self.most:
            self.older = dict(self)
            self.clear()
        self.update((pieces[i], found[i]) for i in missing if len(pieces[i]) <= self.LONG)
        return found

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and how many each has."""
        raws = [t.encode() if t else b"" for t in texts]
        raw = b"".join(raws)
        apart: dict[int, np.ndarray] = {}
        if any(x in raw for x in self.hints):
            apart = {i: np.frombuffer(self._whole(t), "<u4") for i, t in enumerate(texts) if t and self.apart(t)}
            raws = [b"" if i in apart else x for i, x in enumerate(raws)]
            raw = b"".join(raws)
        sizes = np.zeros(len(texts), np.int64)
        ids = np.zeros(0, np.uint32)
        if raw:
            size = np.fromiter(map(len, raws), np.int64, len(raws))
            begin = np.cumsum(size) - size
            starts, plain = self._cut(raw, begin[size > 0])
            offsets = np.append(starts, len(raw)).astype(np.int32)
            pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
            which = pieces.indices.to_numpy()
            first = np.empty(len(pieces.dictionary), np.int64)
            first[which[::-1]] = np.arange(len(which))[::-1]
            known = self._learned(pieces.dictionary.to_pylist(), plain[first].tolist())
            n = np.fromiter(map(len, known), np.int64, len(known)) // 4
            every = np.frombuffer(b"".join(known), "<u4")
            count = n[which]
            end = np.cumsum(count)
            ids = every[np.repeat((np.cumsum(n) - n)[which] - (end - count), count) + np.arange(int(end[-1]))]
            whose = np.searchsorted(starts, begin + size)  # pieces before the end of each text
            until = np.concatenate([[0], end])[whose]
            sizes = np.diff(until, prepend=0)
        if apart:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i, x in apart.items():
                parts[i], sizes[i] = x, len(x)
            ids = np.concatenate(parts)
        return ids, sizes

    def of(self, texts: list[str | None]) -> list[bytes]:
        ids, sizes = self.flat(texts)
        end = np.cumsum(sizes).tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *end], end, strict=False)]

    def forget(self) -> None:
        self.clear()
        self.older = {}


_own: dict = {}


def token_ids(path: str) -> TokenIds:
    """This Python process's ids for a tokenizer file: they outlive tasks, so a worker learns a piece once."""
    if ("ids", path) not in _own:
        _own["ids", path] = TokenIds(path)
    return _own["ids", path]


def release() -> None:
    """Gives freed memory of this Python process back to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(batches_of, keep_ids: bool = False):
    """A task function that gives freed memory back to the system at its end: workers wait idle beside later stages.

    Pieces that a worker has learned for token ids stay only between tasks that ask for it.
    """
    import functools

    def forget() -> None:
        for x in _own.values():
            x.forget()

    @functools.wraps(batches_of)
    def run(batches):
        if not keep_ids and _own:
            forget()
            release()
        try:
            yield from batches_of(batches)
        finally:
            release()

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- connected components


def components(links: DataFrame) -> DataFrame:
    """Smallest id reachable from each id of ``links`` (a, b): rows (id, component) for ids with a link.

    Alternates large-star and small-star steps, each a pre-aggregated minimum and a join, over tables in the
    shared folder, until nothing changes. No links or labels go to the driver, only a count and a checksum.
    """
    spark = links.sparkSession
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = staged(e, "links")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join below may split a hub's rows over tasks
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lows")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        to_low = large.join(own, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = to_low.unionByName(own.select("u", F.col("m").alias("v"))).distinct()
        nxt = staged(small, "links")
        removed(spark, low)
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        removed(spark, e)
        e = nxt
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
