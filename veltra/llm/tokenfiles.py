"""Token ids in binary files: canonical, length-limited Huffman codes in blocks with bit-offset checkpoints.

Format (all little-endian). A file starts with ``MAGIC``, the number of ids n (u32) and n code lengths (u8,
0: unused), zlib-compressed behind their size (u32); canonical codes follow from the lengths. Then segments: five
u32 (documents, ids, ids in a block, blocks, payload bytes), doc_ids (i64; ``NO_ID`` for null), ids in each
document (u32), the first bit of each block (u32) and the payload, bits from the highest of each byte on. A block
decodes without the others, and many blocks decode side by side by table; the list of segments with their offsets
lets many tasks read one file. Codes have up to 16 bits, or more where more ids are in use than these can tell apart.

Files hold documents in ascending doc_id order, nulls first, and so does the sequence of files by first doc_id.
Edge cases: a null or empty text has only the end id; documents with equal ids all stay, in the order of their
ids' bytes; a table without rows gives no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veltra.llm.common import file_system, removed, shared_dir, slices, staged, tidy, token_ids

MAGIC = b"VLTHUF1\n"
NO_ID = -(2**63)


# ---------------------------------------------------------------- codes


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.float64)
    merged, is_leaf = leaves, np.ones(len(leaves), bool)
    levels = [is_leaf]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        merged, is_leaf = both[by], by < len(leaves)
        levels.append(is_leaf)
    take = 2 * len(leaves) - 2
    lengths = np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: ids by length, then value, get consecutive codes."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0].tolist():
        n = int(lengths[i])
        code <<= n - last
        codes[i], last = code, n
        code += 1
    return codes


def decoding_table(lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the next ``bits`` bits: the id they start with and its length."""
    ids, size = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.int64)
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    first = codes[used].astype(np.int64) << (bits - lengths[used].astype(np.int64))
    order = np.argsort(first)
    reach = (1 << (bits - lengths[used].astype(np.int64)))[order]
    full = np.repeat(used[order], reach)
    ids[: len(full)], size[: len(full)] = full, lengths[full]
    return ids, size


# ---------------------------------------------------------------- segments


def encoded(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int, step: int = 1 << 15) -> tuple[np.ndarray, bytes]:
    """The first bit of each block and the payload. Codes of at most 32 bits gather in words of 64, highest bit first.

    Ids are taken in steps that a processor's cache holds.
    """
    size = lengths[ids]
    total = int(size.sum(dtype=np.int64))
    out = np.zeros((total >> 6) + 2, np.uint64)
    first = np.zeros(-(-len(ids) // block), "<u4")
    begin = 0
    for i in range(0, len(ids), step):
        n = size[i : i + step].astype(np.int64)
        end = np.cumsum(n) + begin
        at = end - n
        word = at >> 6
        room = 64 - (at & 63) - n  # bits left in the word; below 0: the code goes on in the next
        code = codes[ids[i : i + step]].astype(np.uint64)
        over = np.flatnonzero(room < 0)
        here = code << np.maximum(room, 0).astype(np.uint64)
        here[over] = code[over] >> (-room[over]).astype(np.uint64)
        starts = np.flatnonzero(np.diff(word, prepend=-1))  # a code begins in every word
        out[int(word[0]) : int(word[-1]) + 1] |= np.bitwise_or.reduceat(here, starts)
        out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        lead = -i % block  # of the first block that begins in this step
        first[-(-i // block) : -(-min(i + step, len(ids)) // block)] = at[lead::block]
        begin = int(end[-1])
    return first, out.astype(">u8").tobytes()[: (total + 7) >> 3]


def decoded(n: int, block: int, first: np.ndarray, payload: bytes, table: tuple[np.ndarray, np.ndarray], bits: int) -> np.ndarray:
    """All ids of a segment: every block moves on by one id at a time, side by side."""
    ids, size = table
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    ahead = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = first.astype(np.int64)
    most = (len(ahead) - 1) * 8
    out = np.empty((min(block, n), len(first)), np.uint32)
    for k in range(len(out)):
        at = np.minimum(at, most)
        next_bits = (ahead[at >> 3] >> (32 - bits - (at & 7)).astype(np.uint32)) & np.uint32((1 << bits) - 1)
        out[k] = ids[next_bits]
        at = at + size[next_bits]
    return np.ascontiguousarray(out.T).reshape(-1)[:n] if len(first) else np.zeros(0, np.uint32)


def code_limit(used: int) -> int:
    """Bits that codes may have: 16, or two more than the ids in use ask for."""
    return max(16, max(1, used - 1).bit_length() + 2)


class FileWriter:
    """Writes one file; memory holds one segment. ``segments``: offset, ids before it, documents, ids, first and last doc_id of each."""

    def __init__(self, out, lengths: np.ndarray, codes: np.ndarray, block: int = 512, segment: int = 1 << 20):
        self.out, self.lengths, self.codes, self.block, self.segment = out, lengths, codes, block, segment
        packed = zlib.compress(lengths.astype(np.uint8).tobytes(), 6)
        self.at = self.before = 0
        self._write(MAGIC + struct.pack("<II", len(lengths), len(packed)) + packed)
        self.docs: list[int] = []
        self.parts: list[np.ndarray] = []
        self.held = 0
        self.segments: list[tuple[int, int, int, int, int | None, int | None]] = []

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.segment:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        ids = np.concatenate(self.parts)
        first, payload = encoded(ids, self.lengths, self.codes, self.block)
        sizes = np.fromiter(map(len, self.parts), "<u4", len(self.parts))
        ends = [None if x == NO_ID else x for x in (self.docs[0], self.docs[-1])]
        self.segments.append((self.at, self.before, len(self.docs), len(ids), *ends))
        self._write(struct.pack("<IIIII", len(self.docs), len(ids), self.block, len(first), len(payload)))
        self._write(np.array(self.docs, "<i8").tobytes() + sizes.tobytes() + first.tobytes() + payload)
        self.before += len(ids)
        self.docs, self.parts, self.held = [], [], 0


def read_header(src) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """The decoding table of a file and the bits that it looks at."""
    if src.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    n, packed = struct.unpack("<II", src.read(8))
    lengths = np.frombuffer(zlib.decompress(src.read(packed)), np.uint8)
    if len(lengths) != n:
        raise ValueError("a token file's code lengths are cut short")
    bits = max(1, int(lengths.max(initial=1)))
    return decoding_table(lengths, bits), bits


def read_segment(src, table: tuple[np.ndarray, np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """doc_ids, ids in each and all ids of the segment that starts here; None at the end of the file."""
    head = src.read(20)
    if not head:
        return None
    docs, ids, block, blocks, size = struct.unpack("<IIIII", head)
    doc_ids = np.frombuffer(src.read(8 * docs), "<i8")
    sizes = np.frombuffer(src.read(4 * docs), "<u4")
    first = np.frombuffer(src.read(4 * blocks), "<u4")
    return doc_ids, sizes, decoded(ids, block, first, src.read(size), table, bits)


def read_file(src) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, ids in each and all ids, segment by segment."""
    table, bits = read_header(src)
    while (found := read_segment(src, table, bits)) is not None:
        yield found


# ---------------------------------------------------------------- tables


def _ranges(docs: DataFrame, n: int) -> list[int]:
    """Bounds of n ranges of ids with about as many rows each; only the id column is read."""
    return sorted(set(docs.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 0, ranges: int | None = None) -> DataFrame:
    """bucket, doc_id, n, ids (u16 or u32 bytes, with the end id) and wide, by ranges of ascending ids.

    A task adds one row for all its documents: how often it met each id, as ``counts``; that row has no ids.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    bounds = np.array(_ranges(docs, n), np.float64)
    names = ["bucket", "doc_id", "n", "ids", "wide", "counts"]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.binary())

    def tokens(batches):
        known = token_ids(tokenizer)
        wide = max(known.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        total = np.zeros(1, np.int64)
        for b in slices(batches, 4096, 1 << 22):
            flat, size = known.flat(b["text"].to_pylist())
            flat, size = np.insert(flat, np.cumsum(size), end_id), size + 1
            met = np.bincount(flat, minlength=len(total))
            met[: len(total)] += total
            total = met
            if not wide:
                flat = flat.astype("<u2")
            width = flat.itemsize
            offsets = np.concatenate([[0], np.cumsum(size * width)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype(flat.dtype.newbyteorder("<"), copy=False))])
            bucket = np.searchsorted(bounds, b["doc_id"].cast(pa.float64()).fill_null(float("-inf")).to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), b["doc_id"], pa.array(size), packed, pa.array([wide] * len(size)), pa.nulls(len(size), pa.binary())], names)
        used = np.flatnonzero(total)
        if len(used):
            row = (TaskContext.get().partitionId() % (len(bounds) + 1), None, 0, None, wide, used.astype("<i8").tobytes() + total[used].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    rows = docs.mapInArrow(tidy(tokens, keep_ids=True), "bucket int, doc_id long, n long, ids binary, wide boolean, counts binary")
    parts = len(bounds) + 1
    rows = rows.repartitionById(parts, F.col("bucket")) if hasattr(rows, "repartitionById") else rows.repartition(parts, "bucket")
    return rows.sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "n", "ids")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs: the tasks' counts, summed by id. The driver gets one row for each id of the vocabulary."""

    def count(batches):
        total: dict[int, int] = {}
        for b in batches:
            for x in b["counts"].to_pylist():
                ids, n = np.frombuffer(x, "<i8").reshape(2, -1).tolist()
                for i, k in zip(ids, n, strict=True):
                    total[i] = total.get(i, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], ["id", "n"])

    rows = tokens.where("counts is not null").select("counts").mapInArrow(tidy(count, keep_ids=True), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(max(rows["id"].to_numpy(), default=0) + 1, np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return counts


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, block: int = 512, segment: int = 1 << 20, file_ids: int = 1 << 26) -> DataFrame:
    """Writes the ids of ``docs`` and returns the list of segments: path, bucket, offset, before, n_docs, n_ids, first, last.

    ``offset``: the segment's first byte; ``before``: ids before it in its file; first and last: doc_ids. A repeated or
    lost task writes files of other names; only those on the list count.
    """
    spark = docs.sparkSession
    tokens = staged(tokenized(docs, tokenizer, end_id), "tokens")
    counts = id_counts(tokens)
    lengths = code_lengths(counts, code_limit(int(np.count_nonzero(counts))))
    folder = folder or shared_dir(spark, "tokenfiles")
    sent = spark.sparkContext.broadcast(zlib.compress(lengths.tobytes()))  # one byte for each id of the vocabulary
    kinds = (pa.string(), pa.int32(), *(pa.int64(),) * 6)

    def write(batches):
        own = np.frombuffer(zlib.decompress(sent.value), np.uint8)
        codes = canonical_codes(own)
        fs, at = file_system(folder)
        fs.create_dir(at, recursive=True)
        out = writer = key = name = None
        done: list[tuple] = []

        def close():
            writer.flush()
            out.close()
            done.extend((f"{folder}/{name}", key[0], *s) for s in writer.segments)

        for b in slices(batches, 4096, 1 << 23):
            wide = b["wide"].to_pylist()
            for k, (doc_id, bucket, ids) in enumerate(zip(b["doc_id"].to_pylist(), b["bucket"].to_pylist(), b["ids"], strict=True)):
                order = (bucket, NO_ID if doc_id is None else doc_id)
                if writer is None or order < key or bucket != key[0] or writer.before + writer.held >= file_ids:
                    if writer is not None:
                        close()
                    name = f"{uuid.uuid4().hex}.tok"
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                    writer = FileWriter(out, own, codes, block, segment)
                key = order
                writer.add(doc_id, np.frombuffer(ids.as_buffer(), "<u4" if wide[k] else "<u2"))
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], ["path", "bucket", "offset", "before", "n_docs", "n_ids", "first", "last"])

    rows = tokens.where("counts is null").select("doc_id", "bucket", "ids", "wide")
    segments = staged(rows.mapInArrow(tidy(write, keep_ids=True), "path string, bucket int, offset long, before long, n_docs long, n_ids long, first long, last long"), "segments")
    removed(spark, tokens)
    return segments


def read_token_files(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the listed segments, decoded.

    A task reads the segments dealt to it: each from its own offset, its blocks from their bit offsets.
    """
    files = segments.groupBy("path").agg(F.first("bucket").alias("bucket"), F.min_by("first", "before").alias("first"), F.max_by("last", "before").alias("last"), F.sum("n_ids").alias("ids"))
    order = W.orderBy("bucket", F.col("first").asc_nulls_first(), F.col("last").asc_nulls_first(), F.col("path")).rowsBetween(W.unboundedPreceding, -1)
    base = files.select("path", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("base"))  # one row for each file
    rows = segments.join(base, "path").select("path", "offset", (F.col("base") + F.col("before")).alias("start"))

    def read(batches):
        path = src = table = bits = None
        for b in batches:
            for p, offset, at in zip(b["path"].to_pylist(), b["offset"].to_pylist(), b["start"].to_pylist(), strict=True):
                if p != path:
                    if src is not None:
                        src.close()
                    fs, own = file_system(p)
                    path, src = p, fs.open_input_file(own)
                    table, bits = read_header(src)
                src.seek(offset)
                doc_ids, sizes, ids = read_segment(src, table, bits)
                end = np.cumsum(sizes, dtype=np.int64)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(end.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=doc_ids == NO_ID), pa.array(at + end - sizes), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        if src is not None:
            src.close()

    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "path", "offset").sortWithinPartitions("path", "offset").mapInArrow(tidy(read, keep_ids=True), "doc_id long, start long, n_tokens long, ids_crc32 long")
