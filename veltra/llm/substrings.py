"""Duplicate substrings: every byte covered by a 100-byte string that also starts earlier is removed.

Anchors: the least hash of the 32-byte strings in a 100-byte window is its anchor, so equal windows have equal anchors,
at the same place in the window. Around an anchor, all windows that may hold it lie in its context of at most 68 bytes
before and 100 bytes behind its start. Occurrences of an anchor with equal contexts (by a fingerprint of 128 bits that
also sees where a document begins or ends) are one class: every window of a later one is a duplicate, and its first
occurrence stands for the class from then on. Tasks drop what repeats in their own part before anything is shuffled, so
a passage with very many copies is a few rows for each task.

Index: where an anchor has several classes, their contexts are sorted and extended. Windows are taken in two halves, by
where the anchor lies in them; all windows of a half hold the same 66 bytes or more, so contexts meet only where these
agree: a hot anchor falls apart by what stands beside it. The contexts that meet are aligned, and their Burrows-Wheeler
transform is kept column by column: a column's order sorts the contexts by what follows, the characters in front of
that order are the transform's column, and the stable rearrangement by them is the next order. Extending all intervals
backward by one character at a time, breadth first, gives the common prefixes of neighbours as one more than the least
common prefix between them before; they rise by one a step and stop at the minimum length. Runs of neighbours with
common prefixes of the minimum length are equal windows; all but the earliest are duplicates.

A task holds the contexts that agree in 66 bytes, each once, and at least ``batch_contexts`` of them.

Edge cases: a null text counts as empty; texts under the minimum length lose nothing; a null id sorts first; rows
with equal ids are documents in the order of their texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veltra.llm.common import mix, removed, slices, staged, tidy

GRAM = 32


# ---------------------------------------------------------------- anchors


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every run of ``width`` values."""
    k = 1
    while 2 * k <= width:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def _grams(x: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of ``gram`` symbols; ``gram`` is a power of two."""
    h, k, p = x, 1, 0x9E3779B97F4A7C15
    while k < gram:
        h = h[:-k] * np.uint64(p) + h[k:]
        k, p = k * 2, (p * p) & 0xFFFFFFFFFFFFFFFF
    return mix(h) | np.uint64(1)


def anchors(texts: list[bytes], least: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of all windows of ``least`` bytes: text number, position, hash, and two fingerprints of the context."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes + least) - sizes  # ``least`` symbols 0 before each text, and behind the last
    x = np.zeros(int(sizes.sum()) + least * (len(texts) + 1), np.uint64)
    inside = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    x[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    h = _grams(x, gram)
    n = least - gram + 1  # places of the anchor in a window
    low = _sliding(h, n, np.minimum)
    edge = np.zeros(len(low) + 1, np.int64)
    long = sizes >= least
    np.add.at(edge, begin[long], 1)
    np.add.at(edge, (begin + sizes - least + 1)[long], -1)
    low[np.cumsum(edge[:-1]) == 0] = 0  # no window crosses an end
    pad = np.zeros(n - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), n, np.maximum)[: len(h)] == h)
    # grams that cover the context from end to end
    cover = [*range(gram - least, least - gram, gram), least - gram]
    first, second = np.zeros(len(at), np.uint64), np.full(len(at), 5, np.uint64)
    for offset in cover:
        own = h[at + offset]
        first = mix(first * np.uint64(0x9E3779B97F4A7C15) + own, 1)
        second = mix(second ^ mix(own, 2), 3)
    doc = np.searchsorted(begin + sizes, at, "right")
    return doc, at - begin[doc], h[at], first, second


def _anchored(docs: DataFrame, least: int, chunk: int) -> DataFrame:
    """h, c1, c2, ord, pos and known of every anchor; ``known``: an equal context comes earlier in the task's chunk.

    Rows that are known already need no company; they are dealt by an h of their own.
    """
    names = ["h", "c1", "c2", "ord", "pos", "known"]

    def told(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, c1, c2, ord_, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        place = np.lexsort((pos, ord_))
        h, c1, c2, ord_, pos = (x[place] for x in (h, c1, c2, ord_, pos))
        by = np.argsort(c1, kind="stable")
        same = (c1[by][1:] == c1[by][:-1]) & (c2[by][1:] == c2[by][:-1]) & (h[by][1:] == h[by][:-1])
        known = np.zeros(len(h), bool)
        known[by[1:][same]] = True
        h = np.where(known, mix(ord_.view(np.uint64) * np.uint64(31) + pos.astype(np.uint64), 9), h)
        return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (h, c1, c2)), pa.array(ord_), pa.array(pos.astype(np.int32)), pa.array(known)], names)

    def find(batches):
        held, n = [], 0
        for b in slices(batches, 1024, 1 << 20):
            texts = [(t or "").encode() for t in b["text"].to_pylist()]
            doc, pos, h, c1, c2 = anchors(texts, least)
            held.append((h, c1, c2, b["ord"].to_numpy()[doc], pos))
            n += len(doc)
            if n >= chunk:
                yield told(held)
                held, n = [], 0
        if n:
            yield told(held)

    return docs.mapInArrow(tidy(find), "h long, c1 long, c2 long, ord long, pos int, known boolean")


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h, c1, c2, ord, pos to ord, pos and h: h is null where all windows around the place are
    duplicates, else the place stands for a class, and its anchor has others."""

    def rows(ord_: np.ndarray, pos: np.ndarray, h: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ord_), pa.array(pos), pa.array(h, mask=whole)], ["ord", "pos", "h"])

    last: tuple[np.ndarray, ...] | None = None  # the newest class's first row, as arrays of one
    mixed = False  # whether a class of its anchor came before it
    for b in batches:
        known = b["known"].to_numpy(zero_copy_only=False)
        h, c1, c2, ord_, pos = (b[c].to_numpy() for c in ("h", "c1", "c2", "ord", "pos"))
        if known.any():
            yield rows(ord_[known], pos[known], h[known], np.ones(int(known.sum()), bool))
            h, c1, c2, ord_, pos = (x[~known] for x in (h, c1, c2, ord_, pos))
        if not len(h):
            continue
        n_old = 0 if last is None else 1
        if last is not None:
            h, c1, c2, ord_, pos = (np.concatenate(x) for x in zip(last, (h, c1, c2, ord_, pos), strict=True))
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])])
        again = ~new
        yield rows(ord_[again], pos[again], h[again], np.ones(int(again.sum()), bool))
        at = np.flatnonzero(new)
        after = np.concatenate([h[at][1:] == h[at][:-1], [False]])
        before = np.concatenate([[mixed and n_old == 1], after[:-1]])
        open_ = before | after
        mixed = bool(before[-1])
        stays = at[:-1][open_[:-1]]  # the last class may still find company
        yield rows(ord_[stays], pos[stays], h[stays], np.zeros(len(stays), bool))
        last = tuple(x[at[-1:]] for x in (h, c1, c2, ord_, pos))
    if last is not None and mixed:
        h, _, _, ord_, pos = last
        yield rows(ord_, pos, h, np.zeros(1, bool))


# ---------------------------------------------------------------- contexts


def halves(least: int, gram: int = GRAM) -> list[tuple[int, int]]:
    """Two ranges of an anchor's offsets in a window, ends included."""
    reach = least - gram
    return [(0, reach // 2), (reach // 2 + 1, reach)]


def contexts(raw: bytes, pos: int, least: int, gram: int = GRAM) -> Iterator[tuple[int, int, int, bytes]]:
    """For each half: its number, the first and the last offset of a window within the text, and the bytes they cover."""
    for k, (a, b) in enumerate(halves(least, gram)):
        lo, hi = max(a, pos + least - len(raw)), min(b, pos)
        if lo <= hi:
            yield k, lo, hi, raw[pos - hi : pos - lo + least]


def duplicate_windows(group: np.ndarray, rank: np.ndarray, half: tuple[int, int], lo: np.ndarray, hi: np.ndarray, rows: list[bytes], least: int) -> np.ndarray:
    """For each context and window start (by the anchor's offset, the highest first): does an equal window have a lower rank?

    ``group``: ascending group numbers; only contexts of a group are compared. Backward extension from the last column
    to the first, all groups side by side.
    """
    a, b = half
    m, width = len(rows), least + b - a
    size = np.fromiter(map(len, rows), np.int64, m)
    begin = b - hi
    end = begin + size
    flat = np.zeros(m * width, np.uint16)
    inside = np.repeat(np.arange(m) * width + begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    flat[inside] = np.frombuffer(b"".join(rows), np.uint8).astype(np.uint16) + np.uint16(1)
    grid = np.ascontiguousarray(flat.reshape(m, width).T)
    starts = b - a + 1
    out = np.zeros((m, starts), bool)
    order, lcp = np.arange(m), np.zeros(m + 1, np.int16)
    base = group.astype(np.int64) << 9
    for col in range(width - 1, -1, -1):
        key = (base + grid[col])[order]  # the transform's column
        if (key[1:] >= key[:-1]).all():
            by = np.arange(m)
        else:
            by = np.argsort(key, kind="stable")
            key = key[by]
        alike = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] & 511 > 0))
        fresh = np.zeros(m + 1, np.int16)
        if len(alike):
            spans = np.empty(2 * len(alike), np.int64)
            spans[::2], spans[1::2] = by[alike] + 1, by[alike + 1] + 1
            fresh[alike + 1] = np.minimum(np.minimum.reduceat(lcp, spans)[::2] + 1, least)
        # the first of a group had no neighbour before: its common prefix was 0, and so is none across groups
        lcp, order = fresh, order[by]
        if col < starts:
            cut = np.flatnonzero(lcp[:m] < least)
            r = rank[order]
            first = np.repeat(np.minimum.reduceat(r, cut), np.diff(np.append(cut, m)))
            out[order, col] = r > first
    return out & (np.arange(starts) >= begin[:, None]) & (np.arange(starts) + least <= end[:, None])


def _flags(least: int, batch_contexts: int):
    """Context rows sorted by g, half, ord, pos to duplicate windows: ord, start, and a bit for each window from there."""
    parts = halves(least)

    def solve(t: pa.Table) -> pa.RecordBatch:
        g, half, ord_, pos, lo, hi = (t[c].to_numpy() for c in ("g", "half", "ord", "pos", "lo", "hi"))
        group = np.concatenate([[0], np.cumsum((g[1:] != g[:-1]) | (half[1:] != half[:-1]))])
        many = np.bincount(group)[group] > 1
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, (a, b) in enumerate(parts):
            ids = np.flatnonzero(many & (half == k))
            if len(ids):
                flags = duplicate_windows(group[ids], ids, (a, b), lo[ids], hi[ids], t["ctx"].take(pa.array(ids)).to_pylist(), least)
                bits = (flags.astype(np.int64) << np.arange(flags.shape[1])).sum(1)
                some = np.flatnonzero(bits)
                found.append((ord_[ids[some]], pos[ids[some]] - b, bits[some]))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["ord", "start", "bits"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < batch_contexts:
                continue
            t = pa.Table.from_batches(held)
            g = t["g"].to_numpy()
            cut = int(np.searchsorted(g, g[-1], "left"))  # the last group may go on
            if cut:
                yield solve(t.slice(0, cut).combine_chunks())
                held, n = t.slice(cut).combine_chunks().to_batches(), len(g) - cut
        if n:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return run


def _with_contexts(docs: DataFrame, places: DataFrame, least: int) -> DataFrame:
    """g (of what all windows of the half hold), half, ord, pos, lo, hi and ctx of each place's halves."""
    at = places.groupBy("ord").agg(F.collect_list("pos").alias("at"))  # bounded by the text
    parts = halves(least)
    names = ["g", "half", "ord", "pos", "lo", "hi", "ctx"]
    kinds = (pa.int64(), pa.int8(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.binary())

    def cut(batches):
        import xxhash

        for b in slices(batches):
            out: list[list] = [[] for _ in names]
            for o, t, at in zip(b["ord"].to_pylist(), b["text"].to_pylist(), b["at"].to_pylist(), strict=True):
                raw = (t or "").encode()
                for p in at:
                    for k, lo, hi, ctx in contexts(raw, p, least):
                        first, last = parts[k]
                        g = xxhash.xxh3_64_intdigest(raw[p - first : p + least - last], k)
                        for c, v in zip(out, (g - (g >> 63 << 64), k, o, p, lo, hi, ctx), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    joined = docs.hint("merge").join(at.hint("merge"), "ord").select("ord", "text", "at")
    return joined.mapInArrow(tidy(cut), "g long, half byte, ord long, pos int, lo short, hi short, ctx binary")


# ---------------------------------------------------------------- documents


def removed_bytes(size: int, starts: np.ndarray, least: int) -> np.ndarray:
    """Which bytes the windows starting there cover."""
    delta = np.zeros(size + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + least, -1)
    return np.cumsum(delta[:-1]) > 0


def window_starts(size: int, start: np.ndarray, bits: np.ndarray, whole: np.ndarray, least: int, gram: int = GRAM) -> np.ndarray:
    """Starts of the windows that marks name: by bits from a start on, or all around an anchor's place."""
    some = [start[~whole][bits[~whole] >> k & 1 > 0] + k for k in range((least - gram) // 2 + 1)]
    at = start[whole].astype(np.int64)
    first, last = np.maximum(at - (least - gram), 0), np.minimum(at, size - least)
    n = np.maximum(last - first + 1, 0)
    around = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.concatenate([*some, around])


def deduplicated(docs: DataFrame, least: int = 100, batch_contexts: int = 1 << 16, chunk: int = 1 << 20, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, with ``keep_text`` also the kept bytes."""
    d = docs.select(F.col("doc_id").cast("long"), "text")
    spark = d.sparkSession
    ids = d.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("k")).first()
    if ids["n"] == ids["k"]:
        d = d.withColumn("ord", F.col("doc_id"))
    else:  # equal or null ids: number the rows in order once
        d = staged(d.orderBy(F.col("doc_id").asc_nulls_first(), "text").withColumn("ord", F.monotonically_increasing_id()), "numbered")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = d.select("ord", "text")
    places = _anchored(text, least, chunk).repartition(n, "h").sortWithinPartitions("h", "c1", "c2", "ord", "pos").mapInArrow(tidy(_resolved), "ord long, pos int, h long")
    places = staged(places, "places")
    rows = _with_contexts(text, places.where("h is not null").select("ord", "pos"), least).repartition(n, "g", "half").sortWithinPartitions("g", "half", "ord", "pos")
    flags = staged(rows.mapInArrow(tidy(_flags(least, batch_contexts)), "ord long, start int, bits long"), "flags")
    marks = flags.unionByName(places.where("h is null").select("ord", F.col("pos").alias("start"), F.lit(None).cast("long").alias("bits")))
    marks = marks.groupBy("ord").agg(F.collect_list(F.struct("start", "bits")).alias("marks"))  # bounded by the text
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def remove(batches):
        for b in slices(batches):
            cols: list[list] = [[] for _ in names[1:]]
            marks = b["marks"]
            flat = marks.flatten()
            start, bits = flat.field("start").to_numpy(), flat.field("bits")
            whole = bits.is_null().to_numpy(zero_copy_only=False)
            bits = bits.fill_null(0).to_numpy()
            ends = np.cumsum(marks.value_lengths().fill_null(0).to_numpy())
            for i, t in enumerate(b["text"].to_pylist()):
                raw = (t or "").encode()
                lo, hi = int(ends[i - 1]) if i else 0, int(ends[i])
                kept, spans = raw, 0
                if lo < hi:
                    gone = removed_bytes(len(raw), window_starts(len(raw), start[lo:hi], bits[lo:hi], whole[lo:hi], least), least)
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                for c, v in zip(cols, (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None), strict=True):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    whole = staged(d.hint("merge").join(marks.hint("merge"), "ord", "left").select("doc_id", "text", "marks").mapInArrow(tidy(remove), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"), "deduplicated")
    for x in (places, flags):
        removed(spark, x)
    return whole if keep_text else whole.drop("kept")
