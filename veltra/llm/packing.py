"""Packing documents into as few fixed-length sequences as possible, by bin completion.

Documents become ids with an end id; longer ones than a sequence are cut into full pieces, the first of which
holds the rest. What is left to solve depends only on how many pieces of each length there are: a histogram of at
most ``capacity`` rows, whatever the corpus. The solver takes the largest length, enumerates all undominated fillings
of the space beside it, tries the fullest first, prunes by the waste that a better packing may still have, and
keeps best-fit decreasing and every better packing as incumbent. It ends at the lower bound, when all is tried, or after
``nodes`` nodes. A solution is a list of patterns, each with a number of sequences; pieces find their place by their
rank among the pieces of their length.

Edge cases: a null or empty text is one piece that holds only the end id; rows with equal or null ids are packed
each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veltra.llm.common import slices, staged, tidy, token_ids

Pattern = tuple[tuple[int, ...], int]  # lengths, descending, and the number of sequences filled so


# ---------------------------------------------------------------- solver


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: by total length, and by pieces over half with what cannot join them."""
    size = np.arange(len(counts))
    best = -(-int((counts * size).sum()) // capacity)
    for small in range(0, capacity // 2 + 1):
        big = int(counts[capacity - small + 1 :].sum()) if small else 0
        mid_from = capacity // 2 + 1
        mid = slice(mid_from, capacity - small + 1)
        n_mid = int(counts[mid].sum())
        room = n_mid * capacity - int((counts[mid] * size[mid]).sum())
        low = int((counts[small:mid_from] * size[small:mid_from]).sum())
        best = max(best, big + n_mid + max(0, -(-(low - room) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on the histogram: equal sequences move together."""
    open_: dict[int, list[list]] = {}
    for size in range(capacity, 0, -1):
        n = int(counts[size])
        while n:
            room = min((r for r in open_ if r >= size), default=None)
            if room is None:
                fit = capacity // size
                whole, rest = divmod(n, fit)
                for k, q in ((fit, whole), (rest, 1 if rest else 0)):
                    if q:
                        open_.setdefault(capacity - k * size, []).append([(size,) * k, q])
                n = 0
                continue
            pattern, q = open_[room].pop()
            k = min(q, n)
            if k < q:
                open_[room].append([pattern, q - k])
            if not open_[room]:
                del open_[room]
            open_.setdefault(room - size, []).append([(*pattern, size), k])
            n -= k
    return [(tuple(p), q) for group in open_.values() for p, q in group]


def fillings(counts: np.ndarray, room: int) -> Iterator[tuple[int, ...] | None]:
    """All undominated fillings of ``room``, the fullest first; of as full ones, those with the larger pieces. None stands
    for one that was found dominated, so that the caller can count the work.

    A filling is dominated if one of its pieces, or nothing, could give way to a larger piece that is left and still fits.
    Sums that pieces can make are known beforehand, one bit each, so every step taken ends in a filling. Fillings come
    one by one, as many as the caller asks for.
    """
    sizes = np.flatnonzero(counts[: room + 1]).tolist() if room > 0 else []
    many = [min(int(counts[x]), room // x) for x in sizes]
    mask = (1 << (room + 1)) - 1
    reach = [1]  # sums of pieces of the first sizes: of none, of the least, ...
    for x, n in zip(sizes, many, strict=True):
        bits, step = reach[-1], 1
        while n:
            k = min(step, n)
            bits |= bits << (x * k) & mask
            n, step = n - k, step * 2
        reach.append(bits)

    def exact(i: int, total: int) -> Iterator[tuple[int, ...]]:
        """Fillings of the first ``i`` sizes with that sum."""
        if not total:
            yield ()
            return
        for j in range(bisect_right(sizes, total, 0, i) - 1, -1, -1):
            x = sizes[j]
            for k in range(min(many[j], total // x), 0, -1):
                if reach[j] >> (total - k * x) & 1:
                    for rest in exact(j, total - k * x):
                        yield (x,) * k + rest

    def dominated(f: tuple[int, ...], slack: int) -> bool:
        for y in (0, *set(f)):  # the sizes over y that fit in its place
            for x in sizes[bisect_right(sizes, y) : bisect_right(sizes, y + slack)]:
                if counts[x] > f.count(x):
                    return True
        return False

    for total in range(room, -1, -1):
        if reach[-1] >> total & 1:
            for f in exact(len(sizes), total):
                yield f if total == room or not dominated(f, room - total) else None


def pack(counts: np.ndarray, capacity: int, nodes: int = 20_000) -> list[Pattern]:
    """Patterns that use up the histogram; optimal if they meet the lower bound or the search ends, else the best found
    while ``nodes`` fillings were looked at.

    A node takes the largest length left and one filling of the room beside it, for as many sequences as the pieces
    make; it is pruned when the waste so far leaves no packing better than the incumbent.
    """
    counts = counts.astype(np.int64)
    total = int((counts * np.arange(len(counts))).sum())
    least = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    bins = sum(q for _, q in best)
    left, path, used, waste, spent = counts.copy(), [], 0, 0, 0
    tried: list[int] = []  # how far each depth has come among its fillings
    down = True
    while bins > least and spent < nodes:
        if down:
            if not left.any():
                if used < bins:
                    best, bins = list(path), used
                down = False
                continue
            tried.append(0)
        elif tried:
            items, q = path.pop()
            for x in items:
                left[x] += q
            used, waste = used - q, waste - q * (capacity - sum(items))
        else:
            break  # every filling of every node was tried
        largest = int(np.flatnonzero(left)[-1])
        left[largest] -= 1
        filling = None
        for f in islice(fillings(left, capacity - largest), tried[-1], None):
            tried[-1] += 1
            spent += 1
            if f is not None or spent >= nodes:
                filling = f
                break
        left[largest] += 1
        if filling is None:
            tried.pop()
            down = False
            continue
        items = (largest, *filling)
        q = min(int(left[x]) // items.count(x) for x in set(items))
        lost = capacity - sum(items)
        if lost and q > 1 and len(items) > 1:
            q //= 2  # what wastes room may be better mixed with others
        if waste + q * lost > (bins - 1) * capacity - total:  # the next fillings waste more
            tried.pop()
            down = False
            continue
        for x in items:
            left[x] -= q
        path.append((items, q))
        used, waste, down = used + q, waste + q * lost, True
    return best


# ---------------------------------------------------------------- tables


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and its part and rank among the part's pieces of its length."""

    def cut(batches):
        known = token_ids(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for b in slices(batches, 4096, 1 << 22):
            flat, n = known.flat(b["text"].to_pylist())
            flat, n = np.insert(flat, np.cumsum(n), end_id).astype("<u4", copy=False), n + 1
            begin = np.cumsum(n) - n
            many = -(-n // capacity)  # pieces of each document
            doc = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            head = ((n - 1) % capacity + 1)[doc]  # the first piece holds the rest
            start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
            length = np.where(piece == 0, head, capacity)
            raw = memoryview(flat).cast("B")
            at = (begin[doc] + start) * 4
            crc = [zlib.crc32(raw[a:z]) for a, z in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            by = np.argsort(length, kind="stable")
            own = length[by]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            rank = np.empty(len(own), np.int64)
            rank[by] = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own)))) + seen[own]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(rank), pa.array(np.full(len(doc), part, np.int32))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "local", "part"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(cut, keep_ids=True), "doc_id long, piece int, start long, length long, ids_crc32 long, local long, part int")


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, nodes: int = 20_000) -> DataFrame:
    """Every piece with sequence_id and offset."""
    spark = docs.sparkSession
    rows = staged(pieces(docs, tokenizer, capacity, end_id), "pieces")
    by_part = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    by_part = staged(by_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length at most
        counts[r["length"]] = r["n"]
    # places of each length, by rank: first rank, pieces of it in a sequence, first sequence, offset of the first
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for lengths, q in pack(counts, capacity, nodes):
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            k = lengths.count(x)
            places.setdefault(x, []).append((int(ranks[x]), k, sequence, offset))
            ranks[x] += k * q
            offset += k * x
        sequence += q
    assert (ranks == counts).all()
    sent = spark.sparkContext.broadcast(places)  # patterns have distinct lengths that they use up: a few per length

    def place(batches):
        own = {x: np.array(p, np.int64).T for x, p in sent.value.items()}
        for b in batches:
            size, rank = b["length"].to_numpy(), b["local"].to_numpy() + b["before"].to_numpy()
            seq, off = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            by = np.argsort(size, kind="stable")
            cuts = np.flatnonzero(np.diff(size[by])) + 1
            for idx in np.split(by, cuts) if len(by) else []:
                x = int(size[idx[0]])
                first, k, sequence, offset = own[x]
                at = np.searchsorted(first, rank[idx], "right") - 1
                d = rank[idx] - first[at]
                seq[idx], off[idx] = sequence[at] + d // k[at], offset[at] + d % k[at] * x
            yield pa.RecordBatch.from_arrays([b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # by merge at every size: the ranks are few for each part, but there are as many parts as the input has
    ranked = rows.hint("merge").join(by_part.select("part", "length", "before").hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "local", "before")
    return ranked.mapInArrow(tidy(place, keep_ids=True), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
