"""Near-duplicate documents by DartMinHash over word shingles.

A document is a weighted set of shingles of five words (a shorter text's one shingle is all its words); weights
are 1 or the number of occurrences. For every element a Poisson process of hashed darts falls on the strip of its
weight (in dyadic cells of the weight axis) and rising rank. Darts under an element's weight hit; a document
keeps the darts up to a rank at which about ``k ln k`` hit, each dart belongs to one of k coordinates, and the
earliest of a coordinate is its value. Two documents agree in a coordinate with a chance of their weighted
Jaccard similarity. Bands of coordinates become join keys; found pairs are compared exactly.

Equal texts are one class from the start. Every bucket of a band is treated alike, whatever its size: its most central
document (the one that meets most others) is compared with all others, which connects families of copies; what still
lies in several components then meets in blocks of bounded size. There an upper bound of the intersection, from
histograms of both shingle sets, rules out most pairs, the others are compared exactly, each pair in the first bucket
that it shares, and only links that join components leave the task. No bucket is cut short, none is expanded into rows
of pairs, and the only pairs that can be missed are those that share no band.

Edge cases: a null text counts as empty; texts without words are near-duplicates of equal texts only; rows with
equal ids are versions of one document; a null id's row stays alone with a null component and is kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veltra.llm.common import components, mix, removed, shingle_hashes, slices, staged, tidy, word_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6  # a pair at 0.8 shares no band with a chance of 6e-5
CELLS = 256  # of the histograms that bound intersections
SALT = 512  # rows of a bucket under one key of a join


# ---------------------------------------------------------------- signatures


def shingles(words: np.ndarray, n: int = WORDS, weights: str = "binary") -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their weights."""
    values, counts = np.unique(shingle_hashes(words, n), return_counts=True)
    return values, counts.astype(np.float64) if weights == "count" else np.ones(len(values))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _darts(seed: np.ndarray, low: np.ndarray, width: np.ndarray, weight: np.ndarray, reach: np.ndarray, coordinate: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates, ranks and values of the darts that hit, up to each region's ``reach`` in rank.

    ``coordinate``: where the coordinates of a region's set begin.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, rank, step = np.arange(len(seed)), np.zeros(len(seed)), 0
    part = low + width > weight  # regions that the weight fills in part: darts above it miss
    partly = bool(part.any())
    while len(at):
        h = mix(seed[at] + np.uint64(step), 5)
        rank = rank - np.log(_uniform(h)) / width[at]
        near = np.flatnonzero(rank <= reach[at])
        at, rank = at[near], rank[near]
        dart = mix(h[near], 7)
        key = coordinate[at] + ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        if partly:
            hit = np.flatnonzero(~part[at] | (low[at] + width[at] * _uniform(mix(dart, 11)) < weight[at]))
            found.append((key[hit], rank[hit], dart[hit]))
        else:
            found.append((key, rank, dart))
        step += 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64))


def dart_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int, step: int = 1 << 16) -> np.ndarray:
    """Signatures (n, k) of n weighted sets, given as all their elements with weights and owners (0 to n - 1).

    Sets without elements keep zeros. Elements are worked through in steps, so memory follows the signatures only.
    """
    norm = np.bincount(owner, weights=weights, minlength=n)
    reach = k * (np.log(k) + 3.0) / np.maximum(norm, 1e-300)
    best, value = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    todo = norm > 0
    while todo.any():
        for i in range(0, len(elements), step):
            on = todo[owner[i : i + step]]
            if not on.any():
                continue
            e, w, o = (x[i : i + step][on] for x in (elements, weights, owner))
            # cells of the weight axis: [0, 1), [1, 2), [2, 4), ... as far as the weight reaches
            cells = np.where(w > 1, np.ceil(np.log2(np.maximum(w, 1))).astype(np.int64), 0) + 1
            rep = np.repeat(np.arange(len(e)), cells)
            cell = np.arange(len(rep)) - np.repeat(np.cumsum(cells) - cells, cells)
            low = np.where(cell == 0, 0.0, 2.0 ** (cell - 1))
            width = np.where(cell == 0, 1.0, low)
            seed = mix(e[rep] ^ (cell.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), 3)
            key, rank, dart = _darts(seed, low, width, w[rep], reach[o[rep]], o[rep] * k, k)
            np.minimum.at(best, key, rank)  # the earliest dart of each coordinate
            first = np.flatnonzero(rank == best[key])
            value[key[first]] = dart[first] | np.uint64(1)
        open_ = todo & np.isinf(best.reshape(n, k)).any(1)  # an empty coordinate: look further up
        reach = np.where(open_, reach * 2, reach)
        todo = open_
    return value.reshape(n, k)


def bands(signatures: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for each band: its number and its coordinates, hashed."""
    s = signatures[:, : n_bands * rows].reshape(len(signatures), n_bands, rows)
    key = np.zeros(s.shape[:2], np.uint64) + np.arange(n_bands, dtype=np.uint64)
    for i in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, i], 13)
    return key.astype(np.int64)


def signed(docs: DataFrame, n_bands: int = BANDS, rows: int = ROWS, words: int = WORDS, weights: str = "binary") -> DataFrame:
    """doc_id, key (of the whole text), n (the set's total weight) and the band keys of every document."""

    def sign(batches):
        for b in slices(batches):
            sets = [shingles(word_hashes((t or "").encode()), words, weights) for t in b["text"].to_pylist()]
            size = np.array([len(e) for e, _ in sets])
            owner = np.repeat(np.arange(len(sets)), size)
            elements, w = (np.concatenate([x[i] for x in sets]) for i in (0, 1))
            keys = bands(dart_minhash(elements, w, owner, len(sets), n_bands * rows), n_bands, rows)
            offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, n_bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[size > 0].reshape(-1)))
            n = np.array([x.sum() for _, x in sets])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["key"], pa.array(n), lists], ["doc_id", "key", "n", "bands"])

    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))
    return d.mapInArrow(tidy(sign), "doc_id long, key binary, n double, bands array<long>")


# ---------------------------------------------------------------- pairs


def jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of distinct, ascending elements with weights."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    low = np.minimum(x[1][i], y[1][j]).sum()
    total = x[1].sum() + y[1].sum() - low
    return float(low / total) if total else 0.0


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, words: int, weights: str) -> DataFrame:
    """The pairs (a, b) of at least that similarity, by their whole texts."""
    t = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.select("a", "b").hint("merge").join(t("b").hint("merge"), "b").hint("merge").join(t("a").hint("merge"), "a").select("a", "text_a", "b", "text_b")

    def compare(batches):
        of = lambda s: shingles(word_hashes((s or "").encode()), words, weights)
        last = left = None
        for batch in slices(batches):
            ok = []
            for a, x, y in zip(batch["a"].to_pylist(), batch["text_a"].to_pylist(), batch["text_b"].to_pylist(), strict=True):
                if last is None or last != (a, x):
                    last, left = (a, x), of(x)
                ok.append(jaccard(left, of(y)) >= similarity - 1e-12)
            keep = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(keep)), batch["b"].take(pa.array(keep))], ["a", "b"])

    return both.mapInArrow(tidy(compare), "a long, b long")


def by_bucket(rows: DataFrame, info: DataFrame) -> DataFrame:
    """``rows`` (band, size, rep, ...) with the columns of their bucket's row in ``info`` (band, size, ...).

    A bucket's rows are dealt over as many keys as its size asks for, and its row of ``info`` goes to each of them.
    """
    salts = F.ceil(F.col("size") / SALT).cast("long")
    left = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), salts))
    right = info.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("size")
    return left.hint("merge").join(right.hint("merge"), ["band", "salt"]).drop("salt")


def _compared_in_blocks(rest: DataFrame, texts: DataFrame, similarity: float, words: int, weights: str, block: int = 512, block_words: int = 1 << 20) -> DataFrame:
    """Links (a, b) between different components c within the buckets of ``rest`` (band, size, rep, n, c, bands)."""
    many = F.ceil(F.greatest(F.count("*") / block, F.sum("n") / block_words)).cast("long")
    blocks = rest.groupBy("band").agg(F.first("size").alias("size"), F.greatest(many, F.lit(1).cast("long")).alias("blocks"))
    r = by_bucket(rest, blocks).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    r = r.select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", F.col("rep").alias("doc_id"), "c", "bands")
    met = r.hint("merge").join(texts.hint("merge"), "doc_id").select("band", "x", "y", "own", "doc_id", "c", "bands", "text")

    def compare(batches):
        def solve(group):
            band, x, y = group[0][:3]
            own, ids, c = (np.array([g[n] for g in group]) for n in (3, 4, 5))
            keys, sets = np.stack([g[6] for g in group]), [g[7] for g in group]
            at = int(np.nonzero(keys == band)[1][0])
            total = np.array([w.sum() for _, w in sets])
            hist = np.stack([np.bincount((e & np.uint64(CELLS - 1)).astype(np.int64), weights=w, minlength=CELLS) for e, w in sets]).astype(np.float32)
            a, b = [], []
            for i in range(len(ids)):
                js = np.flatnonzero((c != c[i]) & ((own != own[i]) if x != y else (np.arange(len(ids)) > i)) & (own >= own[i]))
                if len(js) and at:
                    js = js[(keys[js, :at] != keys[i, :at]).all(1)]  # an earlier common bucket compares them
                if len(js):  # at most what the cells have in common can be shared
                    most = np.minimum(hist[js], hist[i]).sum(1)
                    js = js[most >= (similarity - 1e-4) * (total[js] + total[i] - most)]
                for j in js.tolist():
                    if c[j] != c[i] and jaccard(sets[i], sets[j]) >= similarity - 1e-12:
                        a.append(min(ids[i], ids[j]))
                        b.append(max(ids[i], ids[j]))
                        c[c == c[j]] = c[i]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held: list[tuple] = []
        for batch in slices(batches):
            for *row, bands_, text in zip(*(batch[n].to_pylist() for n in ("band", "x", "y", "own", "doc_id", "c", "bands", "text")), strict=True):
                if held and held[0][:3] != tuple(row[:3]):
                    yield solve(held)
                    held = []
                held.append((*row, np.array(bands_, np.int64), shingles(word_hashes((text or "").encode()), words, weights)))
        if held:
            yield solve(held)

    n = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(n, "band", "x", "y").sortWithinPartitions("band", "x", "y").mapInArrow(tidy(compare), "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, weights: str = "binary", n_bands: int = BANDS, rows: int = ROWS, block: int = 512) -> DataFrame:
    """doc_id, component_id (smallest doc_id of the group) and kept (whether the row's document is that one)."""
    spark = docs.sparkSession
    base = staged(signed(docs, n_bands, rows, words, weights), "signed")
    classes = base.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = staged(classes, "classes")
    in_band = classes.select("rep", "n", F.explode("bands").alias("band"))
    shared = in_band.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    met = staged(in_band.join(shared, "band"), "in_band")
    central = met.groupBy("rep").agg(F.sum("size").alias("degree"))  # documents that a document meets, with repeats
    member = staged(met.join(central, "rep").select("band", "size", "rep", "n", "degree"), "member")
    removed(spark, met)
    # texts move once, those that have a candidate; by merge at every size, so that small inputs show what large ones do
    ids = member.select(F.col("rep").alias("doc_id")).distinct()
    texts = staged(docs.select(F.col("doc_id").cast("long"), "text").hint("merge").join(ids.hint("merge"), "doc_id", "left_semi"), "texts")

    # the most central document of each bucket against the others
    rank = F.struct("degree", -F.col("rep"))
    lead = staged(member.groupBy("band").agg(F.first("size").alias("size"), F.max_by(F.struct("rep", "n"), rank).alias("lead")), "leads")
    others = by_bucket(member, lead).where(F.col("rep") != F.col("lead.rep"))
    close = F.least("n", "lead.n") >= F.lit(similarity - 1e-9) * F.greatest("n", "lead.n")
    pairs = staged(others.where(close).select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b")).distinct(), "pairs")
    links = staged(verified(pairs, texts, similarity, words, weights), "verified")
    removed(spark, pairs)
    comp = staged(components(links), "components")

    # the others of each bucket that holds several components of them
    labelled = staged(others.drop("lead", "degree").join(comp, F.col("rep") == F.col("id"), "left").select("band", "size", "rep", "n", F.coalesce("component", "rep").alias("c")), "labelled")
    removed(spark, member)
    split = labelled.groupBy("band").agg(F.first("size").alias("size"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("band", "size")
    rest = by_bucket(labelled, staged(split, "split")).join(classes.select("rep", "bands"), "rep")
    found = staged(_compared_in_blocks(staged(rest, "apart"), texts, similarity, words, weights, block), "verified")
    if not found.isEmpty():
        links = links.unionByName(found)
        comp = staged(components(links), "components")
    removed(spark, labelled)
    removed(spark, texts)

    # equal ids or texts may still join classes: ids with several texts
    out = base.select("doc_id", "key").join(classes.select("key", "rep"), "key", "left")
    versions = out.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).join(classes.select(F.col("rep").alias("a")).distinct(), "a", "left_semi")
    if not versions.isEmpty():
        comp = staged(components(links.unionByName(versions.select("a", "b"))), "components")
    out = out.join(comp, F.col("rep") == F.col("id"), "left")
    component = F.coalesce("component", "rep")
    out = out.select("doc_id", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    done = staged(out, "near_duplicates")
    removed(spark, base)
    removed(spark, classes)
    return done


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: of its smallest doc_id, of equal ids the least text."""
    found = near_duplicates(docs, **options)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if twice.isEmpty():
        return left
    one = left.join(twice, "doc_id", "left_semi").withColumn("__k", F.row_number().over(W.partitionBy("doc_id").orderBy("text"))).where("__k = 1").select(*docs.columns)
    return left.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(one)
