"""Mixing sources to target weights.

Texts are cut into words and the words of each source, in doc_id order, into blocks of fixed length. A mix is a
sequence of output shards of block slots. Each shard draws from a multinomial over the target shares how many slots
each source gets in it; the draws are conditioned on the sources' totals, so that every total is exact to a block, and
made in two levels: source by source over groups of shards, then over the shards of a group. A source's counts, shard
after shard, are the ranks of its slots: a rank passes through that source's pseudorandom permutation (a new one for
every epoch), and the permuted index joins the block to take. Within a shard the slots stand in a pseudorandom order.

The driver holds a row for each source and, for drawing, one count for each source and group of shards (65,536 groups at
most); windows over all sources run in one task. Nothing there grows with the documents.

Edge cases: a null or empty text has size 0, is never taken and belongs to no block; null sources form one source,
last in order; rows with equal or null ids are separate documents; an empty table gives an empty result; other
columns pass through ``mixed_documents`` and are ignored by ``mix_documents``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veltra.llm.common import WORD, staged, tidy

#: Prime multipliers of the permutations; a source uses the first from its place that does not divide its block count.
PRIMES = (1_000_003, 1_000_033, 1_000_037, 1_000_039, 1_000_081, 1_000_099, 1_000_117, 1_000_121)


def size_of(text: Column) -> Column:
    """The number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, source and size: the number of words of the whole text."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"))


def source_targets(sizes: DataFrame, cycle: int = 3, limit: float = 3.0) -> DataFrame:
    """source, source_size and target for each source; ``sizes`` has source and size.

    Weights run 1..cycle by the sources' order. A target is ``min(limit * size, level * weight)`` with the one
    level at which the targets share all sizes: that is where handing the excess on, again and again, ends.
    One row per source is all that meets in a task here.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", (((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle) + 1).cast("double"))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(limit))).withColumn("at", F.col("most") / F.col("weight"))
    whole = W.partitionBy()
    before = W.orderBy("at", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
    # if all sources up to this one (by level) are full, the rest shares what is left
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("open", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("try", F.col("left") / F.col("open"))
    s = s.withColumn("level", F.min(F.when(F.col("try") <= F.col("at"), F.struct("at", "try"))).over(whole)["try"])
    target = F.when(F.col("level").isNull() | (F.col("at") < F.col("level")), F.col("most")).otherwise(F.col("level") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def positions(sizes: DataFrame, partitions: int | None = None) -> DataFrame:
    """Adds ``first``: the words before each document among its source's words, by doc_id, size and what else there is.

    Two levels, so that a source with most rows is spread: rows are range-partitioned by source and id, summed
    within partitions, and each partition's sum is carried to those behind.
    """
    spark = sizes.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = staged(sizes, "sizes")  # texts are read once; the sample for the ranges takes the sizes
    order = [F.col("doc_id").asc_nulls_first(), "size", *(c for c in sizes.columns if c not in ("doc_id", "size", "source"))]
    ranged = sizes.repartitionByRange(n, F.col("source").asc_nulls_first(), *order).withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "ranged")
    totals = ranged.groupBy("source", "part").agg(F.sum("size").alias("words"))
    carried = totals.withColumn("carried", F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    carried = carried.select(F.col("source").alias("c_source"), F.col("part").alias("c_part"), "carried")
    own = W.partitionBy("part", "source").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = ranged.withColumn("ahead", F.coalesce(F.sum("size").over(own), F.lit(0)))
    both = local.join(carried, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("part") == F.col("c_part")))
    return both.select(*sizes.columns, (F.col("ahead") + F.col("carried")).alias("first"))


def _multiplier(blocks: Column, epoch: Column, key: Column, seed: int) -> Column:
    """A prime that does not divide the number of blocks; a product of over five of them exceeds any count."""
    start = F.pmod(F.xxhash64(key, epoch, F.lit(seed)), F.lit(len(PRIMES)))
    order = [F.element_at(F.array(*map(F.lit, PRIMES)), (F.pmod(start + i, F.lit(len(PRIMES))) + 1).cast("int")) for i in range(len(PRIMES))]
    return F.coalesce(*[F.when(blocks % p != 0, p) for p in order]).cast("decimal(20,0)")


def planned(targets: DataFrame, block: int) -> DataFrame:
    """Adds ``blocks`` (of the source) and ``slots`` (block slots that the mix gives it)."""
    t = targets.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
    share = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0))
    t = t.withColumn("slots", F.floor(share + F.lit(0.5)).cast("long"))
    return t.withColumn("all_slots", F.sum("slots").over(W.partitionBy()))


def _rng(seed: int, *key) -> np.random.Generator:
    """A generator of its own for each key."""
    return np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.sha256(repr((seed, *key)).encode()).digest()[:16], "little")))


def draws(plan: DataFrame, shard: int, seed: int) -> DataFrame:
    """How many slots each source gets in each shard, and the first of their ranks: source, blocks, shard, first, n.

    Given the sources' totals, a source's slots fall on the shards independently and alike: its counts are multinomial
    over the shards, and a shard's counts over the sources follow the target shares.
    """
    spark = plan.sparkSession
    rows = plan.where("slots > 0").select("source", "blocks", "slots").collect()  # a row for each source
    sources = sorted(((r["source"], r["blocks"], r["slots"]) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))
    shards = max(1, -(-sum(n for _, _, n in sources) // shard))
    per = max(64, -(-shards // 65_536))  # shards in a group
    first = np.arange(0, shards, per)
    size = np.minimum(shards - first, per)
    counts = np.array([_rng(seed, name).multinomial(n, size / shards) for name, _, n in sources], np.int64).reshape(len(sources), len(first))
    before = np.cumsum(counts, 1) - counts
    groups = pa.table({"shard": first, "size": size, "counts": pa.array(counts.T.tolist(), pa.list_(pa.int64())), "before": pa.array(before.T.tolist(), pa.list_(pa.int64()))})

    def draw(batches):
        for b in batches:
            for lead, n, counts, before in zip(*(b[c].to_pylist() for c in ("shard", "size", "counts", "before")), strict=True):
                for (name, blocks, _), total, at in zip(sources, counts, before, strict=True):
                    own = _rng(seed, name, lead).multinomial(total, np.full(n, 1 / n)).astype(np.int64)
                    some = np.flatnonzero(own)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array([blocks] * len(some), pa.int64()), pa.array(lead + some), pa.array(at + (np.cumsum(own) - own)[some]), pa.array(own[some])], ["source", "blocks", "shard", "first", "n"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = spark.createDataFrame(groups).repartition(min(n, len(first)))
    return dealt.mapInArrow(tidy(draw), "source string, blocks long, shard long, first long, n long").repartition(n, "shard")


def slots(drawn: DataFrame, seed: int) -> DataFrame:
    """Every slot of the mix: shard, place (by which a shard's slots are ordered), source, rank, epoch and index of its block."""
    s = drawn.withColumn("rank", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    epoch, q = F.floor(F.col("rank") / F.col("blocks")).cast("long"), F.col("rank") % F.col("blocks")
    a, shift = _multiplier(F.col("blocks"), epoch, key, seed), F.pmod(F.xxhash64(key, epoch, F.lit(seed + 2)), F.col("blocks"))
    index = ((q.cast("decimal(20,0)") * a + shift) % F.col("blocks")).cast("long")
    return s.select("source", "shard", F.xxhash64(key, "rank", F.lit(seed + 1)).alias("place"), "rank", epoch.alias("epoch"), index.alias("index"))


def mix_plan(sizes: DataFrame, block: int = 64, shard: int = 4096, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``sizes`` (doc_id, source, size and more) with every document's place, the sources' plan, and the pieces the mix takes.

    Pieces: the columns of ``sizes``, first, shard, place, epoch, from and to (words of the document, end exclusive), one
    row for each block of a document and time that it is taken.
    """
    placed = staged(positions(sizes), "placed")
    plan = staged(planned(source_targets(placed), block), "plan")
    drawn = slots(draws(plan, shard, seed), seed).select(F.col("source").alias("d_source"), "epoch", F.col("index"), "shard", "place")
    spans = placed.where("size > 0").withColumn("index", F.explode(F.sequence(F.floor(F.col("first") / block).cast("long"), F.floor((F.col("first") + F.col("size") - 1) / block).cast("long"))))
    lo = F.greatest(F.lit(0).cast("long"), F.col("index") * block - F.col("first"))
    hi = F.least(F.col("size"), (F.col("index") + 1) * block - F.col("first"))
    spans = spans.select(*placed.columns, F.col("index").alias("b"), lo.alias("from"), hi.alias("to"))
    # merge: the slots look small before they expand, and would be broadcast
    pieces = spans.hint("merge").join(drawn.hint("merge"), F.col("source").eqNullSafe(F.col("d_source")) & (F.col("b") == F.col("index"))).drop("d_source", "b")
    return placed, plan, pieces


def mix_documents(docs: DataFrame, block: int = 64, shard: int = 4096, seed: int = 17) -> DataFrame:
    """How many words of each document the mix takes: doc_id, size, source_size, target, taken, source."""
    placed, plan, pieces = mix_plan(sized(docs), block, shard, seed)
    took = pieces.groupBy(F.col("source").alias("t_source"), F.col("first").alias("t_first")).agg(F.sum(F.col("to") - F.col("from")).alias("words"))
    out = placed.join(took, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("first") == F.col("t_first")) & (F.col("size") > 0), "left")
    p = plan.select(F.col("source").alias("p_source"), "source_size", "target")
    out = out.join(p, F.col("source").eqNullSafe(F.col("p_source")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "source")


def keyed(docs: DataFrame) -> DataFrame:
    """Every row as ``row``, and h1 and h2, 128 bits of hash over its columns (but maps): rows that agree in them are alike."""
    whole = F.struct(*(F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))
    return docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(1), whole).alias("h2"))


def _places(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h1 and h2 of all rows: what the plan needs, without the texts."""
    return keyed(docs).select("row.doc_id", "row.source", size_of(F.col("row.text")).alias("size"), "h1", "h2")


def _with_rows(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """``pieces`` with the row of their document. Texts move once; of rows that are alike, one does for all."""
    one = keyed(docs).withColumn("k", F.row_number().over(W.partitionBy("h1", "h2").orderBy(F.lit(0)))).where("k = 1").drop("k")
    # by merge at every size, so that small inputs show what large ones do
    return pieces.hint("merge").join(one.hint("merge"), ["h1", "h2"])


def mixed_blocks(docs: DataFrame, block: int = 64, shard: int = 4096, seed: int = 17) -> DataFrame:
    """The mix itself: shard, place (from 0 in each shard), source, words and text of every block, in the drawn order.

    A shard's slots are ordered in one task: about ``shard`` of them.
    """
    _, _, pieces = mix_plan(_places(docs), block, shard, seed)
    both = _with_rows(docs, pieces)
    words = F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), (F.col("from") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int"))
    parts = both.select("shard", "place", "source", F.struct("first", words.alias("words")).alias("part"))
    blocks = parts.groupBy("shard", "place", "source").agg(F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda x: x["words"])).alias("all"))
    order = W.partitionBy("shard").orderBy("place", F.col("source").asc_nulls_last())
    return blocks.select("shard", (F.row_number().over(order) - 1).alias("place"), "source", F.size("all").alias("words"), F.array_join("all", " ").alias("text"))


def mixed_documents(docs: DataFrame, block: int = 64, shard: int = 4096, seed: int = 17) -> DataFrame:
    """The mix as documents with the columns of ``docs``: one row for each document and epoch that takes words of it.

    A document taken whole keeps its text; of one taken in part the taken words stay, in order, with single spaces.
    A column n_chars gets the length of the new text.
    """
    _, _, pieces = mix_plan(_places(docs), block, shard, seed)
    took = pieces.groupBy("h1", "h2", "first", "size", "epoch").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"), F.sum(F.col("to") - F.col("from")).alias("words"))
    both = _with_rows(docs, took)
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform("spans", lambda x: F.slice(words, (x["from"] + 1).cast("int"), (x["to"] - x["from"]).cast("int")))), " ")
    out = both.withColumn("new", F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(part))
    col = lambda c: F.col("new").alias(c) if c == "text" else F.length("new").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col("row")[c].alias(c)
    return out.select(*map(col, docs.columns))
