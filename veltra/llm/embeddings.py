"""Near-duplicate vectors by an epsilon grid order join.

Vectors of one label and one length are compared. They are normalised, and their principal axes (fitted on a bounded
sample; a rotation keeps distances, so the sample decides speed only) give the leading dimensions. Cosine >= c means
distance <= sqrt(2 - 2c) =: epsilon. Vectors are put in epsilon grid order: by label and length, then by the grid cells
of the leading dimensions, one after the other. The order is cut into intervals, whose boxes in the leading dimensions
say which pairs of intervals may hold partners. Pairs meet through cells of width epsilon on the first two axes, and
provably distant ones are skipped; of the others, the vectors that come near the partner's box are joined by halving both intervals again and again, skipping distant
halves, down to small blocks that a matrix product compares. A found pair is then checked in double precision on the
given components, scaled by a power of two, which changes no digit.

Equal vectors of a label are one class first; a class's size counts towards its links. A block pair returns link counts
per class and a spanning forest of its links, never all pairs.

Edge cases: vectors that are null, zero or hold null or non-finite components, and vectors without label, link with
nothing and are kept; vectors of other lengths link among themselves; rows with equal ids are vectors of their own, and
copies of one another if their vectors match; a null id's row is left as it is; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veltra.llm.common import components, removed, staged, tidy

LEADING = 6  # grid dimensions
CELL_AXES = 2  # those by whose cells intervals meet
SAMPLE_VALUES = 4_000_000  # components of the sample that fits the axes
INTERVAL_VALUES = 1 << 20  # components in an interval: 8 MB


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to between 1/2 and 1: exact, whatever their size."""
    x = x.astype(np.float64)
    _, e = np.frexp(np.abs(x).max(1, keepdims=True))
    return np.ldexp(x, -e)


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def axes(vectors: DataFrame, most: int = 10_000) -> dict[int, np.ndarray]:
    """By length of vector, the leading principal axes, as columns, of at most ``most`` vectors chosen by a hash.

    The sample holds at most ``SAMPLE_VALUES`` components, and 100 vectors or more. Lengths that are not in it keep their own axes.
    """
    longest = vectors.agg(F.max("size")).first()[0] or 1
    rows = vectors.select("v").orderBy(F.xxhash64("v")).limit(max(100, min(most, SAMPLE_VALUES // longest))).toArrow()["v"].combine_chunks()
    sizes = rows.value_lengths().to_numpy()
    found = {}
    for n in np.unique(sizes).tolist():
        x = unit(matrix(rows.take(pa.array(np.flatnonzero(sizes == n)))))
        x -= x.mean(0)
        _, by_size = np.linalg.eigh(x.T @ x)
        found[n] = by_size[:, ::-1][:, :LEADING].copy()  # the largest first
    return found


def leading(u: np.ndarray, turn: dict[int, np.ndarray]) -> np.ndarray:
    """The leading dimensions of unit vectors of one length, and zeros where there are fewer."""
    n = u.shape[1]
    x = u @ turn[n] if n in turn else u[:, :LEADING]
    return np.pad(x, ((0, 0), (0, LEADING - x.shape[1])))


def union_find(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """The pairs that join two parts: a spanning forest."""
    parent = list(range(n))
    forest = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a, b in pairs:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                forest.append((i, j))
    return forest


def block_links(a: np.ndarray, b: np.ndarray | None, lead_a: np.ndarray, lead_b: np.ndarray | None, cosine: float, small: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index in a, index in b) with at least that cosine; b None: pairs of a with itself, i < j.

    ``a``, ``b``: given components, scaled, in epsilon grid order; ``lead_a``, ``lead_b``: leading dimensions of their unit vectors.
    """
    eps = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    own = b is None
    b, lead_b = (a, lead_a) if own else (b, lead_b)
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    r, s = (a / na[:, None]).astype(np.float32), (b / nb[:, None]).astype(np.float32)

    def distant(i0: int, i1: int, j0: int, j1: int) -> bool:
        x, y = lead_a[i0:i1], lead_b[j0:j1]
        gap = np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
        return bool((gap * gap).sum() > eps * eps)

    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 >= i1 or j0 >= j1 or own and j1 <= i0 or distant(i0, i1, j0, j1):
            continue
        if max(i1 - i0, j1 - j0) > small:
            if i1 - i0 >= j1 - j0:
                m = (i0 + i1) // 2
                todo += [(i0, m, j0, j1), (m, i1, j0, j1)]
            else:
                m = (j0 + j1) // 2
                todo += [(i0, i1, j0, m), (i0, i1, m, j1)]
            continue
        near = r[i0:i1] @ s[j0:j1].T >= cosine - 1e-3  # far beyond what single precision may err by
        i, j = np.nonzero(near)
        i, j = i + i0, j + j0
        if own:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 14):  # the verdict: double precision on the given components
            p, q = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            ok = (a[p] * b[q]).sum(1) / (na[p] * nb[q]) >= cosine
            if ok.any():
                yield p[ok], q[ok]


def near_vectors(table: DataFrame, cosine: float = 0.98, interval: int | None = None, most_sample: int = 10_000) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    ``interval``: vectors in an interval, else as many as hold ``INTERVAL_VALUES`` components. A task holds two intervals;
    the larger they are, the fewer pairs of them there are, and the less often a vector moves.
    """
    spark = table.sparkSession
    given = table.schema["embedding"].dataType
    value = "float" if isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType) else "double"  # what holds every component
    d = table.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding").cast(f"array<{value}>").alias("v"))
    good = F.coalesce(
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    # 0.0 and -0.0 are one value; a class is a label's equal vectors
    d = d.withColumn("v", F.when(good, F.transform("v", lambda x: (x + F.lit(0.0)).cast(value)))).withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.array_join("v", ","), 256)))
    member = staged(d.select("vec_id", "label", "key"), "members")
    classes = d.where("v is not null").groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("cid"), "label", "key", "rep", "n", F.size("v").alias("size"), "v"), "classes")
    turn = axes(classes, most_sample)
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9)

    def rotate(batches):
        for b in batches:
            size = b["size"].to_numpy()
            lead = np.zeros((b.num_rows, LEADING))
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                lead[at] = leading(unit(matrix(b["v"].take(pa.array(at)))), turn)
            cells = np.floor(lead / eps).astype(np.int32)
            listed = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), LEADING).cast(pa.list_(pa.from_numpy_dtype(x.dtype)))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("label", "size", "cid", "n", "v")), listed(cells), listed(lead)], ["label", "size", "cid", "n", "v", "cells", "lead"])

    schema = f"label {dict(d.dtypes)['label']}, size int, cid long, n long, v array<{value}>, cells array<int>, lead array<double>"
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = classes.select("label", "size", "cid", "n", "v").mapInArrow(tidy(rotate), schema)
    # epsilon grid order, cut to intervals within the range partitions
    kind = ("label", "size")
    ordered = rows.repartitionByRange(n_parts, *kind, "cells", "cid").withColumn("part", F.spark_partition_id())
    own = W.partitionBy("part", *kind).orderBy("cells", "cid")
    most = F.lit(interval) if interval else F.greatest(F.lit(1), F.floor(F.lit(INTERVAL_VALUES) / F.col("size")))
    ordered = ordered.withColumn("interval", F.concat_ws("/", *kind, "part", F.floor((F.row_number().over(own) - 1) / most)))
    ordered = staged(ordered, "ordered")
    side_of = lambda f: F.array(*[f(F.col("lead")[i]) for i in range(LEADING)])
    boxes = staged(ordered.groupBy(*kind, "interval").agg(side_of(F.min).alias("lo"), side_of(F.max).alias("hi")), "boxes")

    def in_cells(side: str, margin: float) -> DataFrame:
        """The boxes by every cell that they reach into, with a margin on all sides."""
        out = boxes.select(*[F.col(c).alias(f"{side}_{c}") for c in boxes.columns])
        for i in range(CELL_AXES):
            out = out.withColumn(f"{side}_cell{i}", F.explode(F.sequence(F.floor((F.col(f"{side}_lo")[i] - margin) / eps), F.floor((F.col(f"{side}_hi")[i] + margin) / eps))))
        return out

    def apart(lo: str, hi: str, other_lo: str, other_hi: str):
        """The square of the distance between two boxes."""
        gap = lambda i: F.greatest(F.lit(0.0), F.col(lo)[i] - F.col(other_hi)[i], F.col(other_lo)[i] - F.col(hi)[i])
        return sum((gap(i) * gap(i) for i in range(LEADING)), F.lit(0.0))

    same = [F.col(f"x_{c}") == F.col(f"y_{c}") for c in (*kind, *(f"cell{i}" for i in range(CELL_AXES)))]
    near = in_cells("x", eps).join(in_cells("y", 0.0), [*same, F.col("x_interval") <= F.col("y_interval"), apart("x_lo", "x_hi", "y_lo", "y_hi") <= eps * eps])
    pairs = staged(near.select(F.col("x_interval").alias("x"), F.col("y_interval").alias("y"), "x_lo", "x_hi", "y_lo", "y_hi").dropDuplicates(["x", "y"]), "pairs")
    # a pair's vectors meet under the pair's key: of either interval those that come within epsilon of the other's box
    own_side = F.struct(F.col("x").alias("interval"), F.col("y_lo").alias("lo"), F.col("y_hi").alias("hi"))
    other_side = F.struct(F.col("y").alias("interval"), F.col("x_lo").alias("lo"), F.col("x_hi").alias("hi"))
    sides = pairs.select("x", "y", F.explode(F.when(F.col("x") == F.col("y"), F.array(own_side)).otherwise(F.array(own_side, other_side))).alias("side")).select("x", "y", "side.*")
    meet = sides.join(ordered.select("interval", "cells", "lead", "cid", "n", "v"), "interval").where(apart("lead", "lead", "lo", "hi") <= eps * eps)
    meet = meet.select("x", "y", "interval", "cells", "cid", "n", "v")

    def links(batches):
        """Rows of a partition, sorted by pair: each pair is at most two intervals of one length."""
        held: dict[str, list[tuple]] = {}
        key = None

        def done():
            x, y = key
            if x != y and len(held) < 2:  # nothing of one of them is near the other
                return pa.RecordBatch.from_arrays([pa.nulls(0, pa.int64())] * 3, ["a", "b", "n"])
            sides = [[np.concatenate(c) for c in zip(*held[i], strict=True)] for i in dict.fromkeys((x, y))]
            vec, cid, n = (np.concatenate(c) for c in zip(*sides, strict=True))
            vec = scaled(vec)
            lead = leading(vec / np.sqrt((vec * vec).sum(1, keepdims=True)), turn)
            m = len(sides[0][1])
            found = block_links(vec, None, lead, None, cosine) if x == y else block_links(vec[:m], vec[m:], lead[:m], lead[m:], cosine)
            count = np.zeros(len(cid), np.int64)

            def counted():
                for p, q in found:
                    q = q if x == y else q + m
                    np.add.at(count, p, n[q])
                    np.add.at(count, q, n[p])
                    yield p, q

            forest = np.array(union_find(len(cid), counted()), np.int64).reshape(-1, 2)
            some = np.flatnonzero(count)
            a = pa.array(np.concatenate([cid[some], cid[forest[:, 0]]]))
            b = pa.chunked_array([pa.nulls(len(some), pa.int64()), pa.array(cid[forest[:, 1]])]).combine_chunks()
            return pa.RecordBatch.from_arrays([a, b, pa.array(np.concatenate([count[some], np.zeros(len(forest), np.int64)]))], ["a", "b", "n"])

        for batch in batches:
            xs, ys, its = (batch[c].to_pylist() for c in ("x", "y", "interval"))
            cid, n = batch["cid"].to_numpy(), batch["n"].to_numpy()
            at = 0
            for k in range(1, len(xs) + 1):
                if k == len(xs) or (xs[k], ys[k], its[k]) != (xs[at], ys[at], its[at]):
                    if key is not None and key != (xs[at], ys[at]):
                        yield done()
                        held = {}
                    key = (xs[at], ys[at])
                    held.setdefault(its[at], []).append((matrix(batch["v"].slice(at, k - at)), cid[at:k], n[at:k]))
                    at = k
        if held:
            yield done()

    found = meet.repartition(n_parts, "x", "y").sortWithinPartitions("x", "y", "interval", "cells", "cid").mapInArrow(tidy(links), "a long, b long, n long")
    found = staged(found, "found")
    for x in (ordered, boxes, pairs):
        removed(spark, x)
    linked = found.where("n > 0").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    group = staged(components(found.where("b is not null").select("a", "b")).select(F.col("id").alias("cid"), "component"), "groups")
    least = group.join(classes.select("cid", "rep"), "cid").groupBy("component").agg(F.min("rep").alias("least"))
    least = group.join(least, "component").select("cid", "least")
    info = classes.select("cid", "label", "key", "rep", "n").join(linked, "cid", "left").join(least, "cid", "left")
    info = info.select(F.col("label").alias("c_label"), F.col("key").alias("c_key"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("least", "rep").alias("least"))
    out = member.join(info, (F.col("label") == F.col("c_label")) & (F.col("key") == F.col("c_key")), "left")
    smallest = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), smallest.alias("component_id"), F.coalesce(smallest == F.col("vec_id"), F.lit(True)).alias("kept"))
