"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by the ordered list of its nearest reference points (pivots). Inverted lists hold, per pivot, the
vectors that have it among their nearest; two vectors that share `SHARED` pivots or more are candidates, and a
candidate pair is verified by its cosine in double precision. Vectors of equal label and components are one class.

Pivots are fitted on a bounded sample: of SAMPLE classes, chosen by hash, PIVOTS are taken one after another, each as far
as possible from those before, so that a large group of near copies gives no crowd of alike pivots. Every vector
is indexed. With 512 pivots and 6 nearest ones, pairs at a cosine of 0.98 in 64 dimensions share two pivots
with a measured probability above 0.999, other pairs with one of 0.003.

Sizes: a list longer than BLOCK is dealt into blocks by hash, and each pair of blocks is compared by a task of its own
as one matrix product. A pair is counted in the list of its smallest shared pivot only. Pairs are never rows: a block
pair gives each vector's number of links and a forest of its links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flagstone.llm.common import groups_of, partitions, stored
from flagstone.llm.components import Forest, components, smallest_keys

PIVOTS, SAMPLE, NEAREST, SHARED = 512, 4096, 6, 2
BLOCK = 1024
STEP_NUMBERS = 1 << 21  # numbers of the vectors that a task describes at a time
SAMPLE_NUMBERS = 1 << 25  # the sample has fewer classes where vectors are so long that it would hold more numbers


def vectors_of(column: pa.Array, width: int) -> np.ndarray:
    """List values as rows of doubles, filled with zeros up to `width`."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True, initial=0)  # else squares of tiny numbers vanish
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def fit_pivots(classes: DataFrame, width: int) -> np.ndarray:
    """PIVOTS unit vectors (fewer from a small table) of a sample of SAMPLE classes, each far from the others."""
    most = max(1, min(SAMPLE, SAMPLE_NUMBERS // max(1, width)))
    rows = classes.select("embedding").orderBy(F.xxhash64("node"), "node").limit(most).toArrow()
    sample = unit(vectors_of(rows.column(0).combine_chunks(), width))
    if not len(sample):
        return sample
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(PIVOTS, len(sample)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    return sample[chosen]


def nearest_pivots(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of the nearest pivots of each vector, nearest first."""
    near = units @ pivots.T
    k = min(NEAREST, len(pivots))
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1)


def links_between(units, prefixes, pivot: int, shared: int, least: float, same: bool, split: int):
    """Positions `(x, y)` of the linked pairs of a list whose smallest shared pivot is `pivot`: x before `split` and y after
    it, or both among all rows if `same`. The product in single precision only leaves out what is clearly apart."""
    n = len(units)
    left, right = (range(0, n), 0) if same else (range(0, split), split)
    single = units.astype(np.float32)
    for at in range(0, len(left), 256):
        rows = np.arange(at, min(at + 256, len(left)))
        x, y = np.nonzero(single[rows] @ single[right:].T >= least - 1e-4)
        x, y = rows[x], y + right
        if same:
            x, y = x[x < y], y[x < y]
        for cut in range(0, len(x), 200_000):
            a, b = x[cut:cut + 200_000], y[cut:cut + 200_000]
            common = np.zeros(len(a), dtype=np.int64)
            first = np.full(len(a), np.iinfo(np.int64).max)
            for i in range(prefixes.shape[1]):
                hit = (prefixes[a, i][:, None] == prefixes[b]).any(axis=1)
                common += hit
                first = np.where(hit, np.minimum(first, prefixes[a, i]), first)
            keep = (common >= shared) & (first == pivot)
            a, b = a[keep], b[keep]
            exact = np.einsum("ij,ij->i", units[a], units[b]) >= least
            yield a[exact], b[exact]


def near_vectors(vectors: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: key, n_links, component_id (the smallest key reachable over links), kept.

    Vectors of equal label link when their cosine is `least` or more. Those that are null, empty, zero, of a null label or
    with null or non-finite components link with nothing, and so do vectors of different lengths. Rows that repeat a
    key are vectors of their own; a null key is larger than any other. Very long vectors are compared whole and make no other
    larger. An empty table gives no rows.
    """
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    name = F.concat(F.hex(F.xxhash64(F.lit(0), "label", "embedding")), F.lit("-"), F.hex(F.xxhash64("embedding", "label", F.lit(1))))
    rows = rows.withColumn("node", F.when(good, name))
    narrow = stored(rows.select("vec_id", "node"), "vectors")
    classes = stored(
        rows.filter("node is not null").groupBy("node").agg(
            F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"), F.count(F.lit(1)).alias("size"),
            F.min("vec_id").alias("first")),
        "vector-classes")
    width = classes.agg(F.max(F.size("embedding"))).first()[0] or 0
    pivots = fit_pivots(classes, width)
    shared = min(SHARED, len(pivots))
    kind = rows.schema["label"].dataType.simpleString()

    def index(batches):
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                # Vectors of one length at a time, in steps of bounded memory: none is padded to the longest of the table.
                of_size = np.flatnonzero(sizes == size)
                for at in range(0, len(of_size), max(1, STEP_NUMBERS // size)):
                    part = batch.take(pa.array(of_size[at:at + max(1, STEP_NUMBERS // size)]))
                    units = unit(vectors_of(part.column(2), size))
                    near = nearest_pivots(units, pivots[:, :size])
                    k = near.shape[1]
                    take = pa.array(np.repeat(np.arange(len(units)), k))
                    cells = pa.array([u.tobytes() for u in units], pa.binary())
                    prefix = pa.array([n.astype("<i8").tobytes() for n in near], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(1).take(take), pa.array(np.full(len(take), size, np.int32)), pa.array(near.ravel().astype(np.int32)), part.column(0).take(take),
                         part.column(3).take(take), prefix.take(take), cells.take(take)],
                        names=["label", "width", "pivot", "node", "size", "prefix", "unit"])

    postings = classes.select("node", "label", "embedding", "size").mapInArrow(
        index, f"label {kind}, width int, pivot int, node string, size long, prefix binary, unit binary")
    lists = ["label", "width", "pivot"]
    long = stored(postings.groupBy(*lists).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK), "long-lists")
    dealt = (
        postings.join(long, lists, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*lists, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "size", "prefix", "unit")
    )

    def compare(batches):
        for group in groups_of(batches, 5):
            if group.num_rows < 2:
                continue
            nodes, sizes = group.column("node").to_pylist(), group.column("size").to_numpy()
            units = np.frombuffer(b"".join(group.column("unit").to_pylist()), "<f8").reshape(len(nodes), -1)
            prefixes = np.frombuffer(b"".join(group.column("prefix").to_pylist()), "<i8").reshape(len(nodes), -1)
            same = group.column("i")[0] == group.column("j")[0]
            split = int((group.column("own").to_numpy() == group.column("i")[0].as_py()).sum())
            links, forest = np.zeros(len(nodes), np.int64), Forest()
            for a, b in links_between(units, prefixes, group.column("pivot")[0].as_py(), shared, least, same, split):
                np.add.at(links, a, sizes[b])
                np.add.at(links, b, sizes[a])
                for x, y in zip(a.tolist(), b.tolist()):
                    forest.join(x, y)
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nodes[i] for i in some]), pa.array([nodes[forest.root(i)] for i in some.tolist()]), pa.array(links[some])],
                    names=["a", "b", "n"])

    order = [*lists, "i", "j"]
    found = stored(
        dealt.repartition(partitions(vectors), *order).sortWithinPartitions(*order, "own").mapInArrow(compare, "a string, b string, n long"),
        "vector-links")
    roots = components(found.select("a", "b"))
    others = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    per_class = (
        classes.select("node", "first", "size").join(smallest_keys(classes, roots), "node").join(others, "node", "left")
        .select("node", "component", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    )
    out = narrow.join(stored(per_class, "vector-results"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select(
        F.col("vec_id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))
