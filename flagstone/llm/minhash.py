"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

Sketch: rounds of hashed bin placement. In round i < t every shingle is hashed anew into one of t bins, where the
smallest (round, hash) stays; in round t + b all shingles compete for bin b alone. So every bin fills after 2t
rounds at most, and usually after one. A coordinate of two sets agrees with a probability of their similarity,
with the concentration of independent samples. Bins are cut into bands; equal bands make a bucket.

Verification is exact and on whole sets. Documents of equal sets are one class. Every member of a bucket is
compared with the bucket's first and last class, which settles most buckets: all their members are then in one
component, or all pairs have been compared. In the others, members outside the bucket's largest component meet further
hubs from it, round by round. What is still open is compared in blocks: each member outside the largest component with all
members of the bucket that it is not connected to. Only connectivity is wanted, so connected pairs need no comparison.

Sizes: a bucket is never one group. Members of a hot bucket meet a hub in as many tasks as there are partitions (the
hub's set goes to each), one member in memory at a time; a block holds about BLOCK_BYTES of sets. A member is sent to as many
blocks as the other side has, which is one unless the sets outside the largest component are larger than a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flagstone.llm.common import MIX, mixed, partitions, shingles, stored, texts
from flagstone.llm.components import Forest, components, smallest_keys
from flagstone.plans.shared import hint_if_small

# Bytes of sets in a block, and the rounds of hubs before blocks are compared.
BLOCK_BYTES, ROUNDS = 1 << 24, 4


class Sketcher:
    """Fast similarity sketches of `size` coordinates."""

    def __init__(self, size: int, seed: int = 1):
        self.size = size
        with np.errstate(over="ignore"):
            self.seeds = mixed((np.arange(2 * size, dtype=np.uint64) + np.uint64(seed)) * MIX[0])

    def __call__(self, items: np.ndarray) -> np.ndarray:
        """The sketch of a set of distinct 64-bit hashes (not empty). It depends on the set alone."""
        t, none = self.size, np.uint64(2**64 - 1)
        out = np.full(t, none, dtype=np.uint64)
        low, step = np.uint64((1 << 48) - 1), max(1, -(-2 * t // len(items)))
        done = 0
        with np.errstate(over="ignore"):
            while done < t and (out == none).any():
                # Several rounds at a time for small sets; in a bin the earliest round is smallest, so no harm.
                rounds = np.arange(done, min(t, done + step), dtype=np.uint64)
                h = mixed((items[None, :] ^ self.seeds[done:done + len(rounds), None]) * MIX[0])
                bins = ((h >> np.uint64(48)) * np.uint64(t)) >> np.uint64(16)
                np.minimum.at(out, bins.ravel().astype(np.intp), ((rounds[:, None] << np.uint64(48)) | (h & low)).ravel())
                done += len(rounds)
            for b in np.flatnonzero(out == none):
                h = mixed((items ^ self.seeds[t + b]) * MIX[0])
                out[b] = (np.uint64(t + b) << np.uint64(48)) | (h & low).min()
        return out

    def bands(self, items: np.ndarray, rows: int) -> list[int]:
        sketch = self(items)
        n = self.size // rows
        keys = [xxhash.xxh3_64_intdigest(sketch[i * rows:(i + 1) * rows].tobytes(), i) for i in range(n)]
        return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def set_key(items: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return xxhash.xxh3_128_digest(items.tobytes())


def alike(a: int, b: int, shared, percent: int):
    """100 * intersection >= percent * union, in whole numbers."""
    return 100 * shared >= percent * (a + b - shared)


def shared_with(items: np.ndarray, others: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sorted set `items` with each of the sets that lie in `others`."""
    at = np.searchsorted(items, others)
    at[at == len(items)] = 0
    return np.add.reduceat((items[at] == others).astype(np.int64), starts)


def _sketched(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        sketcher = Sketcher(bands * rows)
        for batch in batches:
            sizes, keys, buckets = [], [], []
            for text in texts(batch.column(1)):
                s = shingles(text, width)
                sizes.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                buckets.append(sketcher.bands(s, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(buckets, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "node", "buckets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, node binary, buckets array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """`(node, items)`: the whole shingle sets of the classes `wanted (doc_id, node)`, each once."""
    def run(batches):
        seen = set()  # of the partition's classes; copies under one key are many rows
        for batch in batches:
            nodes, items = [], []
            for text, node in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                if node in seen:
                    continue
                s = shingles(text, width)
                if set_key(s) == node:  # a repeated key may stand for another text
                    seen.add(node)
                    nodes.append(node)
                    items.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(items, pa.binary())], names=["node", "items"])

    # Narrow rows, broadcast only where their counted number is small; else texts are shuffled by key.
    ids = hint_if_small(wanted.select(F.col("doc_id").alias("_id"), "node"), wanted.count())
    found = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "node")
    return found.mapInArrow(run, "node binary, items binary").dropDuplicates(["node"])


def _linked_to_hub(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs `(hub, node)`: those whose whole sets are similar enough."""
    n = partitions(pairs)
    # A hub's members are spread over its salts; one salt for each thousand members, so few hubs have several.
    sized = pairs.groupBy("hub").agg(F.least(F.lit(n), F.ceil(F.count(F.lit(1)) / 1000)).cast("int").alias("salts"))
    sized = stored(sized, "hubs")
    members = (
        pairs.join(sized, "hub").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
        .join(sets, "node").select("hub", "salt", F.lit(1).alias("side"), "node", "items")
    )
    hubs = (
        sized.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .join(sets.withColumnRenamed("node", "hub"), "hub").select("hub", "salt", F.lit(0).alias("side"), F.col("hub").alias("node"), "items")
    )

    def run(batches):
        # Sorted so that a hub's own set comes before its members.
        hub, own = None, None
        for batch in batches:
            a, b = [], []
            sides = batch.column(2).to_pylist()
            for key, side, node, items in zip(batch.column(0).to_pylist(), sides, batch.column(3).to_pylist(), batch.column(4)):
                s = np.frombuffer(items.as_buffer(), dtype=np.uint64)
                if side == 0:
                    hub, own = key, s.copy()
                    continue
                if key != hub:
                    raise ValueError("the set of a class is missing")
                if alike(len(own), len(s), len(np.intersect1d(own, s, assume_unique=True)), percent):
                    a.append(hub)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    dealt = hubs.unionByName(members).repartition(n, "hub", "salt").sortWithinPartitions("hub", "salt", "side")
    return dealt.mapInArrow(run, "a binary, b binary")


def _open_members(inner: DataFrame, roots: DataFrame) -> DataFrame:
    """Members `(bucket, node, size, root, top)` of the buckets that have several components, with their own and the largest."""
    now = inner.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counted = now.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    tops = counted.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    return now.join(tops.select("bucket", F.col("top.root").alias("top")), "bucket").select("bucket", "node", "size", "root", "top")


def _hub_pairs(members: DataFrame, turn: int) -> DataFrame:
    """`(hub, node)`: members outside their bucket's largest component, with one class of that component; another each turn."""
    hubs = members.filter("root = top").groupBy("bucket").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("hub"))
    return members.filter("root <> top").join(hubs, "bucket").select("hub", "node").distinct()


def _linked_in_blocks(members: DataFrame, sets: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Links between open members of a bucket with different roots, of which one is outside the bucket's largest component."""
    outside = F.col("root") != F.col("top")
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(8 * size / block_bytes)).cast("int")
    sized = members.groupBy("bucket").agg(
        blocks(F.sum(F.when(outside, F.col("size")).otherwise(0))).alias("lefts"), blocks(F.sum("size")).alias("rights"))
    rows = members.join(sized, "bucket")
    place = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.filter(outside).withColumn("i", place(1, F.col("lefts"))).withColumn("j", each("rights"))
    right = rows.withColumn("j", place(2, F.col("rights"))).withColumn("i", each("lefts"))
    columns = ["bucket", "i", "j", "node", "root"]
    dealt = left.select(*columns, F.lit(0).alias("side")).unionByName(
        right.select(*columns, F.when(outside, 1).otherwise(2).alias("side"))).join(sets, "node")

    def run(table: pa.Table) -> pa.Table:
        nodes, roots = (table.column(c).to_pylist() for c in ("node", "root"))
        side = table.column("side").to_numpy()
        sets_here = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("items").combine_chunks()]
        known, a, b = Forest(), [], []
        for n, r in zip(nodes, roots):
            known.join(n, r)
        sizes, right_rows = np.array([len(s) for s in sets_here]), np.flatnonzero(side)
        for x in np.flatnonzero(side == 0):
            top = known.root(nodes[x])
            # Two members outside the largest component meet twice; the smaller asks.
            against = [y for y in right_rows if (side[y] == 2 or nodes[y] > nodes[x]) and known.root(nodes[y]) != top]
            if not against:
                continue
            starts = np.concatenate([[0], np.cumsum(sizes[against])[:-1]])
            shared = shared_with(sets_here[x], np.concatenate([sets_here[y] for y in against]), starts)
            for y in np.array(against)[alike(sizes[x], sizes[against], shared, percent)]:
                if known.join(nodes[x], nodes[y]):
                    a.append(nodes[x])
                    b.append(nodes[y])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(run, "a binary, b binary")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, bands: int = 24, rows: int = 5,
    rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the smallest key reachable over links), kept.

    A link is a similarity of the sets of `width`-word shingles of `percent` in a hundred or more. With 24 bands of 5 rows
    a pair at 80 (85) in a hundred shares no bucket with a probability of 7e-5 (8e-7). Null text counts as empty; a
    text without words has no shingles, links with nothing and stays. Rows that repeat a key are documents of their
    own that share the smaller component; a null key is larger than any other. An empty table gives no rows.
    """
    rows_in = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    narrow = stored(_sketched(rows_in, width, bands, rows), "sketches")
    classes = stored(
        narrow.filter("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("first"), F.any_value("n_shingles").alias("size"), F.any_value("buckets").alias("buckets")),
        "classes")
    members = classes.select("node", "size", F.explode("buckets").alias("bucket"))
    # Buckets with the same members are settled once: the sum of hashes names the members.
    named = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members"), F.min("node").alias("first"), F.max("node").alias("last"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"))
    shared = (
        named.filter("members > 1").groupBy("members", "first", "last", "sum").agg(F.min("bucket").alias("bucket"))
        .select("bucket", "members", "first", "last")
    )
    shared = stored(shared, "buckets")
    ends = shared.select(F.col("first").alias("hub"), F.col("last").alias("node"))
    inner = stored(members.join(shared.filter("members > 2"), "bucket"), "inner-members")
    inner_rows = inner.filter("node <> first and node <> last")
    pairs = stored(
        ends.union(inner_rows.select("first", "node")).union(inner_rows.select("last", "node")).distinct(), "pairs")
    wanted = pairs.select("node").union(pairs.select("hub")).distinct().join(classes.select("node", F.col("first").alias("doc_id")), "node")
    wanted = stored(wanted, "wanted-sets")
    sets = stored(_sets(rows_in, wanted, width), "sets")
    links = stored(_linked_to_hub(pairs, sets, percent), "links")
    roots = components(links)
    # Buckets of four and more, of which some members are not connected yet.
    unsettled = stored(_open_members(inner.filter("members > 3").select("bucket", "node", "size"), roots), "open-members")
    for turn in range(rounds):
        if unsettled.isEmpty():
            break
        more = stored(_linked_to_hub(_hub_pairs(unsettled, turn), sets, percent), "more-links")
        if more.isEmpty():
            break
        links = links.union(more)
        roots = components(links)
        unsettled = stored(_open_members(unsettled.select("bucket", "node", "size"), roots), "open-members")
    more = stored(_linked_in_blocks(unsettled, sets, percent, block_bytes), "block-links")
    if not more.isEmpty():
        roots = components(links.union(more))
    found = smallest_keys(classes, roots)
    out = narrow.select("doc_id", "n_shingles", "node").join(stored(found, "found"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select(
        F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
