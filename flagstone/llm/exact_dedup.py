"""Exact dedup by counting quotient filters.

Every task builds counting quotient filters over the 64-bit fingerprints of its rows: the top bits give the shard, the
next bits the quotient (a place), the rest is the stored remainder; occupied and run-end bits tie the sorted
remainders to their places, and a counter stands beside each remainder. Filters of one shard keep whole
fingerprints, so they merge without loss by merging sorted remainders. Fingerprints with a count above one route
their rows to a grouping by the text bytes themselves, which alone decides equality.

Large groups: filters hold one entry per distinct fingerprint and task, and the grouping by bytes combines in the map
task, so a text that a third of all rows share costs one row per task in either shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flagstone.llm.common import delete_white, pack, partitions, stored, unpack

# Fingerprints gathered before a task closes a filter; bounds its memory.
FILTER_ROWS = 1_000_000


def build_filter(values: np.ndarray, counts: np.ndarray, low_bits: int) -> list[bytes]:
    """The filter of sorted distinct values of `low_bits` bits: header, occupied bits, run ends, remainders, counters."""
    q = max(1, min(low_bits - 1, math.ceil(math.log2(len(values) + 1))))
    r = low_bits - q
    quotients = (values >> np.uint64(r)).astype(np.int64)
    occupied = np.zeros(1 << q, dtype=bool)
    occupied[quotients] = True
    run_end = np.ones(len(values), dtype=bool)
    run_end[:-1] = quotients[1:] != quotients[:-1]
    remainders = values & np.uint64((1 << r) - 1)
    # Only the bytes that r bits need.
    narrow = remainders.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - (r + 7) // 8:]
    return [np.array([q, r, len(values)], dtype="<i8").tobytes(), pack(np.packbits(occupied)), pack(np.packbits(run_end)),
            pack(narrow), pack(counts.astype("<i8"))]


def read_filter(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted values and counts that a filter holds."""
    q, r, n = (int(x) for x in np.frombuffer(parts[0], dtype="<i8"))
    places = np.flatnonzero(np.unpackbits(unpack(parts[1], np.uint8), count=1 << q))
    ends = np.unpackbits(unpack(parts[2], np.uint8), count=n)
    run = np.concatenate([[0], np.cumsum(ends)[:-1]]).astype(np.int64)
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, 8 - (r + 7) // 8:] = unpack(parts[3], np.uint8).reshape(n, -1)
    values = (places[run].astype(np.uint64) << np.uint64(r)) | wide.view(">u8").ravel().astype(np.uint64)
    return values, unpack(parts[4], "<i8")


def merge_filters(filters: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Values and summed counts of several filters of one shard, by merging their sorted remainders."""
    read = [read_filter(f) for f in filters]
    values, counts = (np.concatenate(x) for x in zip(*read))
    order = np.argsort(values, kind="stable")  # a merge of sorted runs
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.add.reduceat(counts, first)


def repeated_fingerprints(prints: DataFrame) -> DataFrame:
    """Of a table with one long column `fp`: the values that more than one row has."""
    shard_bits = max(4, math.ceil(math.log2(4 * partitions(prints))))
    low_bits = 64 - shard_bits
    mask = np.uint64((1 << low_bits) - 1)

    def rows(values):
        values, counts = np.unique(np.concatenate(values), return_counts=True)
        shards, starts = np.unique(values >> np.uint64(low_bits), return_index=True)
        ends = [*starts[1:], len(values)]
        built = [build_filter(values[a:b] & mask, counts[a:b], low_bits) for a, b in zip(starts, ends)]
        return pa.RecordBatch.from_arrays(
            [pa.array(shards.astype(np.int32)), pa.array(built, pa.list_(pa.binary()))], names=["shard", "filter"])

    def build(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            n += len(held[-1])
            if n >= FILTER_ROWS:
                yield rows(held)
                held, n = [], 0
        if n:
            yield rows(held)

    def merge(table: pa.Table) -> pa.Table:
        values, counts = merge_filters(table.column("filter").to_pylist())
        shard = np.uint64(table.column("shard")[0].as_py()) << np.uint64(low_bits)
        return pa.table({"fp": pa.array((values[counts > 1] | shard).view(np.int64))})

    filters = prints.select("fp").mapInArrow(build, "shard int, filter array<binary>")
    return filters.groupBy("shard").applyInArrow(merge, "fp long")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null counts as empty. The row with most code points stays,
    then the smallest key. A null key is larger than any other; rows that repeat a key share its decision (`kept` is
    `key = keep_id`) and each counts in group_size. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    norm = delete_white(F.col("text"))
    narrow = rows.withColumn("norm", norm).select(
        "doc_id", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256"))
    narrow = stored(narrow, "exact-prints")
    repeated = stored(repeated_fingerprints(narrow), "exact-repeated")
    suspects = rows.withColumn("norm", norm).withColumn("fp", F.xxhash64("norm")).join(repeated, "fp", "left_semi")
    # Equal bytes, and nothing else, make a group. Null is lowest in a struct, so whether the key is null comes first.
    best = F.min(F.struct((-F.length("text")).alias("n"), F.col("doc_id").isNull().alias("no_key"), "doc_id"))
    classes = (
        suspects.groupBy("norm").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select(F.sha2("norm", 256).alias("text_sha256"), F.col("best.doc_id").alias("keep_id"), "group_size")
    )
    classes = stored(classes, "exact-classes")
    out = narrow.join(classes, "text_sha256", "left")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("doc_id").alias(key), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )
