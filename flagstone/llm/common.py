"""What several operators share: stored tables, byte packing, words and shingles, dropping rows by key."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from flagstone.plans.shared import hint_if_small, scratch_path

#: The white space of all contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet below the shared folder and read it back: later steps start from files
    that every executor sees, so a lost executor replays nothing before this point."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have: `name` with as many underscores before it as that takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of `df` whose key is not in `dropped` (one column). A null key equals a null key. The dropped keys
    are stored and counted, and broadcast only where they are few; else rows are shuffled by key."""
    name = unused(df, "_gone")
    gone = stored(dropped.select(F.col(key).alias(name)), "dropped")
    return df.join(hint_if_small(gone, gone.count()), F.col(key).eqNullSafe(F.col(name)), "left_anti")


def with_row_key(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add a struct that tells rows apart by all their columns, in the order of the key (null last). Rows of one struct are
    the same row several times. It is made of values alone, so no task, retry or partitioning changes it."""
    others = F.to_json(F.struct(*[c for c in docs.columns if c != text]))
    digest = F.unhex(F.sha2(F.concat(F.coalesce(F.sha2(text, 256), F.lit("")), others), 256))
    return docs.withColumn(name, F.struct(F.when(F.col(key).isNull(), 1).alias("no_key"), F.col(key).alias(key), digest.alias("digest")))


def kept_once(keyed: DataFrame, decided: DataFrame, name: str) -> DataFrame:
    """Rows of `keyed` but those that `decided` (`name`, kept; one row per row that is in a group) drops; of the rows that
    share a kept struct of `with_row_key` one stays."""
    decided, once = stored(decided.select(name, "kept"), "decided"), unused(keyed, "_again")
    rest = without(keyed, decided.filter("not kept").select(name), name)
    repeated = decided.filter("kept").groupBy(name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(name).alias(once))
    repeated = stored(repeated, "repeated")
    n = repeated.count()
    if not n:
        return rest
    again = rest.join(hint_if_small(repeated, n), F.col(name) == F.col(once), "left_semi")
    return without(rest, repeated.withColumnRenamed(once, name), name).unionByName(again.dropDuplicates([name]))


def delete_white(text: Column) -> Column:
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def pack(numbers: np.ndarray) -> bytes:
    """Compress an array of numbers."""
    return zlib.compress(np.ascontiguousarray(numbers).tobytes(), 1)


def unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype=kind)


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    for x in column:
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def released(made: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of `made`. Arrow gives memory that is not in use back after each of them and at the end: a Python worker
    lives on after its task, and what Arrow keeps for itself then would take from the executor's later steps."""
    for batch in made:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
    pa.default_memory_pool().release_unused()


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased."""
    words = text.lower().split()  # bytes: lowers A-Z only and splits at WHITE only
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Distinct hashed shingles of `width` words, sorted; a shorter text is one shingle, no words give none."""
    h = word_hashes(text)
    if not len(h):
        return h
    width_here = min(width, len(h))
    n = len(h) - width_here + 1
    s = np.full(n, np.uint64(width_here), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width_here):
            s = mixed(s * MIX[0] + h[i:i + n])
    return np.unique(s)


def groups_of(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that follow each other with the same first `keys` columns, group by group, from a sorted partition."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for i in range(keys):
            change |= pc.not_equal(batch.column(i)[1:], batch.column(i)[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(change) + 1), batch.num_rows]
        if held and any(held[-1].column(i)[0] != batch.column(i)[0] for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)
