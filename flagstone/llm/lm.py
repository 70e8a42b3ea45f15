"""Language-model scoring by prediction by partial matching.

The model is a byte-context trie of all training texts: for each context of up to `ORDER` preceding bytes (zero bytes
before a text's start) the counts of the symbols that followed, a symbol being a byte or the end of the text.
With t symbols seen after a context, d of them distinct, a symbol seen n times has the probability (2n - 1) / 2t and the
escape to the next shorter context d / 2t (method D); symbols of the longer context are excluded from the shorter
one's t, d and choices. Below order 0 all symbols not seen yet are equally likely. So probabilities sum to one.

The trie grows with the corpus and is never gathered in one place. Texts are cut into blocks. A block sends its distinct
(context, symbol) pairs, with their counts in training texts, to the shard of the context's last three bytes; there is a
shard per SHARD_BYTES of text, up to MOST_SHARDS, and three last bytes have 256 * 256 * 257 pairs at most. A whole
suffix chain of contexts from order 3 up lies in one shard, so a shard that is also sent the sums of order 2 for its last
two bytes (SUFFIX_GROUPS lists, each of a bounded size) knows each pair's exact probability, which goes back to the blocks that
asked. Shards are salted by block: salts are merged by FAN_IN before a shard is, and a shard's model is sent as many times as its
questions outnumber it, so what is sent grows like the questions. Orders 0 and 1 have at most 256 * 257 cells and go to
every task. Words for the unigram base go the same way, by shards of their hashes. A pair or word costs one entry
per block, however often the block holds it, so frequent ones make no hot group.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from flagstone.llm.common import pack, partitions, stored, texts, unpack

ORDER = 5
END = 256
SYMBOLS = 257
# Text bytes of a block, and those worked on at a time.
BLOCK_BYTES = 16_000_000
STEP_BYTES = 1_000_000
# Blocks whose questions to one shard are one group, and merged groups that are merged at a time.
SALT_BLOCKS, FAN_IN = 512, 16
# A block has a row per shard: at most so many that a row still holds some hundred keys. The last two bytes of contexts
# make up to SUFFIX_GROUPS groups of shards, in which the third decides.
SHARD_BYTES, MOST_SHARDS, SUFFIX_GROUPS = 8_000_000, 16_384, 64
# A key holds the context, nearest byte first, and then the symbol in 9 bits; OWNER_BITS are left for a text's number.
SYMBOL_BITS = 9
TOP = SYMBOL_BITS + 8 * ORDER
OWNER_BITS = 64 - TOP
BLOCK_SCHEMA = "block string, shard int, kind string, a long, b long, data binary"


def segments(text: bytes, step: int):
    """`(context, bytes, last)`: a text in steps, with the bytes before each."""
    for at in range(0, max(1, len(text)), step):
        yield text[max(0, at - ORDER):at].rjust(ORDER, b"\0"), text[at:at + step], at + step >= len(text)


def keys_of(parts: list[tuple[bytes, bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """A key for each symbol of the segments, and the number of symbols of each segment."""
    sizes = np.array([len(text) + last for _, text, last in parts])
    flat = np.frombuffer(b"".join(context + text + b"\0" * last for context, text, last in parts), dtype=np.uint8)
    ends = np.cumsum(sizes + ORDER)
    symbols = flat.astype(np.uint64)
    symbols[ends[[last for *_, last in parts]] - 1] = END
    wide = flat.astype(np.uint64)
    keys = symbols[ORDER:].copy()
    for back in range(1, ORDER + 1):
        keys |= wide[ORDER - back:len(wide) - back] << np.uint64(TOP - 8 * back)
    real = np.ones(len(keys), dtype=bool)
    for start in ends[:-1]:  # the context bytes of each segment but the first
        real[start - ORDER:start] = False
    return keys[real], sizes


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def hashed(numbers: np.ndarray, n: int) -> np.ndarray:
    return ((numbers * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def shard_of(keys: np.ndarray, groups: int, parts: int) -> np.ndarray:
    """The shard of a key: its group is that of the two nearest context bytes, its part that of the nearest three."""
    return hashed(keys >> np.uint64(TOP - 16), groups) * parts + hashed(keys >> np.uint64(TOP - 24), parts)


def shards_for(wanted: int) -> tuple[int, int]:
    """Groups and parts of a group for about `wanted` shards."""
    wanted = min(MOST_SHARDS, wanted)
    groups = min(SUFFIX_GROUPS, wanted)
    return groups, -(-wanted // groups)


def pack_sorted(values: np.ndarray) -> bytes:
    """Rising numbers as differences, byte plane by byte plane."""
    steps = np.diff(values, prepend=np.uint64(0))
    return pack(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def sorted_from(planes: bytes) -> np.ndarray:
    planes = np.frombuffer(planes, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


class Block:
    """Texts of a task, gathered until they make a block."""

    def __init__(self, groups: int, parts_of_group: int, step: int):
        self.name, self.step = uuid.uuid4().hex, step
        self.groups, self.parts_of_group, self.shards = groups, parts_of_group, groups * parts_of_group
        self.keys, self.counts, self.parts = [], [], []
        self.words, self.known, self.batches = Counter(), Counter(), []
        self.bytes = self.held = 0

    def add(self, batch: pa.RecordBatch) -> None:
        """Rows `(doc_id, held_out, text)`."""
        self.batches.append(batch)
        for held_out, text in zip(batch.column(1).to_pylist(), texts(batch.column(2))):
            for part in segments(text, self.step):
                self.parts.append((part, held_out))
                self.held += len(part[1]) + ORDER
                if self.held >= self.step:
                    self._count()
            (self.words if held_out else self.known).update(text.lower().split())
            self.bytes += len(text) + ORDER

    def _count(self) -> None:
        keys, sizes = keys_of([p for p, _ in self.parts])
        held_out = np.repeat(np.array([h for _, h in self.parts], dtype=np.uint64), sizes)
        found, counts = np.unique((keys << np.uint64(1)) | held_out, return_counts=True)
        counts[(found & np.uint64(1)) == 1] = 0  # asked for, not learned from
        self.keys.append(found >> np.uint64(1))
        self.counts.append(counts)
        self.parts, self.held = [], 0

    def rows(self):
        """`(block, shard, kind, a, b, data)`: the texts, low-order counts, and per shard its keys and words."""
        if self.parts:
            self._count()
        keys, counts = summed(np.concatenate(self.keys), np.concatenate(self.counts))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for batch in self.batches:
                out.write_batch(batch)
        low = np.bincount(((keys >> np.uint64(TOP - 8)) * np.uint64(SYMBOLS) + (keys & np.uint64(511))).astype(np.int64), counts, 256 * SYMBOLS)
        yield "texts", -1, 0, 0, sink.getvalue().to_pybytes()
        yield "low", -1, 0, 0, pack(low.astype(np.int64))
        low = [summed(at_order(k[n > 0], 2), n[n > 0]) for k, n in slices(keys, counts)]
        pairs, sums = summed(np.concatenate([k for k, _ in low]), np.concatenate([n for _, n in low]))
        for group, mine in parted(hashed(pairs >> np.uint64(SYMBOL_BITS), self.groups).astype(np.int16)):
            yield "pairs", group, len(mine), 0, pack_counts(pairs[mine], sums[mine])
        own = np.concatenate([shard_of(k, self.groups, self.parts_of_group).astype(np.int16) for k, _ in slices(keys, counts)])
        for shard, mine in parted(own):
            yield "keys", shard, len(mine), 0, pack_counts(keys[mine], counts[mine])
        for shard, words in by_shard(set(self.words) | set(self.known), self.shards):
            n = np.fromiter((self.known[w] for w in words), "<i8", len(words))
            yield "words", shard, len(words), 0, pack(n) + zlib.compress(b" ".join(words), 1)


def slices(keys: np.ndarray, counts: np.ndarray, size: int = 1 << 19):
    """Both arrays in steps, so that what is made of them stays small."""
    for at in range(0, max(1, len(keys)), size):
        yield keys[at:at + size], counts[at:at + size]


def parted(owners: np.ndarray):
    """`(owner, positions)` of each owner, positions rising."""
    if len(owners):
        order = np.argsort(owners, kind="stable")
        cuts = np.flatnonzero(np.diff(owners[order])) + 1
        for mine in np.split(order, cuts):
            yield int(owners[mine[0]]), mine


def pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return pack_sorted(keys) + pack(counts.astype("<i8"))


def by_shard(words: set[bytes], shards: int) -> list[tuple[int, list[bytes]]]:
    """Words by shard, in order: the same lists from the same words."""
    dealt: dict[int, list[bytes]] = {}
    for w in sorted(words):
        dealt.setdefault(xxhash.xxh3_64_intdigest(w) % shards, []).append(w)
    return sorted(dealt.items())


def _frame(rows, block: str) -> pa.RecordBatch:
    kinds, shards, a, b, data = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * len(kinds)), pa.array(shards, pa.int32()), pa.array(kinds), pa.array(a, pa.int64()),
         pa.array(b, pa.int64()), pa.array(data, pa.binary())], names=["block", "shard", "kind", "a", "b", "data"])


def make_blocks(docs: DataFrame, groups: int, parts: int, block_bytes: int, step: int) -> DataFrame:
    def run(batches):
        block = Block(groups, parts, step)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            place = np.cumsum(sizes) // block_bytes
            for at in range(batch.num_rows and int(place[-1]) + 1):  # an Arrow batch may hold more than a block
                rows = np.flatnonzero(place == at)
                if not len(rows):
                    continue
                block.add(batch.slice(int(rows[0]), len(rows)))
                if block.bytes >= block_bytes:
                    yield _frame(block.rows(), block.name)
                    block = Block(groups, parts, step)
        if block.batches:
            yield _frame(block.rows(), block.name)

    return docs.mapInArrow(run, BLOCK_SCHEMA)


def low_orders(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts by (nearest byte, symbol) and by symbol: 256 * 257 cells at most, whatever the corpus."""
    def run(batches):
        total = np.zeros(256 * SYMBOLS, dtype=np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += unpack(blob.as_py(), np.int64)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "n"])

    cells = blocks.filter("kind = 'low'").select("data").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    first = np.zeros(256 * SYMBOLS, dtype=np.int64)
    for r in cells:
        first[r["cell"]] = r["n"]
    first = first.reshape(256, SYMBOLS)
    return first, first.sum(axis=0)


class Level:
    """All contexts of one order: sorted (context, symbol) keys with counts, and per context total and distinct."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        contexts = keys >> np.uint64(SYMBOL_BITS)
        self.first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.contexts = contexts[self.first]
        self.total = np.add.reduceat(counts, self.first) if len(keys) else np.zeros(0, np.int64)
        self.distinct = np.diff(np.append(self.first, len(keys)))

    @staticmethod
    def _find(sorted_keys, wanted):
        at = np.searchsorted(sorted_keys, wanted)
        at[at == len(sorted_keys)] = 0
        return at, (sorted_keys[at] == wanted) if len(sorted_keys) else np.zeros(len(wanted), dtype=bool)

    def context(self, wanted):
        return self._find(self.contexts, wanted)

    def count(self, wanted):
        at, there = self._find(self.keys, wanted)
        return np.where(there, self.counts[at], 0) if len(self.keys) else np.zeros(len(wanted), np.int64)


def at_order(keys: np.ndarray, k: int) -> np.ndarray:
    """The (context, symbol) key of order `k` of keys of the full order."""
    return ((keys >> np.uint64(TOP - 8 * k)) << np.uint64(SYMBOL_BITS)) | (keys & np.uint64(511))


def log_probabilities(keys: np.ndarray, counts: np.ndarray, second: tuple[np.ndarray, np.ndarray], first: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """log10 of each key's probability. `keys` are distinct and sorted, `counts` their counts in training texts, and
    hold every pair of the contexts' last three bytes; `second`, `first` and `zero` are the counts of orders 2, 1 and 0, those of order
    2 by pairs and for the last two bytes of the keys at least."""
    seen = counts > 0
    levels: dict[int, Level] = {2: Level(*second)}
    for k in range(ORDER, 2, -1):
        levels[k] = Level(*summed(at_order(keys[seen], k), counts[seen]))
    cells = np.flatnonzero(first)
    levels[1] = Level(((cells // SYMBOLS).astype(np.uint64) << np.uint64(SYMBOL_BITS)) | (cells % SYMBOLS).astype(np.uint64), first.ravel()[cells])
    known = np.flatnonzero(zero)
    levels[0] = Level(known.astype(np.uint64), zero[known])
    out, escape = np.zeros(len(keys)), np.zeros(len(keys))
    settled = np.zeros(len(keys), dtype=bool)
    gone_total, gone_distinct = np.zeros(len(keys)), np.zeros(len(keys))  # of the symbols that are excluded
    for k in range(ORDER, -1, -1):
        level, wanted = levels[k], at_order(keys, k)
        at, there = level.context(wanted >> np.uint64(SYMBOL_BITS))
        if there.any():
            n = np.where(there, level.count(wanted), 0)
            distinct = np.where(there, level.distinct[at] - gone_distinct, 0)
            whole = 2 * np.where(there, level.total[at] - gone_total, 0)
            now = there & ~settled & (n > 0)
            out[now] = escape[now] + np.log10((2 * n[now] - 1) / whole[now])
            settled |= now
            on = there & ~settled & (distinct > 0)
            escape[on] += np.log10(distinct[on] / whole[on])
            if k:
                # What the symbols of this order's context count for in the next shorter one.
                parents = ((level.keys >> np.uint64(SYMBOL_BITS + 8)) << np.uint64(SYMBOL_BITS)) | (level.keys & np.uint64(511))
                within = np.add.reduceat(levels[k - 1].count(parents), level.first)
                gone_total = np.where(there, within[at], gone_total)
            gone_distinct = np.where(there, level.distinct[at], gone_distinct)
        if k and not there.all():
            # A context never seen excludes nothing by itself: no longer one was seen either.
            gone_total = np.where(there, gone_total, 0)
    out[~settled] = escape[~settled] - np.log10(np.maximum(1, SYMBOLS - gone_distinct[~settled]))
    return out


def _split(blob: bytes) -> tuple[bytes, bytes]:
    """The first compressed part of a blob, unpacked, and the rest."""
    part = zlib.decompressobj()
    return part.decompress(blob), part.unused_data


def _read_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes, rest = _split(blob)
    return sorted_from(planes), unpack(rest, "<i8")


def _read_words(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    counts, rest = _split(blob)
    return np.frombuffer(counts, dtype="<i8"), zlib.decompress(rest).split(b" ")


def merged(blobs) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of packed keys and their summed counts; none of no blobs."""
    asked = [_read_keys(x) for x in blobs] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    return summed(np.concatenate([k for k, _ in asked]), np.concatenate([c for _, c in asked]))


def condensed(rows: DataFrame, merge, salts: int) -> DataFrame:
    """Rows `(shard, salt, data)` with each salt's merged to one, again and again, until a shard has FAN_IN rows at most."""
    def run(table: pa.Table) -> pa.Table:
        data = merge([x.as_py() for x in table.column("data")])
        return table.select(["shard", "salt"]).slice(0, 1).append_column("data", pa.array([data], pa.binary()))

    while salts > 1:
        rows = rows.groupBy("shard", "salt").applyInArrow(run, "shard int, salt int, data binary")
        if salts <= FAN_IN:
            break
        salts = -(-salts // FAN_IN)
        rows = rows.withColumn("salt", F.floor(F.col("salt") / FAN_IN).cast("int"))
    return rows


def score_keys(blocks: DataFrame, first: np.ndarray, zero: np.ndarray, parts: int, salts: int) -> DataFrame:
    """`(shard, n, data)`: all keys of a shard with their log-probabilities, and their number."""
    def merge(blobs: list[bytes]) -> bytes:
        return pack_counts(*merged(blobs))

    def asked(kind: str) -> DataFrame:
        return condensed(blocks.filter(F.col("kind") == kind).select("shard", _salt(salts), "data"), merge, salts)

    def add(table: pa.Table) -> pa.Table:
        data = merge([x.as_py() for x in table.column("data")])
        return pa.table({"shard": table.column("shard").slice(0, 1), "data": pa.array([data], pa.binary())})

    def score(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("second").to_pylist(), (x.as_py() for x in table.column("data"))))
        keys, counts = merged([blob for second, blob in rows if not second])
        found = log_probabilities(keys, counts, merged([blob for second, blob in rows if second]), first, zero).astype("<f4")
        if not len(keys):  # sums of order 2 that no key of this shard needs
            return pa.table({"shard": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
        return pa.table({
            "shard": table.column("shard").slice(0, 1), "n": pa.array([len(keys)], pa.int64()),
            "data": pa.array([pack_sorted(keys) + found.tobytes()], pa.binary())})

    pairs = asked("pairs").groupBy("shard").applyInArrow(add, "shard int, data binary")
    second = pairs.select(
        F.explode(F.sequence(F.col("shard") * parts, F.col("shard") * parts + (parts - 1))).alias("shard"), F.lit(True).alias("second"), "data")
    own = asked("keys").select("shard", F.lit(False).alias("second"), "data")
    return own.unionByName(second).groupBy("shard").applyInArrow(score, "shard int, n long, data binary")


def _salt(salts):
    return F.pmod(F.xxhash64("block"), F.lit(salts) if isinstance(salts, int) else salts).cast("int").alias("salt")


def answer_keys(blocks: DataFrame, model: DataFrame, salts: int) -> DataFrame:
    """Per block and shard: the block's keys and their log-probabilities."""
    def run(table: pa.Table) -> pa.Table:
        kinds, rows = table.column("kind").to_pylist(), [x.as_py() for x in table.column("data")]
        planes, rest = _split(rows[kinds.index("model")])
        keys, found = sorted_from(planes), np.frombuffer(rest, dtype="<f4")
        asked = [i for i, kind in enumerate(kinds) if kind == "keys"]
        data = []
        for i in asked:
            own, _ = _read_keys(rows[i])
            data.append(pack_sorted(own) + found[np.searchsorted(keys, own)].tobytes())
        return _answers(table, asked, data)

    return _with_models(blocks, "keys", model, salts).groupBy("shard", "salt").applyInArrow(run, BLOCK_SCHEMA)


def count_words(blocks: DataFrame, salts: int) -> DataFrame:
    """`(shard, n, a, b, data)`: all `n` words of a shard with their training counts; `a` of them occur in training texts, `b` times."""
    def total(blobs) -> tuple[np.ndarray, bytes]:
        out: dict[bytes, int] = {}
        for counts, words in map(_read_words, blobs):
            for w, n in zip(words, counts.tolist()):
                out[w] = out.get(w, 0) + n
        return np.fromiter(out.values(), "<i8", len(out)), zlib.compress(b" ".join(out), 1)

    def merge(blobs: list[bytes]) -> bytes:
        counts, words = total(blobs)
        return pack(counts) + words

    def last(table: pa.Table) -> pa.Table:
        counts, words = total(x.as_py() for x in table.column("data"))
        return pa.table({
            "shard": table.column("shard").slice(0, 1), "n": pa.array([len(counts)], pa.int64()), "a": pa.array([int((counts > 0).sum())], pa.int64()),
            "b": pa.array([int(counts.sum())], pa.int64()), "data": pa.array([pack(counts) + words], pa.binary())})

    asked = condensed(blocks.filter("kind = 'words'").select("shard", _salt(salts), "data"), merge, salts)
    return asked.groupBy("shard").applyInArrow(last, "shard int, n long, a long, b long, data binary")


def answer_words(blocks: DataFrame, model: DataFrame, salts: int) -> DataFrame:
    """Per block and shard: the training counts of the block's words, in their order."""
    def run(table: pa.Table) -> pa.Table:
        kinds, rows = table.column("kind").to_pylist(), [x.as_py() for x in table.column("data")]
        counts, words = _read_words(rows[kinds.index("model")])
        known = dict(zip(words, counts.tolist()))
        asked = [i for i, kind in enumerate(kinds) if kind == "words"]
        data = []
        for i in asked:
            own = _read_words(rows[i])[1]
            data.append(pack(np.fromiter(map(known.__getitem__, own), "<i8", len(own))))
        return _answers(table, asked, data)

    return _with_models(blocks, "words", model, salts).groupBy("shard", "salt").applyInArrow(run, BLOCK_SCHEMA)


def _with_models(blocks: DataFrame, kind: str, model: DataFrame, salts: int) -> DataFrame:
    """The questions of one kind, and the shard's model for each of its salts: `salts` at most, and no more than times that the
    questions outnumber the model's entries, so that models are no more data than questions. One number per shard is broadcast."""
    asked = blocks.filter(F.col("kind") == kind)
    sizes = asked.groupBy("shard").agg(F.sum("a").alias("asked"))
    copies = F.least(F.ceil(F.col("asked") / F.greatest("n", F.lit(1))), F.lit(salts)).cast("int")
    copies = F.broadcast(stored(model.select("shard", "n").join(sizes, "shard").select("shard", copies.alias("copies")), "lm-copies"))
    questions = asked.join(copies, "shard").select("block", "shard", "kind", _salt(F.col("copies")), "data")
    return questions.unionByName(model.join(copies, "shard").select(
        F.lit("").alias("block"), "shard", F.lit("model").alias("kind"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), "data"))


def _answers(table: pa.Table, asked: list[int], data: list[bytes]) -> pa.Table:
    out = table.select(["block", "shard", "kind"]).take(pa.array(asked, pa.int64()))
    nothing = pa.array([0] * len(asked), pa.int64())
    return out.append_column("a", nothing).append_column("b", nothing).append_column("data", pa.array(data, pa.binary()))


def score_documents(
    docs: DataFrame, held_out, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, step: int = STEP_BYTES,
    salt_blocks: int = SALT_BLOCKS,
) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes.

    `held_out` is a boolean column: texts for which it is true are scored and not learned from (null: learned from).
    `score` is the log10 probability of the text's bytes and its end. `base_score` is that of a smoothed unigram model over
    lower-cased words and one end token. Null text counts as empty; repeated rows are documents of their own;
    an empty table gives no rows. Without training texts every symbol is equally likely.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    kind, size = rows.schema["doc_id"].dataType.simpleString(), rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, parts = shards_for(max(16, partitions(docs), -(-size // SHARD_BYTES)))
    shards = groups * parts
    blocks = stored(make_blocks(rows, groups, parts, block_bytes, step), "lm-blocks")
    salts = max(1, -(-blocks.filter("kind = 'texts'").count() // salt_blocks))
    first, zero = low_orders(blocks)
    words = stored(count_words(blocks, salts), "lm-words")
    sums = words.agg(F.sum("a"), F.sum("b")).first()
    ends = int(zero[END])  # each training text ends once
    train_tokens, vocabulary = (sums[1] or 0) + ends, (sums[0] or 0) + (ends > 0)
    below = float(np.log10(train_tokens + 0.1 * (vocabulary + 1)))
    end_score = float(np.log10(ends + 0.1)) - below
    model = stored(score_keys(blocks, first, zero, parts, salts), "lm-model")
    answers = answer_keys(blocks, model, salts).unionByName(answer_words(blocks, words, salts)).unionByName(blocks.filter("kind = 'texts'"))

    def run(table: pa.Table) -> pa.Table:
        keys, scores, counts, batches = [], [], {}, None
        for what, shard, blob in zip(table.column("kind").to_pylist(), table.column("shard").to_pylist(), table.column("data")):
            blob = blob.as_py()
            if what == "keys":
                planes, rest = _split(blob)
                keys.append(sorted_from(planes))
                scores.append(np.frombuffer(rest, dtype="<f4"))
            elif what == "words":
                counts[shard] = unpack(blob, "<i8").tolist()
            else:
                batches = pa.ipc.open_stream(blob).read_all()
        keys, scores = np.concatenate(keys), np.concatenate(scores)
        order = np.argsort(keys, kind="stable")
        keys, scores = keys[order], scores[order]
        words_here, known = set(), {}
        for chunk in batches.column("text").chunks:
            for t in texts(chunk):
                words_here.update(t.lower().split())
        for shard, words in by_shard(words_here, shards):
            known.update(zip(words, counts.pop(shard)))
        del words_here
        n = batches.num_rows
        out = {c: np.zeros(n) for c in ("base", "score")} | {c: np.zeros(n, np.int64) for c in ("tokens", "known", "bytes")}
        parts, owners, held = [], [], 0

        def score_parts():
            """Sort (key, owner), look each distinct key up once, and add up by owner."""
            found, sizes = keys_of(parts)
            found = np.sort((found << np.uint64(OWNER_BITS)) | np.repeat(np.arange(len(parts), dtype=np.uint64), sizes))
            whose = (found & np.uint64((1 << OWNER_BITS) - 1)).astype(np.int64)
            found >>= np.uint64(OWNER_BITS)
            first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            each = np.repeat(scores[np.searchsorted(keys, found[first])], np.diff(np.append(first, len(found))))
            np.add.at(out["score"], owners, np.bincount(whose, each, len(parts)))

        i = 0
        for chunk in batches.column("text").chunks:
            for t in texts(chunk):
                seen = np.fromiter(map(known.__getitem__, t.lower().split()), np.int64)
                out["tokens"][i] = len(seen) + 1
                out["known"][i] = (seen > 0).sum() + (ends > 0)
                out["base"][i] = np.log10(seen + 0.1).sum() - len(seen) * below + end_score
                out["bytes"][i] = len(t)
                for part in segments(t, step):
                    parts.append(part)
                    owners.append(i)
                    held += len(part[1]) + ORDER
                    if held >= step or len(parts) + 1 >> OWNER_BITS:
                        score_parts()
                        parts, owners, held = [], [], 0
                i += 1
        if parts:
            score_parts()
        return pa.table({
            "doc_id": batches.column("doc_id"), "held_out": batches.column("held_out"), "n_tokens": pa.array(out["tokens"]),
            "n_known": pa.array(out["known"]), "train_tokens": pa.array(np.full(n, train_tokens, np.int64)),
            "base_score": pa.array(out["base"]), "score": pa.array(out["score"]), "n_bytes": pa.array(out["bytes"])})

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    return answers.groupBy("block").applyInArrow(run, schema).withColumnRenamed("doc_id", key)


def held_out_by_key(key: str = "doc_id"):
    """True for a tenth of the keys: CRC-32 of the key's text, a null key's being empty."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 10 == 0
