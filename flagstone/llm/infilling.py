"""Fill-in-the-middle transformation by secondary sort.

A document's units (runs of letters, or one other character) are cut at two hashed places into prefix, middle and suffix.
Each part leaves its task as pieces of bounded size, keyed by document and place in the output. The pieces are dealt by
document and sorted by place inside partitions (repartition and sortWithinPartitions, which is what
repartitionAndSortWithinPartitions does for rows of bytes), so a task sees each output piece after piece and feeds it to
a digest: no document is put together in memory. The markers in that stream say which part a piece belongs to, and so
its place in the original; a second sort inside the same partitions, without a shuffle, streams the restored text into another digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flagstone.llm.common import partitions, texts

# What begins prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
# The order of the parts in the original, and their marks in that of each form.
ORIGINAL = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
# Bytes of text in a piece.
PIECE = 1 << 16


def unit_starts(data: bytes) -> np.ndarray:
    """The byte offsets at which the units of a UTF-8 text begin."""
    b = np.frombuffer(data, dtype=np.uint8)
    letter = ((b | 32) - np.uint8(97)) < 26
    begins = (b & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def characters(data: bytes) -> int:
    """Code points of a UTF-8 text."""
    return int(np.count_nonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80))


def draws(key, seed: int) -> list[int]:
    """Four 32-bit numbers that depend on the document's key alone; a null key counts as an empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12)]


def cut(data: bytes, key, seed: int, rate: int, spm: int) -> tuple[int, str, dict[bytes, bytes]]:
    """The number of units, the form, and the parts by mark (none for a plain document)."""
    starts = unit_starts(data)
    n = len(starts)
    first, second, chance, order = draws(key, seed)
    if not n or any(m in data for m in MARKS) or chance % 100 >= rate:
        return n, "plain", {}
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = (int(starts[k]) if k < n else len(data) for k in (low, high))
    return n, "spm" if order % 100 < spm else "psm", {PREFIX: data[:a], MIDDLE: data[a:b], SUFFIX: data[b:]}


def chunks(data: bytes, size: int) -> Iterator[bytes]:
    for at in range(0, len(data), size):
        yield data[at:at + size]


def infill_pieces(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90, spm: int = 20, size: int = PIECE,
) -> DataFrame:
    """`(_row, place, part, doc_id, n, form, prefix_chars, middle_chars)`: the pieces of each output in any order. The
    columns from doc_id on are set in a document's first piece alone, which has no bytes and place 0."""
    def run(batches):
        for batch in batches:
            rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, held = [], 0
            for row, key_here, data in zip(rows, ids, texts(batch.column(2))):
                n, form, parts = cut(data, key_here, seed, rate, spm)
                sizes = [characters(parts[PREFIX]), characters(parts[MIDDLE])] if parts else [None, None]
                out.append((row, 0, b"", key_here, n, form, *sizes))
                marked = [data] if not parts else [m + parts[m] for m in FORMS[form]]
                place = 0
                for part in marked:
                    for piece in chunks(part, size):
                        place += 1
                        out.append((row, place, piece, None, None, None, None, None))
                held += len(data)
                if held > 1 << 22:
                    yield from batches_of(out, batch.schema.field(1).type)
                    out, held = [], 0
            yield from batches_of(out, batch.schema.field(1).type)

    def batches_of(out, kind):
        if out:
            kinds = [pa.int64(), pa.int64(), pa.binary(), kind, pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["_row", "place", "part", "doc_id", "n", "form", "prefix_chars", "middle_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"_row long, place long, part binary, doc_id {kind}, n long, form string, prefix_chars long, middle_chars long")


def _digested(batches, again: bool, keep: bool) -> Iterator[pa.RecordBatch]:
    """Walk pieces sorted by document and place. The first walk (not `again`) gives all pieces on, without marks and with
    their places in the original, and a document's head with the digest of the output; the second gives the heads alone,
    with the digest of the text that it walked over. With `keep` a head also carries the text itself."""
    head, digest, held, part_no, place = None, None, [], -1, 0

    def closed():
        whole = b"".join(held) if keep else None
        return {**head, ("restored_sha256" if again else "output_sha256"): digest.hexdigest(), ("restored" if again else "output"): whole}

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["form"] is not None:
                if head is not None:
                    out.append(closed())
                head, digest, held, part_no, place = r, hashlib.sha256(), [], -1, 0
                continue
            if head is None or head["_row"] != r["_row"]:
                raise ValueError("the head of a document is missing")
            digest.update(r["part"])
            if keep:
                held.append(r["part"])
            if again:
                continue
            if head["form"] != "plain" and r["part"][:3] in ORIGINAL:
                part_no, r["part"] = ORIGINAL[r["part"][:3]], r["part"][3:]
            place += 1
            out.append({**r, "place": (max(part_no, 0) << 40) + place})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_schema(batch.schema, again))
    if head is not None:
        yield pa.RecordBatch.from_pylist([closed()], schema=_schema(batch.schema, again))


def _schema(schema: pa.Schema, again: bool) -> pa.Schema:
    """The columns of a walk's result."""
    own = "restored" if again else "output"
    return schema.append(pa.field(f"{own}_sha256", pa.string())).append(pa.field(own, pa.binary()))


def infill(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90, spm: int = 20, size: int = PIECE, keep: bool = False,
) -> DataFrame:
    """One row per document: key, n (units), form, prefix_chars, middle_chars (code points; null if plain), output_sha256,
    restored_sha256; with `keep` also output and restored, the texts.

    `rate` documents in a hundred are transformed, `spm` in a hundred of them with the suffix first. Null text counts as empty;
    empty texts and texts that hold a mark are plain. A null key draws as an empty one; repeated rows are documents of
    their own. A text of any length passes in pieces of `size` bytes (with `keep` a task holds one whole text). Other
    columns are left out, whatever their names. An empty table gives no rows.
    """
    if size < 4:
        raise ValueError("a piece holds a mark and a byte at least")
    pieces = infill_pieces(docs, key, text, seed, rate, spm, size)
    dealt = pieces.repartition(partitions(docs), "_row").sortWithinPartitions("_row", "place")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    first = dealt.mapInArrow(lambda batches: _digested(batches, False, keep), f"{columns}, output_sha256 string, output binary")
    # A head has place 0 and comes first again; the partitions are the same, so nothing is shuffled.
    second = first.sortWithinPartitions("_row", "place").mapInArrow(
        lambda batches: _digested(batches, True, keep),
        f"{columns}, output_sha256 string, output binary, restored_sha256 string, restored binary")
    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    whole = [F.col(c).cast("string").alias(c) for c in ("output", "restored")] if keep else []
    return second.select(F.col("doc_id").alias(key), *names, *whole)
