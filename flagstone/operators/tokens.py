"""Vocabulary, row encoding, decoding and masking."""

from __future__ import annotations

from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from flagstone.functions.arrays import bracket, constant_array
from flagstone.functions.numbers import once
from flagstone.functions.text import choose, mask_text, quoted, token, whole_columns
from flagstone.plans.hashing import below, digest, hex_number
from flagstone.plans.shared import bounded_rows, measured

# The special tokens in id order, and the label of positions that are not predicted.
SPECIAL_TOKENS = ["[UNK]", "[SEP]", "[PAD]", "[CLS]", "[MASK]", "[BOS]", "[EOS]"]
IGNORED_LABEL = -100
# Up to two to this power of rows ask for their look-ups together: a million items at 245 features, tens of megabytes in a task.
BLOCK_BITS = 12


def feature_table(spark: SparkSession, features: list[str]) -> DataFrame:
    """A list of names as `(pos, feature)`."""
    return spark.createDataFrame(list(enumerate(features)), "pos int, feature string")


def build_vocab(features: DataFrame, layout: str = "interleaved") -> DataFrame:
    """`(token, id)` for a table `(pos, feature)` with positions from 0.

    `interleaved`: specials, then `f_0`, `f_1` of each feature. `blocked`: all `_0`, all `_1`,
    then the specials.
    """
    specials = F.array(*[F.lit(t) for t in SPECIAL_TOKENS])
    first = features.filter(F.col("pos") == 0)
    values = features.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    name = F.concat_ws("_", "feature", F.col("v").cast("string")).alias("token")
    if layout == "interleaved":
        base, number = F.lit(0), F.lit(len(SPECIAL_TOKENS)) + 2 * F.col("pos") + F.col("v")
    elif layout == "blocked":
        size = features.agg(F.count(F.lit(1))).scalar()
        base, number = 2 * size, F.col("v") * size + F.col("pos")
    else:
        raise ValueError(f"unknown layout {layout}")
    special_rows = first.select(F.posexplode(specials).alias("_pos", "token")).select(
        "token", (base + F.col("_pos")).cast("int").alias("id")
    )
    return special_rows.unionByName(values.select(name, number.cast("int").alias("id")))


def vocab_ids(vocab: DataFrame) -> dict[str, int]:
    """A vocabulary as a dict. Its size follows the number of columns; a large one is an error."""
    return {r["token"]: r["id"] for r in bounded_rows(vocab.select("token", "id"))}


def token_id(name: str, ids: dict[str, int], whole: bool = False) -> Column:
    """Id of `name_value`: one short CASE per column, which stays inside generated code.

    The values of `whole`-number columns are compared as numbers, which saves making text of them.
    """
    known = {t[len(name) + 1 :]: i for t, i in ids.items() if t.startswith(f"{name}_")}
    return choose(name, known, F.lit(ids["[UNK]"]), whole)


def encode(
    df: DataFrame, features: list[str], vocab: DataFrame | dict[str, int], label: str | None = "frd",
    keep: list[str] = [], strict: bool = False,
) -> DataFrame:
    """Rows as `input_ids`, `labels`, `token_type_ids`, `attention_mask`; no shuffle.

    A null or unknown value becomes `[UNK]`. With `strict`, a column that holds any null becomes
    `[UNK]` throughout, which needs one pass to find such columns.
    """
    ids = vocab_ids(vocab) if isinstance(vocab, DataFrame) else vocab
    holed: set[str] = set()
    if strict:
        row = df.agg(*[F.bool_or(quoted(c).isNull()).alias(f"_{i}") for i, c in enumerate(features)]).first()
        holed = {c for c, has_null in zip(features, row, strict=True) if has_null}
    whole = whole_columns(df)
    encoded = F.array(*[F.lit(ids["[UNK]"]) if c in holed else token_id(c, ids, c in whole) for c in features])
    length = len(features) + 2
    labels = [] if label is None else [quoted(label).cast("int").alias("labels")]
    return df.select(
        *[quoted(c) for c in keep],
        bracket(encoded, ids["[CLS]"], ids["[SEP]"]).alias("input_ids"),
        *labels,
        constant_array(0, length).alias("token_type_ids"),
        constant_array(1, length).alias("attention_mask"),
    )


def lookup_ids(tokens: DataFrame, vocab: DataFrame, unknown: int) -> DataFrame:
    """Add `id` to a table with a `token` column; tokens not in the vocabulary get `unknown`.

    Vocabularies of any size work: Catalyst broadcasts a small one by its own size estimate.
    """
    return tokens.join(vocab.select("token", "id"), "token", "left").withColumn(
        "id", F.coalesce("id", F.lit(unknown))
    )


def _look_up_by_block(rows: DataFrame, table: DataFrame, unknown) -> DataFrame:
    """`rows` (two columns, a key and an array) with each array's items replaced by their values in `table` (item, value; items are
    distinct). An item that is not there, or null, gets `unknown`; a null array stays null, an empty one empty.

    Rows are cut into blocks of at most 2 ** BLOCK_BITS where they lie. A block asks for each distinct item once, however many of its rows
    hold it, so the join with `table` carries block x distinct item, and a frequent item is one row per block. The answers
    meet the block's rows, which move once and whole; arrays are filled in place. No row is exploded into the shuffle.
    """
    (key, array), (item, value) = rows.columns, table.columns
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("_block")
    # Stored, since a task that ran again could cut other blocks.
    blocks = measured(rows.select(block, F.col(key).alias("_key"), F.col(array).alias("_items")))
    asked = blocks.select("_block", F.explode(F.array_distinct("_items")).alias("_item")).distinct()
    answers = asked.join(table.select(F.col(item).alias("_item"), F.col(value).alias("_value")), "_item").select(F.col("_block").alias("_asker"), "_item", "_value")

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"_key": left.column("_key"), "_values": pa.array([], pa.list_(right.schema.field("_value").type))})
        items = left.column("_items").combine_chunks()
        at = pc.index_in(items.flatten(), value_set=right.column("_item").combine_chunks())
        found = pc.fill_null(right.column("_value").combine_chunks().take(at), unknown)
        sizes = pc.fill_null(pc.list_value_length(items), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
        return pa.table({"_key": left.column("_key"), "_values": pa.ListArray.from_arrays(offsets, found, mask=items.is_null())})

    schema = T.StructType([T.StructField("_key", rows.schema[key].dataType), T.StructField("_values", T.ArrayType(table.schema[value].dataType))])
    filled = blocks.groupBy("_block").cogroup(answers.groupBy("_asker")).applyInArrow(fill, schema)
    return filled.select(F.col("_key").alias(key), F.col("_values").alias(array))


def encode_by_join(df: DataFrame, key: str, features: list[str], vocab: DataFrame, unknown: int = 0) -> DataFrame:
    """The same ids for vocabularies too large for `encode`, as `(key, ids)`: one row per row, looked up block by block."""
    tokens = F.array(*[token(c) for c in features])
    return _look_up_by_block(df.select(key, tokens.alias("ids")), vocab.select("token", "id"), unknown)


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def encode_sentence(text: Column, ids: dict[str, int]) -> Column:
    """Ids of a blank-separated sentence with start and end tokens; `[MASK]` and other specials keep
    their ids."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    known = _literal_map(ids)
    found = F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), F.lit(ids["[UNK]"])))
    return bracket(found, ids["[CLS]"], ids["[SEP]"])


def decode(ids: Column, vocab: dict[str, int]) -> Column:
    """Tokens of an id array, in order."""
    names = _literal_map({i: t for t, i in vocab.items()})
    return F.transform(ids, lambda i: F.coalesce(F.try_element_at(names, i), F.lit("[UNK]")))


def decode_by_join(df: DataFrame, key: str, ids: str, vocab: DataFrame) -> DataFrame:
    """The same with the vocabulary table, as `(key, tokens)`: one row per row, looked up block by block."""
    return _look_up_by_block(df.select(key, F.col(ids).alias("tokens")), vocab.select("id", "token"), "[UNK]")


def mask_tokens(
    df: DataFrame, key: str, vocab: dict[str, int], rate: float = 0.15, seed: int = 0, ids: str = "input_ids"
) -> DataFrame:
    """Random masking for masked-token training: `input_ids` are masked, `labels` hold the hidden ids.

    A position is chosen with `rate`, never on a special token. Of the chosen 80 % become `[MASK]`,
    10 % a random id, 10 % stay. One md5 gives the first draw of four positions; only chosen positions
    need one of their own.
    """
    ignored = F.lit(IGNORED_LABEL)

    def pair(masked: Column, label: Column) -> Column:
        return F.struct(masked.alias("id"), label.alias("label"))

    def drawn(x: Column, h: Column) -> Column:
        replaced = F.when(below(h, 0.8), F.lit(vocab["[MASK]"])).when(
            below(h, 0.9), (hex_number(h, 9) % F.lit(len(vocab))).cast("int")
        )
        return pair(replaced.otherwise(x), x)

    def place(draws: Column, x: Column, i: Column) -> Column:
        special = x.isin(*[vocab[t] for t in SPECIAL_TOKENS])
        chosen = ~special & below(F.substring(draws, i * 8 + 1, F.lit(8)), rate)
        own = F.md5(F.concat_ws("|", F.col("_digest"), i.cast("string"), F.lit("x")))
        return F.when(chosen, once(own, lambda h: drawn(x, h))).otherwise(pair(x, ignored))

    blocks = F.sequence(F.lit(0), F.floor(F.size(ids) / 4).cast("int"))
    parts = F.transform(blocks, lambda b: F.md5(F.concat_ws("|", F.col("_digest"), b.cast("string"))))
    # The draws are bound once per row; as a plain column they would be made again per position.
    pairs = once(F.array_join(parts, ""), lambda draws: F.transform(F.col(ids), lambda x, i: place(draws, x, i)))
    drawn_pairs = df.withColumn("_digest", digest(key, seed)).withColumn("_pairs", pairs)
    return drawn_pairs.withColumns({"labels": F.col("_pairs.label"), ids: F.col("_pairs.id")}).drop("_digest", "_pairs")


def mask_feature(df: DataFrame, text: str, name: str) -> DataFrame:
    """Mask one feature in the sentence of every row: its token is replaced wherever it occurs."""
    return df.withColumn(text, mask_text(F.col(text), token(name)))


def mask_place(ids: Column, place: int, mask: int) -> Column:
    """Mask one 0-based place of an id array."""
    return F.transform(ids, lambda x, i: F.when(i == place, F.lit(mask)).otherwise(x))
