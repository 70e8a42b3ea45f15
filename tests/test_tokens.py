import pytest
from pyspark.sql import functions as F

from flagstone.operators import tokens as N
from flagstone.sources import lists as L

# The first names of a published card of 45 features and some ids of its vocabulary.
FIRST_FEATURES = ["tmxrc_Aggregator", "tmxrc_ACC_EMAIL_LCL_AGE_GT_3MTHS", "tmxrc_ACC_LOGIN_SMART_ID_LCL_PAIR_AGE_GT_2MTHS"]
KNOWN_IDS = {"[UNK]": 0, "[SEP]": 1, "[PAD]": 2, "[CLS]": 3, "[MASK]": 4, "[BOS]": 5, "[EOS]": 6, "tmxrc_Aggregator_0": 7,
             "tmxrc_Aggregator_1": 8, "tmxrc_ACC_EMAIL_LCL_AGE_GT_3MTHS_0": 9}

NAMES = ["tmxrc_a", "tmxrc_a_b", "sumrc_c"]


@pytest.fixture(scope="module")
def ids(spark):
    return N.vocab_ids(N.build_vocab(N.feature_table(spark, NAMES)))


def table(spark):
    return spark.createDataFrame([(1, 0, 1, 1, 1), (2, 1, None, 0, 0), (3, 0, 1, 7, 1)],
                                 "row_id long, tmxrc_a int, tmxrc_a_b int, sumrc_c int, frd int")


def test_known_vocabulary(spark):
    ids = N.vocab_ids(N.build_vocab(N.feature_table(spark, FIRST_FEATURES)))
    assert {t: ids[t] for t in KNOWN_IDS} == KNOWN_IDS
    many = N.build_vocab(N.feature_table(spark, [f"f{i}" for i in range(45)]))
    assert many.count() == 97 and many.agg(F.max("id")).first()[0] == 96


def test_blocked_vocabulary(spark):
    ids = N.vocab_ids(N.build_vocab(N.feature_table(spark, ["x", "y"]), "blocked"))
    assert sorted(ids, key=ids.get) == ["x_0", "y_0", "x_1", "y_1", *N.SPECIAL_TOKENS]


def test_vocabulary_file(spark, tmp_path):
    vocab = N.build_vocab(N.feature_table(spark, NAMES))
    L.write_vocab(vocab, str(tmp_path / "v"))
    assert L.read_vocab(spark, str(tmp_path / "v")).exceptAll(vocab).isEmpty()
    plain = tmp_path / "plain.txt"
    plain.write_text("[UNK]\na_0\na_1")
    assert [tuple(r) for r in L.read_vocab(spark, str(plain)).orderBy("id").collect()] == [("[UNK]", 0), ("a_0", 1), ("a_1", 2)]


def test_encode(spark, ids):
    rows = {r.row_id: r for r in N.encode(table(spark), NAMES, ids, keep=["row_id"]).collect()}
    assert rows[1].input_ids == [3, 7, 10, 12, 1] and rows[1].labels == 1
    assert rows[2].input_ids == [3, 8, 0, 11, 1]
    assert rows[3].input_ids == [3, 7, 10, 0, 1]
    assert rows[1].token_type_ids == [0] * 5 and rows[1].attention_mask == [1] * 5


def test_strict_encode_drops_columns_with_nulls(spark, ids):
    rows = {r.row_id: r for r in N.encode(table(spark), NAMES, ids, keep=["row_id"], strict=True).collect()}
    assert rows[1].input_ids == [3, 7, 0, 12, 1]


def test_text_and_number_columns_encode_alike(spark, ids):
    text = table(spark).select("row_id", *[F.col(c).cast("string").alias(c) for c in NAMES])
    a = N.encode(text, NAMES, ids, label=None, keep=["row_id"])
    b = N.encode(table(spark), NAMES, ids, label=None, keep=["row_id"])
    assert a.exceptAll(b).isEmpty()
    floats = table(spark).withColumn("tmxrc_a", F.col("tmxrc_a").cast("double"))
    # 0.0 is another text than 0.
    assert N.encode(floats, NAMES, ids).first().input_ids[1] == 0


def test_decode_inverts_encode(spark, ids):
    df = table(spark).filter("row_id = 1")
    found = N.encode(df, NAMES, ids).select(N.decode(F.col("input_ids"), ids).alias("t")).first().t
    assert found == ["[CLS]", "tmxrc_a_0", "tmxrc_a_b_1", "sumrc_c_1", "[SEP]"]


def test_masking_replaces_inside_longer_tokens(spark):
    df = spark.createDataFrame([("tmxrc_a_1 xtmxrc_a_1 tmxrc_a_10", 1)], "text string, tmxrc_a int")
    assert N.mask_feature(df, "text", "tmxrc_a").first().text == "[MASK] x[MASK] [MASK]0"


def test_random_masking_rates(spark, ids):
    df = spark.range(20_000).select(F.col("id").alias("row_id"), F.array(*[F.lit(i) for i in (3, 7, 10, 12, 1)]).alias("input_ids"))
    flat = N.mask_tokens(df, "row_id", ids, seed=4).select(
        F.posexplode(F.arrays_zip("input_ids", "labels")).alias("i", "e")).select("i", "e.*")
    assert flat.filter("i in (0, 4) and labels <> -100").isEmpty()
    inner = flat.filter("i between 1 and 3")
    chosen = inner.filter("labels <> -100")
    share = chosen.count() / inner.count()
    masked = chosen.filter("input_ids = 4").count() / chosen.count()
    same = chosen.filter("input_ids = labels").count() / chosen.count()
    assert abs(share - 0.15) < 0.01 and 0.78 < masked < 0.84 and 0.09 < same < 0.13
    assert inner.filter("labels = -100 and input_ids not in (7, 10, 12)").isEmpty()


@pytest.mark.parametrize("bits", [1, 12])
def test_look_ups_by_block_keep_rows_order_nulls_and_repeats(spark, monkeypatch, bits):
    monkeypatch.setattr(N, "BLOCK_BITS", bits)
    names = {i: f"t{i}" for i in range(40) if i % 7}
    rows = [(i if i % 5 else None, None if i == 3 else [(i * j) % 45 if j % 4 else None for j in range(i % 6)]) for i in range(60)] * 2
    vocab = spark.createDataFrame([(t, i) for i, t in names.items()], "token string, id int")
    df = spark.createDataFrame(rows, "row_id long, ids array<int>").repartition(3)
    got = N.decode_by_join(df, "row_id", "ids", vocab).collect()
    wanted = [(k, None if x is None else [names.get(i, "[UNK]") for i in x]) for k, x in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))
    assert N.decode_by_join(df.limit(0), "row_id", "ids", vocab).collect() == []
    nothing = N.decode_by_join(df, "row_id", "ids", vocab.limit(0)).collect()
    assert len(nothing) == 120 and {t for r in nothing for t in r.tokens or []} == {"[UNK]"}


def test_encoding_by_join_equals_encoding_in_place(spark, ids):
    df = table(spark).unionByName(table(spark))
    vocab = N.build_vocab(N.feature_table(spark, NAMES))
    wide = [(r.row_id, r.input_ids[1:-1]) for r in N.encode(df, NAMES, ids, None, ["row_id"]).collect()]
    assert sorted(map(tuple, N.encode_by_join(df, "row_id", NAMES, vocab).collect())) == sorted(wide)


def test_a_block_asks_for_an_item_once(spark):
    """The join with the vocabulary carries block x distinct item, not row x item."""
    vocab = spark.createDataFrame([("x", 1)], "token string, id int")
    df = spark.range(5000, numPartitions=2).select(F.col("id").alias("row_id"), F.array_repeat(F.lit(1), 50).alias("ids"))
    out = N.decode_by_join(df, "row_id", "ids", vocab)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_block" in plan and out.filter("size(tokens) = 50 and tokens[7] = 'x'").count() == 5000
