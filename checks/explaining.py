"""Attributions against a background and of trees, second-order boosting, parameter search, word pieces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from checks.fixture import CARD, CLEAN_FLAGS, EVENTS_SQL, FLAGS, SCORES_SQL, SPLIT_SQL, scores, table
from checks.modelling import clean_events
from checks.registry import query
from flagstone.operators import attribution as A, boosting as B, columns as C, dependence_tree as D, metrics as M, ranking as T, shapley as H, splits as S, tuning as U, word_pieces as W
from flagstone.plans.shared import scratch_path
from flagstone.sources import events as E
from flagstone.streaming import evaluation as V

# Flags whose effects depend on each other: places in FLAGS and the weight of both together.
TOGETHER = [(0, 3, 1.5), (5, 6, -2.0)]


def interacting_scorer():
    """A scorer that is neither linear nor free of interactions."""
    def load():
        def score(frame):
            values = frame[CLEAN_FLAGS].to_numpy(dtype=float)
            logit = -1.5 + values @ np.array(list(CARD.values())) + sum(w * values[:, i] * values[:, j] for i, j, w in TOGETHER)
            return 1 / (1 + np.exp(-logit))
        return score
    return load


def bit(i: int, m: str = "m") -> str:
    return f"(({m} >> {i}) & 1)"


CODES_SQL = EVENTS_SQL + ", codes AS (SELECT row_id, frd, " + " + ".join(f'coalesce("{f}", 0) * {1 << i}' for i, f in enumerate(FLAGS)) + """ AS x FROM risk_events)"""
N = len(FLAGS)
SHAPLEY_SQL = f"""
phi AS (SELECT a.x, i, sum(CASE bit_count(a.s) {" ".join(f"WHEN {k} THEN {1 / (N * [1, 7, 21, 35, 35, 21, 7, 1][k])!r}::DOUBLE" for k in range(N))} END * (b.v - a.v)) AS phi
  FROM v a, (SELECT CAST(range AS INTEGER) AS i FROM range({N})) JOIN v b ON b.x = a.x AND b.s = a.s | (1 << i) WHERE (a.s >> i) & 1 = 0 GROUP BY 1, 2)
SELECT row_id, [{", ".join(f"'{f}'" for f in CLEAN_FLAGS)}][i + 1] AS feature, CAST((c.x >> i) & 1 AS DOUBLE) AS value, round(phi, 8) AS phi,
  round((SELECT any_value(v) FROM v WHERE s = 0), 8) AS base FROM codes c JOIN phi ON phi.x = c.x"""


def rounded(attributed):
    return A.attribution_rows(attributed).select(
        "row_id", "feature", "value", F.round("phi", 8).alias("phi"), F.round("base", 8).alias("base"))


@query("background_attributions", "WITH " + CODES_SQL + f""",
background AS (SELECT x AS b, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM codes
  WHERE row_id IN (SELECT row_id FROM codes ORDER BY row_id LIMIT 100) GROUP BY 1),
scored AS (SELECT m, 1 / (1 + exp(-(-1.5::DOUBLE + {" + ".join(f"{c}::DOUBLE * {bit(i)}" for i, c in enumerate(CARD.values()))}
  + {" + ".join(f"{w}::DOUBLE * {bit(i)} * {bit(j)}" for i, j, w in TOGETHER)}))) AS f FROM (SELECT CAST(range AS INTEGER) AS m FROM range({1 << N}))),
xs AS (SELECT DISTINCT x FROM codes),
v AS (SELECT x, s.m AS s, sum(share * t.f) AS v FROM xs, scored s, background JOIN scored t ON t.m = (x & s.m) | (b & ({(1 << N) - 1} - s.m)) GROUP BY 1, 2),
""" + SHAPLEY_SQL)
def _(spark, sf):
    df = clean_events(spark, sf)
    return rounded(H.background_attributions(df, interacting_scorer(), CLEAN_FLAGS, T.first_rows(df, 100)))


def node(tree: int, number: int, feature: int | None, value: float | None = None) -> B.Node:
    return B.Node(tree, number, None if feature is None else CLEAN_FLAGS[feature], None if feature is None else 0.5, value, 0, None)


# Two trees over five flags, one of which is in both: (place of the root's flag, those of its children), leaves from left to right.
TREES = [((0, (3, 7)), (-0.8, 0.3, 0.1, 1.7)), ((5, (0, 6)), (0.2, -0.4, 0.9, -1.1))]


def given_trees() -> list[B.Node]:
    out = []
    for t, ((root, children), values) in enumerate(TREES):
        out += [node(t, 1, root), *(node(t, 2 + i, c) for i, c in enumerate(children)), *(node(t, 4 + i, None, v) for i, v in enumerate(values))]
    return out


def conditional_sql(t: int) -> str:
    """The value of a set of known flags `s` at row `x`: a node of an unknown flag sends it both ways."""
    (root, (low, high)), values = TREES[t]
    def side(f, a, b, left, share):
        return f"CASE WHEN {bit(f, 's')} = 1 THEN CASE WHEN {bit(f, 'x')} = 1 THEN {b} ELSE {a} END ELSE ({a}) * {left}::DOUBLE / {share} + ({b}) * ({share} - {left})::DOUBLE / {share} END"
    children = [side(f, f"{values[2 * i]}::DOUBLE", f"{values[2 * i + 1]}::DOUBLE", f"n{t}_{4 + 2 * i}", f"n{t}_{2 + i}") for i, f in enumerate((low, high))]
    return side(root, *children, f"n{t}_2", f"n{t}_1")


def counts_sql() -> str:
    out = []
    for t, ((root, (low, high)), _) in enumerate(TREES):
        out += [f"count(*) AS n{t}_1", f"count(*) FILTER ({bit(root, 'x')} = 0) AS n{t}_2", f"count(*) FILTER ({bit(root, 'x')} = 1) AS n{t}_3"]
        out += [f"count(*) FILTER ({bit(root, 'x')} = {i} AND {bit(f, 'x')} = 0) AS n{t}_{4 + 2 * i}" for i, f in enumerate((low, high))]
    return ", ".join(out)


@query("tree_attributions", "WITH " + CODES_SQL + f""",
counted AS (SELECT {counts_sql()} FROM codes),
v AS (SELECT x, s, -0.25::DOUBLE + {" + ".join(conditional_sql(t) for t in range(len(TREES)))} AS v
  FROM (SELECT DISTINCT x FROM codes), (SELECT CAST(range AS INTEGER) AS s FROM range({1 << N})), counted),
""" + SHAPLEY_SQL)
def _(spark, sf):
    df = clean_events(spark, sf)
    return rounded(H.tree_attributions(df, B.with_rows(df, given_trees()), CLEAN_FLAGS, -0.25))


# The first tree of depth two, from the log-odds: each split by its gain.
def split_sql(name: str, rows: str) -> str:
    part = lambda g, h: f"({g}) * ({g}) / ({h} + 1)"
    return f"""
{name}_f AS (SELECT f, count(*) AS n, sum(frd) AS y, count(*) FILTER (NOT b) AS nl, coalesce(sum(frd) FILTER (NOT b), 0) AS yl FROM (
  {" UNION ALL ".join(f"SELECT {i} AS f, {bit(i, 'x')} = 1 AS b, frd FROM ({rows})" for i in range(N))}) GROUP BY f),
{name} AS (SELECT f, round(({part('p * nl - yl', 'p * (1 - p) * nl')} + {part('p * (n - nl) - (y - yl)', 'p * (1 - p) * (n - nl)')}
  - {part('p * n - y', 'p * (1 - p) * n')}) / 2, 9) AS gain FROM {name}_f, prior
  WHERE nl >= 5 AND n - nl >= 5 ORDER BY gain DESC, f LIMIT 1)"""


TREE_SQL = CODES_SQL + """,
prior AS (SELECT sum(frd) / count(*)::DOUBLE AS p FROM codes),""" + split_sql("s1", "SELECT x, frd FROM codes") + "," + split_sql(
    "s2", "SELECT x, frd FROM codes, s1 WHERE (x >> s1.f) & 1 = 0") + "," + split_sql(
    "s3", "SELECT x, frd FROM codes, s1 WHERE (x >> s1.f) & 1 = 1") + """,
placed AS (SELECT row_id, frd, CASE WHEN (x >> s1.f) & 1 = 0 THEN 4 + ((x >> s2.f) & 1) ELSE 6 + ((x >> s3.f) & 1) END AS leaf FROM codes, s1, s2, s3),
leaves AS (SELECT leaf, count(*) AS n, -0.3::DOUBLE * (p * count(*) - sum(frd)) / (p * (1 - p) * count(*) + 1) AS value FROM placed, prior GROUP BY leaf, p)"""


def first_tree(spark, sf):
    df = clean_events(spark, sf)
    return df, B.boost(df, CLEAN_FLAGS, settings=B.Settings(trees=1, depth=2, rate=0.3, min_rows=5))


@query("boosted_first_tree", "WITH " + TREE_SQL + f"""
, names AS (SELECT [{", ".join(f"'{f}'" for f in CLEAN_FLAGS)}] AS names)
SELECT 1 AS node, names[f + 1] AS feature, NULL::DOUBLE AS value, round(gain, 5) AS gain, (SELECT count(*) FROM codes) AS rows FROM s1, names
UNION ALL SELECT 2, names[s2.f + 1], NULL, round(s2.gain, 5), (SELECT count(*) FROM placed WHERE leaf < 6) FROM s2, names
UNION ALL SELECT 3, names[s3.f + 1], NULL, round(s3.gain, 5), (SELECT count(*) FROM placed WHERE leaf >= 6) FROM s3, names
UNION ALL SELECT leaf, NULL, round(value, 7), NULL, n FROM leaves""")
def _(spark, sf):
    return first_tree(spark, sf)[1].table(spark).select(
        "node", "feature", F.round("value", 7).alias("value"), F.round("gain", 5).alias("gain"), "rows")


@query("boosted_first_scores", "WITH " + TREE_SQL + """
SELECT row_id, round(1 / (1 + exp(-(ln(p / (1 - p)) + value))), 7) AS score FROM placed JOIN leaves USING (leaf), prior""")
def _(spark, sf):
    df, model = first_tree(spark, sf)
    return B.boosted_scores(df, model).select("row_id", F.round("score", 7).alias("score"))


@query("second_order_baseline", "WITH " + SPLIT_SQL + """
SELECT split, count(*) AS n, CAST(sum(frd) AS BIGINT) AS fraud, TRUE AS better_than_one_tree FROM placed WHERE split <> 'val' GROUP BY 1""")
def _(spark, sf):
    """More trees fit the training rows better than the first alone, by exact AUC; sizes of both parts beside it."""
    df = S.fraud_split(clean_events(spark, sf)).filter("split <> 'val'")
    model = B.boost(df.filter("split = 'train'"), CLEAN_FLAGS, settings=B.Settings(trees=6, depth=3, rate=0.3, min_rows=5))
    first = B.Model(model.features, model.base, [n for n in model.nodes if n.tree == 0])
    def auc(m):
        return M.auc(B.boosted_scores(df.filter("split = 'train'"), m), label="frd", score="logit").first()["auc"]

    better = auc(model) >= auc(first)
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("frd").cast("long").alias("fraud")).withColumn("better_than_one_tree", F.lit(better))


@query("searched_threshold", """
SELECT CAST(range AS INTEGER) AS trial, TRUE AS in_range, TRUE AS near_best FROM range(24)""")
def _(spark, sf):
    """The threshold with the best G-mean, by model-based search over whole passes; within two in a hundred of the exact best."""
    rows = scores(spark, sf).select("y", "score")
    exact = M.best_gmean(rows).first()["gmean"]

    def objective(parameters):
        at = F.col("score") >= parameters["threshold"]
        hit, miss = (F.avg(F.when(F.col("y") == y, at.cast("double"))) for y in (1, 0))
        return rows.agg(F.sqrt(hit * (1 - miss)).alias("g")).first()["g"]

    high = rows.agg(F.max("score")).first()[0]
    best, trials = U.search(spark, objective, scratch_path(spark, "search"), {"threshold": U.Between(0.0, high)}, trials=24)
    path = scratch_path(spark, "trials")
    E.write_trials(trials, path)
    saved = E.read_events(spark, path, trials.schema)
    found = saved.agg(F.max("value")).first()[0]
    return saved.select("trial", F.col("threshold").cast("double").between(0, high).alias("in_range"), F.lit(found >= 0.98 * exact).alias("near_best"))


# A vocabulary of pieces of the words of part names: beginnings, what follows in some words, and single letters of others.
PIECES_SQL = """names AS (SELECT p_partkey, p_name FROM part),
words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM names),
tokens AS (SELECT '[UNK]' AS token UNION SELECT substr(word, 1, 3) FROM words WHERE length(word) % 5 <> 0
  UNION SELECT '##' || substr(word, 4, 2) FROM words WHERE length(word) > 4 UNION SELECT '##' || substr(word, 6) FROM words WHERE length(word) > 5
  UNION SELECT '##' || substr(word, 4, 1) FROM words WHERE length(word) > 3),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS id FROM tokens),
listed AS (SELECT list(token) AS held FROM vocab)"""


@query("word_pieces", "WITH RECURSIVE " + PIECES_SQL + """,
steps(word, pos, pieces) AS (
  SELECT word, 1, [] :: VARCHAR[] FROM words
  UNION ALL
  SELECT word, pos + size, list_append(pieces, CASE WHEN pos > 1 THEN '##' ELSE '' END || substr(word, pos, size)) FROM (
    SELECT word, pos, pieces, list_max(list_filter(range(1, length(word) - pos + 2),
      lambda n: list_contains(held, CASE WHEN pos > 1 THEN '##' ELSE '' END || substr(word, pos, n)))) AS size
    FROM steps, listed WHERE pos <= length(word)) WHERE size IS NOT NULL),
cut AS (SELECT w.word, coalesce(array_to_string(s.pieces, ' '), '[UNK]') AS pieces FROM words w LEFT JOIN steps s ON s.word = w.word AND s.pos > length(w.word)),
placed AS (SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1) AS i, unnest(string_split(p_name, ' ')) AS word FROM names)
SELECT p_partkey, string_agg(pieces, ' ' ORDER BY i) AS pieces FROM placed JOIN cut USING (word) GROUP BY 1""")
def _(spark, sf):
    names = table(spark, sf, "part").select("p_partkey", "p_name")
    words = names.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    n = F.length("word")
    inside = lambda c: F.concat(F.lit("##"), c)
    tokens = spark.range(1).select(F.lit("[UNK]").alias("token"))
    for found in (
        words.filter(n % 5 != 0).select(F.substring("word", 1, 3)), words.filter(n > 4).select(inside(F.substring("word", 4, 2))),
        words.filter(n > 5).select(inside(F.expr("substring(word, 6)"))), words.filter(n > 3).select(inside(F.substring("word", 4, 1))),
    ):
        tokens = tokens.union(found)
    # Tokens of part names are a few hundred at any scale.
    vocab = tokens.distinct().withColumn("id", (F.row_number().over(Window.orderBy("token")) - 1).cast("int"))
    return W.word_pieces(names, "p_name", vocab).select("p_partkey", F.array_join("pieces", " ").alias("pieces"))


@query("streamed_evaluation", "WITH " + SCORES_SQL + """,
ranked AS (SELECT *, rank() OVER (PARTITION BY org_id ORDER BY score) + (count(*) OVER (PARTITION BY org_id, score) - 1) / 2.0::DOUBLE AS r FROM scores)
SELECT org_id, count(*) AS n, CAST(sum(y) AS BIGINT) AS p,
  round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * sum(1 - y), 0)::DOUBLE, 8) AS auc FROM ranked GROUP BY 1""")
def _(spark, sf):
    """Scored files are read as a stream, two batches at least, and the stream starts a second time."""
    source, kept, progress = (scratch_path(spark, name) for name in ("scored", "counts", "progress"))
    rows = scores(spark, sf).select("org_id", "y", "score")
    rows.repartition(6, "score").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(source)
    for _ in range(2):
        V.evaluate_stream(stream, kept, progress, by=["org_id"]).awaitTermination()
    return V.stream_report(spark, kept, {"org_id": "string"}).withColumn("auc", F.round("auc", 8))


def information_sql(flags: str) -> str:
    """Pairwise information of the columns of `flags` but row_id; nulls are no values."""
    return f"""long AS (SELECT row_id, feature, value FROM (UNPIVOT ({flags}) ON COLUMNS(* EXCLUDE (row_id)) INTO NAME feature VALUE value)),
pairs AS (SELECT a.feature, b.feature AS other, a.value AS x, b.value AS y, count(*) AS n FROM long a JOIN long b ON b.row_id = a.row_id AND a.feature < b.feature GROUP BY 1, 2, 3, 4),
sized AS (SELECT *, sum(n) OVER (PARTITION BY feature, other)::DOUBLE AS total, sum(n) OVER (PARTITION BY feature, other, x)::DOUBLE AS nx,
  sum(n) OVER (PARTITION BY feature, other, y)::DOUBLE AS ny FROM pairs),
informed AS (SELECT feature, other, round(sum(n / total * ln(n * total / (nx * ny))), 9) AS information FROM sized GROUP BY 1, 2)"""


def flag_columns_sql(fill: bool) -> str:
    cells = [f'coalesce("{f}", 0)' if fill else f'"{f}"' for f in FLAGS]
    return "SELECT row_id, " + ", ".join(f'CAST({c} AS VARCHAR) AS "{f}"' for c, f in zip(cells, CLEAN_FLAGS)) + ", CAST(frd AS VARCHAR) AS frd FROM risk_events"


# A pair is in the tree unless stronger pairs join its two features.
TREE_SQL = """edges AS (SELECT *, row_number() OVER (ORDER BY information DESC, feature, other) AS r FROM informed),
met(r, node) AS (SELECT r, feature FROM edges UNION
  SELECT m.r, CASE WHEN e.feature = m.node THEN e.other ELSE e.feature END FROM met m JOIN edges e ON e.r < m.r AND (e.feature = m.node OR e.other = m.node)),
tree AS (SELECT feature, other, information FROM edges e WHERE NOT EXISTS (SELECT 1 FROM met m WHERE m.r = e.r AND m.node = e.other))"""


@query("informative_pairs", "WITH " + EVENTS_SQL + ", " + information_sql(flag_columns_sql(False)) + """
SELECT feature, other, information FROM informed""")
def _(spark, sf):
    df, names = clean_events(spark, sf), [*CLEAN_FLAGS, "frd"]
    return D.mutual_information(D.pair_counts(df, D.feature_values(df, names)))


@query("dependence_tree", "WITH RECURSIVE " + EVENTS_SQL + ", " + information_sql(flag_columns_sql(False)) + ", " + TREE_SQL + """
SELECT feature, other, information FROM tree""")
def _(spark, sf):
    return D.dependence_tree(clean_events(spark, sf), [*CLEAN_FLAGS, "frd"])


# Where all features are known, only the neighbours of the hidden one on the tree tell of it.
@query("fill_masked_by_tree", "WITH RECURSIVE " + EVENTS_SQL + ", " + information_sql(flag_columns_sql(True)) + ", " + TREE_SQL + """,
near AS (SELECT CASE WHEN feature = 'frd' THEN other ELSE feature END AS feature FROM tree WHERE 'frd' IN (feature, other)),
told AS (SELECT l.feature, l.value, t.value AS candidate, count(*) AS n FROM long l JOIN long t ON t.row_id = l.row_id AND t.feature = 'frd' WHERE l.feature IN (FROM near) GROUP BY 1, 2, 3),
candidates AS (SELECT value AS candidate, count(*) AS n FROM long WHERE feature = 'frd' GROUP BY 1),
kinds AS (SELECT feature, count(DISTINCT value) AS k FROM long GROUP BY 1),
weights AS (SELECT l.row_id, c.candidate, sum(ln((coalesce(told.n, 0) + 1) / (c.n + k)::DOUBLE)) + any_value(ln(c.n + 1)) AS w
  FROM long l JOIN near USING (feature) JOIN kinds USING (feature) CROSS JOIN candidates c
  LEFT JOIN told ON told.feature = l.feature AND told.value = l.value AND told.candidate = c.candidate GROUP BY 1, 2),
chances AS (SELECT row_id, candidate, 1 / (1 + sum(exp(w)) OVER (PARTITION BY row_id) / exp(w) - 1) AS p FROM weights)
SELECT row_id, candidate, round(p, 8) AS p FROM chances""")
def _(spark, sf):
    df = C.fill_zero(clean_events(spark, sf), CLEAN_FLAGS)
    return D.fill_masked_by_tree(df, "frd", CLEAN_FLAGS).select("row_id", "candidate", F.round("p", 8).alias("p"))
