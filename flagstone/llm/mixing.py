"""Mixing documents to target weights by soft membership. DataFrame functions only.

A labelled table tells the domain of some documents. A naive Bayes classifier of hashed word beginnings, word ends and
repetition scores every document; scores are cut into cells, and a cell's posterior is the share of each domain among
labelled rows there that the classifier has not seen. Then every document gets a rate of zero or more, such that the expected
tokens of each domain, sum(tokens * posterior * rate), match the targets: least squares by projected gradient with momentum,
from a rate of one. The gradient is scaled by a document's tokens, so documents of equal posterior have equal rates at every
step. They are added up before the first step; each step is a Spark aggregation that brings one number per domain to
the driver. A rate is the fold of all steps, so no step writes anything.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from flagstone.llm.common import stored, unused
from flagstone.plans.shared import hint_if_small

BUCKETS = 1 << 16
SAMPLE_ROWS = 20_000
# A fold by hash of the key fits no weights and gives the posteriors.
FOLDS = 4
# Standard deviations above its expected rows, and times these, from which a feature counts for a domain.
CLEAR, LIFT = 4.0, 3.0
TOP_SCORE, SCORE_STEP = 24.0, 1.5
STEPS, NEAR = 60, 1e-5
WHITE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def feature_buckets(words: Column) -> Column:
    """The distinct features of a text's words as bucket numbers: beginnings, ends, and how much is repeated."""
    n = F.size(words)
    repeated = F.when(n > 0, F.floor(8 * F.size(F.array_distinct(words)) / n)).otherwise(-1).cast("string")
    size = F.floor(F.log2(n + F.lit(1)) / 2).cast("string")
    # Kinds of features are told apart by the seed of their hash.
    bucket = lambda f, seed: F.pmod(F.xxhash64(f, F.lit(seed)), F.lit(BUCKETS)).cast("int")
    begins = F.transform(words, lambda w: bucket(F.lower(F.substring(w, 1, 4)), 0))
    ends = F.transform(words, lambda w: bucket(F.substring(w, -2, 2), 1))
    shape = F.array(bucket(F.concat(repeated, F.lit(" "), size), 2))
    return F.array_distinct(F.concat(begins, ends, shape))


def domain_scores(docs: DataFrame, labels: DataFrame, domains: list[str], sample_rows: int = SAMPLE_ROWS, field: str | None = None) -> DataFrame:
    """`(doc_id, tokens, domain, fold, s0, s1, ...)`: each document's log score per domain; `domain` where it is labelled.

    The classifier is fitted on at most `sample_rows` labelled rows, chosen by hash of the key. Where the documents' doc_id
    is a struct that names rows, `field` is its field that labels go by.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("domain").alias("domain"), F.min("domain").alias("low")).filter("domain = low").select("_id", "domain")
        .orderBy(F.xxhash64("_id", F.lit(3)), "_id").limit(sample_rows)
    )
    known = stored(known, "domain-labels")
    own = F.col("doc_id") if field is None else F.col("doc_id")[field]
    fold = F.pmod(F.xxhash64(own, F.lit(9)), F.lit(FOLDS))
    rows = docs.select("doc_id", words_of(F.coalesce("text", F.lit(""))).alias("words"))
    # Bounded by `sample_rows`.
    labelled = rows.join(F.broadcast(known), own == F.col("_id")).filter(fold != 0)
    counts = labelled.select("domain", F.explode(feature_buckets(F.col("words"))).alias("bucket")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)])
    sizes = {r["domain"]: r["count"] for r in labelled.groupBy("domain").count().collect()}
    n = [sizes.get(d, 0) for d in domains]
    whole = sum(n)
    # A feature counts for a domain that has clearly more of its rows than the domain's share.
    expected = [F.col("n") * (n[i] / whole if whole else 0.0) for i in range(len(domains))]
    clear = [(F.col(f"n{i}") - e > CLEAR * F.sqrt(e) + 2) & (F.col(f"n{i}") >= LIFT * e) for i, e in enumerate(expected)]
    weights = [F.when(clear[i], F.log((F.col(f"n{i}") + 0.5) / (e + 0.5))).otherwise(0.0).alias(f"w{i}") for i, e in enumerate(expected)]
    weights = stored(counts.filter(reduce(lambda a, b: a | b, clear)).select("bucket", *weights), "domain-weights")
    # Rows are told apart by their place, as keys may repeat; place and sums are made in one job.
    marked = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("tokens", F.size("words").cast("long"))
    # Every document has the bucket -1 too, which weighs nothing, so that none is lost; other buckets without weights go.
    hits = marked.select("doc_id", "_row", "tokens", F.explode(F.concat(feature_buckets(F.col("words")), F.array(F.lit(-1)))).alias("bucket"))
    nothing = docs.sparkSession.range(1).select(F.lit(-1).alias("bucket"), *[F.lit(0.0).alias(f"w{i}") for i in range(len(domains))])
    # At most BUCKETS rows and one.
    hits = hits.join(F.broadcast(weights.unionByName(nothing)), "bucket")
    sums = hits.groupBy("doc_id", "_row", "tokens").agg(*[F.sum(f"w{i}").alias(f"s{i}") for i in range(len(domains))])
    told = sums.join(F.broadcast(known), own == F.col("_id"), "left")
    return told.select("doc_id", "tokens", "domain", fold.cast("int").alias("fold"), *[f"s{i}" for i in range(len(domains))])


def posteriors(scores: DataFrame, domains: list[str]) -> tuple[DataFrame, list[bool]]:
    """`(doc_id, tokens, domain, p0, p1, ...)` from a stored score table: the posterior of a document's cell; and which domains are
    known, that is, have labelled rows in the fold that was held out.

    A cell is the rounded score for each domain. Its posterior is the share of domains among labelled rows of the fold that
    was held out there, with those of all cells as one row more.
    """
    k = len(domains)
    bins = [F.round(F.least(F.lit(TOP_SCORE), F.col(f"s{i}")) / SCORE_STEP).cast("int") for i in range(k)]
    celled = scores.withColumn("cell", F.concat_ws(",", *bins))
    held_out = (F.col("fold") == 0) & F.col("domain").isNotNull()
    cells = celled.groupBy("cell").agg(
        F.count_if(held_out).alias("n"), *[F.count_if(held_out & (F.col("domain") == d)).alias(f"n{i}") for i, d in enumerate(domains)])
    cells = stored(cells, "domain-cells")  # (TOP_SCORE / SCORE_STEP + 1) ** domains rows at most
    all_cells = cells.agg(F.sum("n"), *[F.sum(f"n{i}") for i in range(k)]).first()
    prior = [(all_cells[i + 1] + 1) / (all_cells[0] + k) if all_cells[0] is not None else 1 / k for i in range(k)]
    shares = [((F.col(f"n{i}") + prior[i]) / (F.col("n") + 1)).alias(f"p{i}") for i in range(k)]
    members = celled.join(hint_if_small(cells.select("cell", *shares), cells.count()), "cell").select(
        "doc_id", "tokens", "domain", *[f"p{i}" for i in range(k)])
    return members, [bool(all_cells[i + 1]) for i in range(k)]


def fit_rates(
    members: DataFrame, shares: list[float], total: float | None = None, known: list[bool] | None = None, whole_domain: int | None = None,
) -> tuple[Column, list[float]]:
    """The rate of a row of `(tokens, p0, p1, ...)`, and `fixed` if there are such rows, as a column, and the tokens by domain that the rates give.

    `shares` are the target weights by domain. `total` is the wanted number of tokens: by default the most for which no
    domain needs more tokens than it has; rates of single rows may still be above one, where they make up for others. With
    `whole_domain` (a place) the total is what keeps all tokens of that domain, a domain with fewer tokens than its share
    stays whole and falls short, and no rate is above one. A row that is `fixed` has the rate one. Domains that
    are not `known` (default: all are) have no target and limit nothing; without any, all rates are one.
    """
    k = len(shares)
    whole = sum(shares) or 1.0
    known = known or [True] * k
    fixed = F.col("fixed") if "fixed" in members.columns else F.lit(False)
    same = members.groupBy(fixed.alias("fixed"), *[f"p{i}" for i in range(k)]).agg(F.sum("tokens").cast("double").alias("tokens"))
    same = stored(same, "posteriors")

    steps: list[list[float]] = []

    def state() -> Column:
        """The rate after all steps, and the point (ahead of it by momentum) that the next step starts from."""
        start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("point"))
        if not steps:
            return start
        history = F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps])

        def one(now, s):
            moved = reduce(lambda a, b: a + b, [s[i] * F.col(f"p{i}") for i in range(k)])
            rate = F.greatest(F.lit(0.0), now["point"] - moved)
            if whole_domain is not None:
                rate = F.least(F.lit(1.0), rate)
            return F.struct(rate.alias("rate"), (rate + s[k] * (rate - now["rate"])).alias("point"))

        return F.when(fixed, start).otherwise(F.aggregate(history, start, one))

    def masses() -> tuple[list[float], list[float]]:
        """Tokens by domain at the rate and at the point."""
        now = same.withColumn("now", state())
        row = now.agg(*[F.sum(F.col("tokens") * F.col(f"p{i}") * F.col(c)) for c in ("now.rate", "now.point") for i in range(k)]).first()
        numbers = [float(x or 0) for x in row]
        return numbers[:k], numbers[k:]

    mass, ahead = masses()
    limits = [m / (s / whole) if m and s and sure else None for m, s, sure in zip(mass, shares, known)]
    if whole_domain is not None and limits[whole_domain] is not None:
        total = limits[whole_domain]
    elif total is None:
        total = min((x for x in limits if x is not None), default=0.0)
    target = [total * s / whole for s in shares]
    if whole_domain is not None:
        target = [min(t, m) for t, m in zip(target, mass)]
    # A domain without a target asks for no change.
    fitted = [bool(m) and sure for m, sure in zip(mass, known)]
    got, speed, near = mass, 1.0, NEAR * max(total, 1.0)
    for _ in range(STEPS):
        if all(abs(g - t) <= near for g, t, f in zip(got, target, fitted) if f):
            break
        # In this scale the curvature is at most one, so a step of one is safe.
        rest = [(g - t) / m if f else 0.0 for g, t, m, f in zip(ahead, target, mass, fitted)]
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        steps.append([*rest, (speed - 1) / faster])
        before, speed = got, faster
        got, ahead = masses()
        if max(abs(a - b) for a, b in zip(got, before)) <= near / 100:
            break  # as near as rates of zero or more can come
    return state()["rate"], got


def mix(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float], total: float | None = None, seed: int = 0, sample_rows: int = SAMPLE_ROWS,
    whole_domain: str | None = None, row: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, tokens, `<domain>_posterior` for each domain, rate, copies.

    `labels` has doc_id and domain; `weights` the wanted share of tokens by domain. Tokens are words. `copies` is the rate,
    rounded up or down by a hash of doc_id such that its mean is the rate; 0 leaves the document out. Labels of a
    null key, of other domains, or of several domains for one key do not count. Null text counts as empty and has no
    tokens; repeated rows have rates of their own. Without labels all domains are equally likely and all rates are one; a
    domain without held-out labels limits nothing. `total` and `whole_domain` (a name) are those of `fit_rates`; documents that
    are labelled as `whole_domain`, or unlabelled and as likely in it as not, stay once, and no document is repeated. `row` is
    a struct column with doc_id as a field, which names the rows of the result (and rounds them) instead of doc_id. An empty
    table gives no rows.
    """
    domains = list(weights)
    rows = docs.select(F.col(row or "doc_id").alias("doc_id"), "text")
    scores = stored(domain_scores(rows, labels, domains, sample_rows, None if row is None else "doc_id"), "domain-scores")
    members, known = posteriors(scores, domains)
    fixed = F.lit(False)
    if whole_domain is not None:
        likely = F.col(f"p{domains.index(whole_domain)}") >= 0.5
        fixed = F.when(F.col("domain").isNull(), likely).otherwise(F.col("domain") == whole_domain)
    members = stored(members.select("doc_id", "tokens", *[f"p{i}" for i in range(len(domains))], fixed.alias("fixed")), "domain-members")
    rate, _ = fit_rates(members, [weights[d] for d in domains], total, known, None if whole_domain is None else domains.index(whole_domain))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    # Rates are rounded, so that rates that only numerics keep from one do not drop or repeat documents.
    return members.withColumn("rate", F.round(rate, 4)).select(
        F.col("doc_id").alias(row or "doc_id"), "tokens", *[F.col(f"p{i}").alias(f"{d}_posterior") for i, d in enumerate(domains)], "rate",
        F.floor(F.col("rate") + chance).cast("long").alias("copies"))


def apply_copies(docs: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents, each as often as `copies` says (rows of one key alike)."""
    one_id, times, copy = (unused(docs, name) for name in ("_id", "_times", "_copy"))
    changed = mixed.filter("copies <> 1").select(F.col(key).alias(one_id), F.col("copies").alias(times)).dropDuplicates([one_id])
    changed = stored(changed, "changed-copies")
    joined = docs.join(hint_if_small(changed, changed.count()), F.col(key).eqNullSafe(F.col(one_id)), "left")
    n = F.coalesce(times, F.lit(1).cast("long"))
    return joined.filter(n > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), n))).select(*docs.columns)
