"""Toxicity by a classifier chain.

Categories are predicted one after another. Each has a linear (logistic) model of hashed words and word beginnings; from
the second category on it also sees the log odds of all earlier categories. While fitting, these come from models
that have not seen the row: FOLDS models of each category are fitted without one fold each, and a row takes its
own fold's prediction. The final model of a category is fitted on all labelled rows.

All labelled rows take part in the counts of features, in every fit and in the thresholds. Counts are one pass. A fit goes down by
limited-memory BFGS: a step needs the losses and gradients of all models of a category, which tasks make in one pass
and Spark adds up piece by piece, so the driver holds sums whose size the number of features bounds. Features of
labelled documents are stored; the others are found when a document is scored.
"""

from __future__ import annotations

import math
from collections import deque
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flagstone.llm.common import pack, stored, texts, unpack

BITS = 18
FOLDS, RIDGE, LEAST_ROWS, LEAST_RATIO = 4, 0.3, 3, 0.7
# Passes of a fit at most, steps that it remembers, and the share of the first slope at which it ends.
PASSES, REMEMBERED, LEAST_SLOPE = 20, 10, 3e-3
# Numbers in a piece of a sum, and cells of log odds per unit in which thresholds are looked for.
PIECE, CELLS = 1 << 16, 1000
# Labelled rows that a task of a pass sums up, so that sums are few beside rows, and keys that are few enough to be sent to all tasks.
TASK_ROWS, SENT_KEYS = 100_000, 1_000_000
# Tasks whose sums the driver adds up itself; those of more are added up by Spark first.
FEW_TASKS = 8
PREFIXES = (4, 5)
KNOWN_WORDS = 200_000
_KNOWN: dict[bytes, bytes] = {}
EDGES = b".,;:!?\"'()[]{}<>|*&%$#@~`^_+=/\\-"


def _numbers(word: bytes) -> bytes:
    """Feature numbers of a word: itself and its beginnings."""
    bare = word.strip(EDGES)
    chars = bare.decode("utf-8", "replace")
    parts = [bare, *(b"^" + chars[:n].encode() for n in PREFIXES if len(chars) >= n)]
    return np.array([xxhash.xxh3_64_intdigest(p) >> (64 - BITS) for p in parts], dtype="<i4").tobytes()


def features(text: bytes) -> np.ndarray:
    """The feature numbers of the distinct words of a whole text."""
    words = set(text.lower().split())
    new = words.difference(_KNOWN)
    if new:
        if len(_KNOWN) + len(new) > KNOWN_WORDS:
            _KNOWN.clear()
            new = words
        for w in new:
            _KNOWN[w] = _numbers(w)
    return np.frombuffer(b"".join(map(_KNOWN.__getitem__, words)), dtype="<i4")


def logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Rows:
    """Feature numbers of several rows, end to end."""

    def __init__(self, rows: list[np.ndarray]):
        self.sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.flat = np.concatenate(rows).astype(np.intp) if rows else np.zeros(0, np.intp)
        self.owner = np.repeat(np.arange(len(rows)), self.sizes)
        # Rows of many features weigh no more than others.
        self.scale = 1 / np.sqrt(np.maximum(self.sizes, 1) / 100)

    def times(self, w: np.ndarray) -> np.ndarray:
        out, some = np.zeros(len(self.sizes)), self.sizes > 0
        if some.any():
            out[some] = np.add.reduceat(w[self.flat], (np.cumsum(self.sizes) - self.sizes)[some])
        return out * self.scale

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.flat, np.repeat(r * self.scale, self.sizes), width)

    def parts(self) -> list[np.ndarray]:
        return np.split(self.flat, np.cumsum(self.sizes)[:-1])

    def only(self, wanted: np.ndarray) -> "Rows":
        """The same rows with the `wanted` features only, renumbered; the scale stays that of whole rows."""
        number, mine = np.cumsum(wanted) - 1, wanted[self.flat]
        out = Rows([])
        out.flat, out.owner, out.scale = number[self.flat[mine]], self.owner[mine], self.scale
        out.sizes = np.bincount(out.owner, minlength=len(self.sizes))
        return out


class Link:
    """A category's model: a weight per feature number, one per earlier category, and a constant."""

    def __init__(self, weights: np.ndarray, earlier: np.ndarray, constant: float):
        self.weights, self.earlier, self.constant = weights, earlier, constant

    def odds(self, rows: Rows, before: np.ndarray) -> np.ndarray:
        return rows.times(self.weights) + before @ self.earlier + self.constant


def feature_weights(seen: np.ndarray, good: np.ndarray, n: float, positives: float) -> np.ndarray:
    """What a feature counts, from the rows that have it (all and those of the category) and all rows: the log ratio of its
    shares in both classes, so the ridge hardly holds back those that tell the classes apart. Features of fewer than LEAST_ROWS
    rows or a ratio below LEAST_RATIO count nothing."""
    ratio = np.abs(np.log((good + 1) / (positives + 2)) - np.log((seen - good + 1) / (n - positives + 2)))
    return np.where((seen >= LEAST_ROWS) & (ratio >= LEAST_RATIO), ratio, 0.0)


def loss_sums(rows: Rows, before: np.ndarray, y: np.ndarray, use: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Logistic loss and its gradient by `v`: weights of features, of earlier categories, and the constant."""
    width, k = len(v) - before.shape[1] - 1, before.shape[1]
    z = np.clip(rows.times(v[:width]) + before @ v[width:width + k] + v[-1], -35, 35)
    r = np.where(use, logistic(z) - y, 0.0)
    loss = (np.logaddexp(0, z) - y * z)[use].sum()
    return np.concatenate([[loss], rows.back(r, width), before.T @ r, [r.sum()]])


def descend(sums, scale: np.ndarray, ridge: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """Minimise one convex function per row of `scale` by limited-memory BFGS with shortened steps, all in the same passes.

    `sums(v, open)` gives the loss and gradient by `v = w * scale` of each open function, a row of any numbers for others; `ridge` is that of w, and `curve` about the second
    derivatives by w, from which first steps are made.
    """
    models = len(scale)
    w, way, size, slope = np.zeros_like(scale), [None] * models, np.ones(models), np.zeros(models)
    trial, value, slopes = w.copy(), np.full(models, np.inf), [None] * models
    past, open_models, start = [deque(maxlen=REMEMBERED) for _ in range(models)], set(range(models)), [None] * models
    for _ in range(PASSES):
        found = sums(trial * scale, open_models)
        for m in sorted(open_models):
            f = found[m, 0] + (ridge * trial[m] ** 2).sum() / 2
            g = found[m, 1:] * scale[m] + ridge * trial[m]
            if f > value[m] + 1e-4 * size[m] * slope[m] and size[m] > 1e-3:
                # The lowest point of the parabola through both values and the slope.
                size[m] *= np.clip(-slope[m] * size[m] / (2 * (f - value[m] - slope[m] * size[m])), 0.1, 0.5)
                trial[m] = w[m] + size[m] * way[m]
                continue
            if f > value[m]:  # no way down is left
                open_models.discard(m)
                continue
            if slopes[m] is not None:
                s, d = trial[m] - w[m], g - slopes[m]
                if s @ d > 1e-12 * np.sqrt((s @ s) * (d @ d)):
                    past[m].append((s, d, 1 / (s @ d)))
            w[m], value[m], slopes[m] = trial[m], f, g
            steep = np.sqrt((g * g / curve[m]).sum())
            start[m] = start[m] or steep
            if steep <= LEAST_SLOPE * start[m]:
                open_models.discard(m)
                continue
            q, kept = g.copy(), []
            for s, d, rho in reversed(past[m]):
                kept.append(rho * (s @ q))
                q -= kept[-1] * d
            q /= curve[m]
            if past[m]:
                s, d, rho = past[m][-1]
                q *= (s @ d) / (d * d / curve[m]).sum()
            for (s, d, rho), a in zip(past[m], reversed(kept)):
                q += (a - rho * (d @ q)) * s
            way[m], slope[m], size[m] = -q, -(g @ q), 1.0
            trial[m] = w[m] + way[m]
        if not open_models:
            break
    return w * scale


def _fit(sums, seen: np.ndarray, good: np.ndarray, n: np.ndarray, positives: np.ndarray, by: np.ndarray, k: int, spread: float) -> np.ndarray:
    """Weights of models by counts of their features, `by` being what these count; `spread` is the mean of squared row scales."""
    models = len(by)
    # Log odds of earlier categories are taken on the scale of features.
    scale = np.column_stack([by, np.full((models, k), 0.25), np.ones(models)])
    ridge = np.concatenate([np.full(by.shape[1] + k, RIDGE), [1e-6]])
    share = ((positives + 1) / (n + 2))[:, None]
    rows = np.column_stack([seen * spread, np.tile(n[:, None] * 16, (1, k)), n])
    return descend(sums, scale, ridge, share * (1 - share) * rows * scale**2 + ridge)


def fit_link(rows: Rows, before: np.ndarray, y: np.ndarray) -> Link:
    """The model of rows in memory; `fit_links` fits stored rows."""
    seen = np.bincount(rows.flat, minlength=1 << BITS)
    good = np.bincount(rows.flat, y[rows.owner], 1 << BITS)
    by = feature_weights(seen, good, len(y), y.sum())
    wanted, k, use = by > 0, before.shape[1], np.ones(len(y), dtype=bool)
    some, width = rows.only(wanted), int(wanted.sum())
    counts = seen[wanted][None], good[wanted][None], np.array([len(y)]), np.array([y.sum()])
    w = _fit(lambda v, _: loss_sums(some, before, y, use, v[0])[None], *counts, by[wanted][None], k, (rows.scale**2).mean())[0]
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[wanted] = w[:width]
    return Link(weights, w[width:width + k], float(w[-1]))


def chain_odds(links: list[Link], rows: Rows) -> np.ndarray:
    """Log odds of each category, in order, each link fed with those before it."""
    out = np.zeros((len(rows.sizes), 0))
    for link in links:
        out = np.column_stack([out, np.clip(link.odds(rows, out), -12, 12)])
    return out


def packed(numbers: np.ndarray) -> bytes:
    """Feature numbers in order, as differences: of 16 bits, or of 32 after an odd byte where one is larger."""
    steps = np.diff(np.sort(numbers), prepend=0)
    return steps.astype("<u2").tobytes() if steps.max(initial=0) < 1 << 16 else b"+" + steps.astype("<i4").tobytes()


def packed_rows(column) -> Rows:
    return Rows([np.cumsum(np.frombuffer(x, "<u2") if len(x) % 2 == 0 else np.frombuffer(x, "<i4", offset=1), dtype=np.int32) for x in column.to_pylist()])


def _labels(batch: pa.RecordBatch, categories: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in categories])


def _parts(batch: pa.RecordBatch, rows: int = 2000):
    """Slices of a batch, so that a task holds the features of a few rows."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _added(rows: DataFrame, make, kind=np.float64, tasks: int | None = None) -> np.ndarray:
    """The sum over tasks of the flat array that `make` returns for a task's batches, added up by Spark in pieces of PIECE numbers
    that are sent as `kind`. `tasks`: their number at most, where that is known."""
    def run(batches):
        total = make(batches)
        if total is not None:
            parts = [pack(total[at:at + PIECE].astype(kind)) for at in range(0, len(total), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["piece", "data"])

    def add(table: pa.Table) -> pa.Table:
        total = 0.0
        for blob in table.column("data"):
            total = total + unpack(blob.as_py(), kind).astype(np.float64)
        return pa.table({"piece": table.column("piece")[:1], "data": pa.array([pack(total)], pa.binary())})

    sums = rows.mapInArrow(run, "piece int, data binary")
    few = tasks is not None and tasks <= FEW_TASKS
    found = (sums if few else sums.groupBy("piece").applyInArrow(add, "piece int, data binary")).collect()
    pieces: dict[int, np.ndarray] = {}
    for r in found:
        pieces[r["piece"]] = pieces.get(r["piece"], 0) + unpack(bytes(r["data"]), kind if few else np.float64).astype(np.float64)
    return np.concatenate([pieces[i] for i in sorted(pieces)]) if pieces else np.zeros(0)


def _counted(sample: DataFrame, categories: list[str]) -> np.ndarray:
    """By category and fold: rows with each feature, those of the category among them, then all rows, positives, and squared row scales."""
    size = 2 * (1 << BITS) + 3

    def make(batches):
        total = None
        for batch in (part for b in batches for part in _parts(b)):
            total = np.zeros((len(categories), FOLDS, size)) if total is None else total
            rows, labels, folds = packed_rows(batch.column("x")), _labels(batch, categories), batch.column("fold").to_numpy()
            for c in range(len(categories)):
                y = labels[:, c]
                for fold in range(FOLDS):
                    mine = ~np.isnan(y) & (folds == fold)
                    entries, here = rows.flat[mine[rows.owner]], total[c, fold]
                    here[:1 << BITS] += np.bincount(entries, minlength=1 << BITS)
                    here[1 << BITS:-3] += np.bincount(entries, y[rows.owner[mine[rows.owner]]], 1 << BITS)
                    here[-3:] += mine.sum(), y[mine].sum(), (rows.scale[mine] ** 2).sum()
        return None if total is None else total.ravel()

    found = _added(sample, make)
    return found.reshape(len(categories), FOLDS, size) if len(found) else np.zeros((len(categories), FOLDS, size))


def _held_out_odds(models: list[list[Link]], rows: Rows, folds: np.ndarray) -> np.ndarray:
    """Each row's log odds by the models of its own fold."""
    out = np.zeros((len(folds), len(models)))
    for fold in range(FOLDS) if models else ():
        odds = chain_odds([m[fold] for m in models], rows)
        out[folds == fold] = odds[folds == fold]
    return out


def fit_links(sample: DataFrame, models: list[list[Link]], counts: np.ndarray, categories: list[str], place: int) -> list[Link]:
    """The models of the category at `place`: without each fold, then the final one. `models` are those of the earlier categories."""
    models = list(models)
    # Counts of a model are those of all folds but its own.
    counts = np.stack([*(counts.sum(axis=0) - counts), counts.sum(axis=0)])
    seen, good = counts[:, :1 << BITS], counts[:, 1 << BITS:-3]
    n, positives, squares = counts[:, -3], counts[:, -2], counts[:, -1]
    by = np.stack([feature_weights(*x) for x in zip(seen, good, n, positives)])
    wanted = (by > 0).any(axis=0)
    width = int(wanted.sum())

    def reduced(batches):
        for batch in (part for b in batches for part in _parts(b)):
            rows, folds = packed_rows(batch.column("x")), batch.column("fold").to_numpy()
            before, some = _held_out_odds(models, rows, folds), rows.only(wanted)
            x = pa.array([packed(p) for p in some.parts()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [x, pa.array(rows.scale), pa.array(list(before), pa.list_(pa.float64())), batch.column("fold"), batch.column(categories[place])],
                names=["x", "scale", "before", "fold", "y"])

    known = sample.filter(F.col(categories[place]).isNotNull() & ~F.isnan(categories[place]))
    rows_of = stored(known.mapInArrow(reduced, "x binary, scale double, before array<double>, fold int, y double"), "toxic-rows")
    tasks = max(1, math.ceil(n[-1] / TASK_ROWS))
    rows_of = rows_of.coalesce(tasks)

    def sums(v: np.ndarray, open_models: set[int]) -> np.ndarray:
        asked = sorted(open_models)
        # Destroyed after the pass, so that no copies pile up on disk.
        sent = sample.sparkSession.sparkContext.broadcast(v[asked].astype(np.float32))

        def make(batches):
            total, weights = None, sent.value.astype(np.float64)
            for batch in (part for b in batches for part in _parts(b, 1000)):
                rows = packed_rows(batch.column("x"))
                rows.scale = batch.column("scale").to_numpy()
                before = np.array(batch.column("before").to_pylist(), dtype=float).reshape(batch.num_rows, len(models))
                folds, y = batch.column("fold").to_numpy(), batch.column("y").to_numpy()
                here = np.stack([loss_sums(rows, before, y, folds != m, x) for m, x in zip(asked, weights)])
                total = here if total is None else total + here
            return None if total is None else total.ravel()

        try:
            found = _added(rows_of, make, np.float32, tasks)
        finally:
            sent.destroy()
        out = np.zeros((FOLDS + 1, v.shape[1] + 1))
        out[asked] = found.reshape(len(asked), -1) if len(found) else 0
        return out

    spread = squares.sum() / max(n.sum(), 1)
    w = _fit(sums, seen[:, wanted], good[:, wanted], n, positives, by[:, wanted], place, spread)
    links = []
    for row in w:
        weights = np.zeros(1 << BITS, dtype=np.float32)
        weights[wanted] = row[:width]
        links.append(Link(weights, row[width:width + place], float(row[-1])))
    return links


def fit_chain(sample: DataFrame, categories: list[str]) -> tuple[list[Link], dict[str, float]]:
    """The chain's final links and, per category, the probability from which it is said to hold.

    `sample` is a stored table `(x, fold, stands_for, <categories>)` of the labelled rows. The thresholds are those with the best F1 on
    out-of-fold predictions, between cells of 1 / CELLS of log odds. A category without both labels never holds.
    """
    if sample.isEmpty():
        return [], {c: 2.0 for c in categories}
    counts = _counted(sample, categories)
    models: list[list[Link]] = []  # by category: FOLDS models, then the final one
    for place in range(len(categories)):
        models.append(fit_links(sample, models, counts[place], categories, place))

    def held_out(batches):
        for batch in (part for b in batches for part in _parts(b)):
            odds = _held_out_odds(models, packed_rows(batch.column("x")), batch.column("fold").to_numpy())
            cells = np.round(odds * CELLS).astype(int)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(list(a), pa.list_(t)) for a, t in ((cells, pa.int64()), (_labels(batch, categories), pa.float64()))), batch.column("stands_for")],
                names=["cells", "labels", "n"])

    told = sample.mapInArrow(held_out, "cells array<long>, labels array<double>, n double")
    told = told.select(F.posexplode(F.arrays_zip("cells", "labels")).alias("place", "e"), "n").filter("not isnan(e.labels)")
    # At most a row per category, label and cell of the clipped log odds.
    told = told.groupBy("place", "e.cells", "e.labels").agg(F.sum("n").alias("n")).collect()
    thresholds = {}
    for place, c in enumerate(categories):
        mine = np.array([(r["cells"] / CELLS, r["labels"], r["n"]) for r in told if r["place"] == place]).reshape(-1, 3)
        thresholds[c] = best_threshold(logistic(mine[:, 0]), mine[:, 1], mine[:, 2])
    return [m[FOLDS] for m in models], thresholds


def best_threshold(p: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The middle of the gap between probabilities at which F1 is best; beyond 1 without both labels. `n`: rows that a row stands for."""
    known = ~np.isnan(y)
    n = np.ones(len(y))[known] if n is None else n[known]
    p, y = p[known], y[known]
    if not 0 < y.sum() < len(y):
        return 2.0
    order = np.argsort(-p, kind="stable")
    p, y, n = p[order], y[order], n[order]
    f1 = 2 * np.cumsum(n * y) / (np.cumsum(n) + (n * y).sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # equal probabilities stay together
    at = int(np.argmax(f1))
    return float((p[at] + (p[at + 1] if at + 1 < len(p) else 0)) / 2)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, categories: list[str], key: str = "doc_id", text: str = "text", sample_rows: int | None = None,
) -> DataFrame:
    """One row per document: key, for each category `<category>_probability`, and `<category>` as a boolean.

    `labels` has the key and a column of 0, 1 or null per category, in the order of the chain. Labels of a null key do not
    count; of several rows of a key the greatest label does, and one of several texts of a key is learned from. Null text counts as empty; repeated rows are scored
    each. Without labels probabilities are null and no category holds. An empty table gives no rows. All labelled rows are learned from, unless
    `sample_rows` asks for fewer, chosen by hash of the key.
    """
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(*[F.max(F.col(c).cast("double")).alias(c) for c in categories])
    known = known.withColumn("stands_for", F.lit(1.0)) if sample_rows is None else _sampled(known, categories, sample_rows)
    known = stored(known, "toxic-labels")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def featured(batches):
        for batch in batches:
            x = pa.array([packed(features(t)) for t in texts(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["doc_id", "x"])

    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int")
    ids = known.select("_id")
    some = rows.filter("doc_id is not null")
    if known.count() <= SENT_KEYS:  # other rows need not be shuffled
        some = some.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left_semi")
    some = some.mapInArrow(featured, f"doc_id {kind}, x binary")
    # Features are shuffled by key once, for the labels and for one text per key, chosen by its hash.
    found = some.join(known.hint("merge"), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(
        F.min_by("x", F.struct(F.xxhash64("x"), "x")).alias("x"), *[F.max(c).alias(c) for c in ("stands_for", *categories)])
    sample = stored(found.select("x", fold.alias("fold"), "stands_for", *categories), "toxic-sample")
    links, thresholds = fit_chain(sample, categories)

    def run(batches):
        for batch in (part for b in batches for part in _parts(b, 1000)):
            if links:
                p = logistic(chain_odds(links, Rows([features(t) for t in texts(batch.column(1))])))
                cells = [pa.array(p[:, i]) for i in range(len(categories))]
                told = [pa.array(p[:, i] >= thresholds[c]) for i, c in enumerate(categories)]
            else:
                cells = [pa.nulls(batch.num_rows, pa.float64())] * len(categories)
                told = [pa.array([False] * batch.num_rows)] * len(categories)
            yield pa.RecordBatch.from_arrays([batch.column(0), *cells, *told], names=["doc_id", *(f"{c}_probability" for c in categories), *categories])

    schema = f"doc_id {kind}, " + ", ".join([*(f"{c}_probability double" for c in categories), *(f"{c} boolean" for c in categories)])
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", key)


def _sampled(known: DataFrame, categories: list[str], sample_rows: int) -> DataFrame:
    """At most `sample_rows` labelled keys. Half the sample is kept for rows with some category, as far as there are; other rows
    then stand for more of their kind."""
    known = stored(known.withColumn("some", F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) for c in categories], F.lit(0.0)) > 0), "toxic-labels")
    sizes = {r["some"]: r["count"] for r in known.groupBy("some").count().collect()}
    with_some = min(sizes.get(True, 0), max(sample_rows // 2, sample_rows - sizes.get(False, 0)))
    quota = {True: with_some, False: min(sizes.get(False, 0), sample_rows - with_some)}
    by_hash = [
        known.filter(F.col("some") == kind).orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(n)
        .withColumn("stands_for", F.lit(sizes[kind] / n)) for kind, n in quota.items() if n]
    return reduce(DataFrame.unionByName, by_hash) if by_hash else known.withColumn("stands_for", F.lit(1.0))
