"""Quality classifier by co-training of two views.

The views are the text itself (statistics of its characters, words and lines) and the page's metadata (language, source and
length). Each view has a logistic model. In every round each model labels all documents without a label; those it is
confident of become training rows of the other view, at a lower weight. At the end each view is calibrated on
labelled rows that no fit has seen, the calibrated views are combined there, and every document is scored.

All rows take part in every fit: a Newton step needs only sums of small matrices, which tasks make in one pass and
Spark adds up; the driver sees at most BUCKETS blocks of them. Features are stored once.
"""

from __future__ import annotations

import math
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flagstone.llm.common import stored, texts

ROUNDS, NEWTON_STEPS, CONFIDENT, PSEUDO_WEIGHT, RIDGE = 3, 5, 0.98, 0.25, 1.0
BUCKETS = 32
# Folds by hash of the key: one of FOLDS calibrates and combines, the others train.
FOLDS = 5
SOURCES, LANGUAGES = 32, 8
LETTERS = bytes(sorted({*string.ascii_letters.encode(), *range(128, 256)}))
CAPITALS, DIGITS = string.ascii_uppercase.encode(), string.digits.encode()
SYMBOLS = bytes(sorted(set(string.punctuation.encode()) - set(b".,'-!|")))
TEXT_WIDTH = 25
META_WIDTH = 3 + SOURCES + LANGUAGES
GRID, REACH = 96, 12.0  # cells of the calibration histogram, by log odds from -REACH to REACH


def text_view(text: bytes) -> list[float]:
    """Shares and rates of a whole text, and a constant."""
    n = len(text) or 1
    cut = lambda chars: len(text) - len(text.translate(None, chars))
    letters, capitals, digits, symbols = cut(LETTERS), cut(CAPITALS), cut(DIGITS), cut(SYMBOLS)
    words, lines = text.split(), text.split(b"\n")
    m, counts = len(words) or 1, Counter(words)
    again = sum(map(bytes.__eq__, words, words[1:]))
    loud = sum(w.isupper() and len(w) > 1 for w in counts)
    short = sum(k for w, k in counts.items() if len(w) <= 2)
    bars, shouts = text.count(b"|"), text.count(b"!")
    size = math.log1p(len(words)) / 10
    root = math.sqrt
    return [
        1.0, letters / n, capitals / (letters or 1), root(capitals / (letters or 1)), digits / n, root(digits / n), symbols / n,
        root(symbols / n), shouts / m, root(shouts / m), bars / m, root(bars / m), text.count(b".") / m, text.count(b",") / m, len(counts) / m,
        max(counts.values(), default=0) / m, again / m, root(again / m), len(set(lines)) / len(lines), letters / m / 10, size, size * size,
        len(zlib.compress(text, 1)) / n, loud / (len(counts) or 1), short / m,
    ]


def meta_view(lang: str | None, source: str | None, chars: int | None) -> list[float]:
    """Hashed language and source, and the length in characters (null or negative: none)."""
    size = math.log1p(max(chars or 0, 0)) / 10
    row = [1.0, size, size * size] + [0.0] * (SOURCES + LANGUAGES)
    row[3 + xxhash.xxh3_64_intdigest(source or "") % SOURCES] = 1.0
    row[3 + SOURCES + xxhash.xxh3_64_intdigest(lang or "") % LANGUAGES] = 1.0
    return row


def featured(docs: DataFrame) -> DataFrame:
    """`(doc_id, x)`: both views of a document as 32-bit floats, text first. Expects doc_id, text, lang, source, n_chars."""
    def run(batches):
        for batch in batches:
            meta = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
            x = [np.array(text_view(t) + meta_view(*m), dtype="<f4").tobytes() for t, m in zip(texts(batch.column(1)), meta)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["doc_id", "x"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x binary")


def summed(rows: DataFrame, make, size: int) -> np.ndarray:
    """The sum of `make(x, y, fold)` (arrays of `size` numbers) over the batches of a feature table."""
    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<f4").reshape(batch.num_rows, -1).astype(np.float64)
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                total += make(x, y, batch.column(2).to_numpy())
        bucket = TaskContext.get().partitionId() % BUCKETS
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["bucket", "data"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for blob in table.column("data"):
            total += np.frombuffer(blob.as_buffer())
        return pa.table({"data": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("x", "y", "fold").mapInArrow(run, "bucket int, data binary").groupBy("bucket").applyInArrow(add, "data binary").collect()
    return sum((np.frombuffer(bytes(p["data"])) for p in parts), np.zeros(size))


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def newton(x, y, weight, w) -> np.ndarray:
    """Gradient and curvature of weighted logistic loss, flat."""
    p = logistic(x @ w)
    return np.concatenate([x.T @ (weight * (y - p)), ((x * (weight * p * (1 - p) + 1e-9 * weight)[:, None]).T @ x).ravel()])


def step(w: np.ndarray, sums: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    d = len(w)
    move = np.linalg.solve(sums[d:].reshape(d, d) + ridge * np.eye(d), sums[:d] - ridge * w)
    return w + move * min(1.0, 10 / (np.abs(move).max() + 1e-12))


class Model:
    """Scales, the coefficients of both views, and their calibrated combination."""

    def __init__(self, mean, spread):
        self.mean, self.spread = mean, spread
        self.w = [np.zeros(TEXT_WIDTH), np.zeros(META_WIDTH)]
        self.join = np.array([0.0, 1.0, 0.0])
        self.calibrated = [np.array([0.0, 1.0]), np.array([0.0, 1.0])]

    def views(self, x):
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return z[:, :TEXT_WIDTH], z[:, TEXT_WIDTH:]

    def odds(self, x) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.clip(v @ w, -REACH, REACH) for v, w in zip(self.views(x), self.w))

    def calibrated_odds(self, odds):
        return [a + b * o for (a, b), o in zip(self.calibrated, odds)]

    def score(self, odds) -> np.ndarray:
        text, meta = self.calibrated_odds(odds)
        return logistic(self.join[0] + self.join[1] * text + self.join[2] * meta)


def _fit_cells(x: np.ndarray, good: np.ndarray, bad: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A small logistic model of counted cells."""
    w = start.copy()
    for _ in range(30):
        one, two = newton(x, np.ones(len(x)), good, w), newton(x, np.zeros(len(x)), bad, w)
        w = step(w, one + two, 1e-2)
    return w


def calibrate(model: Model, rows: DataFrame) -> None:
    """Calibrate each view and combine them on the fold that no fit has seen, by a histogram of both views' log odds."""
    def cells(x, y, fold):
        mine = (fold == 0) & ~np.isnan(y)
        at = [np.clip(((o + REACH) / (2 * REACH) * GRID).astype(int), 0, GRID - 1) for o in model.odds(x[mine])]
        return np.bincount((at[0] * GRID + at[1]) * 2 + (y[mine] > 0.5), minlength=2 * GRID * GRID).astype(float)

    bad, good = summed(rows, cells, 2 * GRID * GRID).reshape(GRID, GRID, 2).transpose(2, 0, 1)
    if not good.sum() or not bad.sum():
        return
    centre = (np.arange(GRID) + 0.5) * 2 * REACH / GRID - REACH
    ones = np.ones(GRID)
    for view, axis in ((0, 1), (1, 0)):
        model.calibrated[view] = _fit_cells(np.column_stack([ones, centre]), good.sum(axis=axis), bad.sum(axis=axis), model.calibrated[view])
    text, meta = np.meshgrid(centre, centre, indexing="ij")
    text, meta = model.calibrated_odds((text.ravel(), meta.ravel()))
    some = (good + bad).ravel() > 0
    x = np.column_stack([np.ones(some.sum()), text[some], meta[some]])
    model.join = _fit_cells(x, good.ravel()[some], bad.ravel()[some], model.join)


def train(rows: DataFrame) -> Model | None:
    """Co-train on a stored table `(doc_id, x, y, fold)`, `y` being null without a label. None without both labels."""
    width = TEXT_WIDTH + META_WIDTH

    def moments(x, y, fold):
        labelled = (fold != 0) & ~np.isnan(y)
        return np.concatenate([[len(x), labelled.sum(), y[labelled].sum()], x.sum(axis=0), (x * x).sum(axis=0)])

    sums = summed(rows, moments, 3 + 2 * width)
    n, labelled, good = sums[:3]
    if not 0 < good < labelled:
        return None
    mean = sums[3:3 + width] / n
    spread = np.sqrt(np.maximum(sums[3 + width:] / n - mean * mean, 0)) + 1e-6
    for constant in (0, TEXT_WIDTH):
        mean[constant], spread[constant] = 0.0, 1.0
    model = Model(mean, spread)
    teacher: Model | None = None
    for _ in range(ROUNDS):
        for _ in range(NEWTON_STEPS):
            def sums_of(x, y, fold, model=model, teacher=teacher):
                known = ~np.isnan(y)
                views, out = model.views(x), []
                told = [logistic(o) for o in teacher.odds(x)] if teacher else None
                for view in (0, 1):
                    target, weight = np.where(known, y, 0.0), np.where(known & (fold != 0), 1.0, 0.0)
                    if told:
                        p = told[1 - view]  # the other view's opinion
                        sure = ~known & (np.maximum(p, 1 - p) >= CONFIDENT)
                        target, weight = np.where(sure, p > 0.5, target), np.where(sure, PSEUDO_WEIGHT, weight)
                    out.append(newton(views[view], target, weight, model.w[view]))
                return np.concatenate(out)

            first = TEXT_WIDTH + TEXT_WIDTH**2
            sums = summed(rows, sums_of, first + META_WIDTH + META_WIDTH**2)
            new = Model(mean, spread)
            new.w = [step(model.w[0], sums[:first]), step(model.w[1], sums[first:])]
            moved = max(np.abs(a - b).max() for a, b in zip(new.w, model.w))
            model = new
            if moved < 1e-2:
                break
        teacher = model
    calibrate(model, rows)
    return model


def score_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text", label: str = "quality",
    row: str | None = None,
) -> DataFrame:
    """One row per document: key, text_probability, metadata_probability, quality, kept (`quality >= threshold`).

    `labels` has the key and a label of 0 or 1. Labels of a null key, null labels and keys with both labels do not count.
    Null text counts as empty; metadata columns (lang, source, n_chars) may be null. Repeated rows are scored
    each. `row` is a struct column with the key as a field, which names the rows of the result instead of the key. Without
    labels of both kinds nothing can be learned: probabilities are null and all documents are kept. An
    empty table gives no rows.
    """
    truth = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_id"))
        .agg(F.min(label).alias("low"), F.max(label).alias("high")).filter("low = high").select("_id", F.col("low").cast("double").alias("y"))
    )
    rows = docs.select(F.col(row or key).alias("doc_id"), F.col(text).alias("text"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    own = F.col("doc_id") if row is None else F.col("doc_id")[key]
    fold = F.pmod(F.xxhash64(own, F.lit(7)), F.lit(FOLDS)).cast("int")
    table = featured(rows).join(truth, own == F.col("_id"), "left").select("doc_id", "x", "y", fold.alias("fold"))
    table = stored(table, "quality-features")
    model = train(table)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            if model is None:
                p = [pa.nulls(batch.num_rows, pa.float64())] * 3
                kept = pa.array([True] * batch.num_rows)
            else:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f4").reshape(batch.num_rows, -1).astype(np.float64)
                odds = model.odds(x)
                quality = model.score(odds)
                p = [pa.array(v) for v in (*map(logistic, model.calibrated_odds(odds)), quality)]
                kept = pa.array(quality >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), *p, kept], names=["doc_id", "a", "b", "c", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = table.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, text_probability double, metadata_probability double, quality double, kept boolean")
    return scored.withColumnRenamed("doc_id", row or key)
