"""Sequential model-based parameter search with a stored trial table.

After some random trials, a round splits the trials so far into good and bad ones, estimates the density of each parameter
among either, draws candidates from the good density, and proposes those with the largest ratio of good to bad density.
Trials are stored round by round, and draws depend on the seed and the trial's number alone: a restart goes on where the
search stopped and finds what it would have found.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException

from flagstone.plans.shared import bounded_rows


@dataclass(frozen=True)
class Between:
    """Numbers from `low` to `high`, even on a logarithmic scale with `log`, rounded to multiples of `step` if there is one."""

    low: float
    high: float
    log: bool = False
    step: float | None = None

    def inner(self, value: float) -> float:
        return math.log(value) if self.log else value

    def outer(self, x: float) -> float:
        value = min(max(math.exp(x) if self.log else x, self.low), self.high)
        if self.step is None:
            return value
        most = math.floor((self.high - self.low) / self.step + 1e-9)
        return self.low + min(round((value - self.low) / self.step), most) * self.step

    def draw(self, rng):
        return self.outer(rng.uniform(self.inner(self.low), self.inner(self.high)))

    def density(self, seen: list):
        """Normal kernels at what was seen and one as wide as the range; returns a function to draw and one for the log density."""
        low, high = self.inner(self.low), self.inner(self.high)
        centres = np.array([*map(self.inner, seen), (low + high) / 2])
        widths = np.full(len(centres), max((high - low) / max(1.0, len(seen)) ** 0.5 / 2, 1e-12))
        widths[-1] = max(high - low, 1e-12)

        def draw(rng):
            i = rng.integers(len(centres))
            for _ in range(20):
                x = rng.normal(centres[i], widths[i])
                if low <= x <= high:
                    return self.outer(x)
            return self.outer(rng.uniform(low, high))

        def log_density(value) -> float:
            z = (self.inner(value) - centres) / widths
            return float(np.log(np.mean(np.exp(-z * z / 2) / widths) + 1e-300))

        return draw, log_density


@dataclass(frozen=True)
class OneOf:
    """One of some values."""

    values: tuple

    def draw(self, rng):
        return self.values[rng.integers(len(self.values))]

    def density(self, seen: list):
        chances = np.array([1 + sum(v == x for x in seen) for v in self.values], dtype=float)
        chances /= chances.sum()
        return (lambda rng: self.values[rng.choice(len(self.values), p=chances)],
                lambda value: math.log(chances[self.values.index(value)]))


# The search space of the boosted trees.
SPACE = {
    "learning_rate": Between(0.03, 0.2, log=True),
    "max_depth": OneOf((3, 4, 5, 6, 7)),
    "feature_fraction": Between(0.5, 1.0, step=0.1),
    "bagging_fraction": Between(0.5, 1.0, step=0.1),
    "reg_alpha": Between(0.0, 0.01),
    "reg_lambda": Between(0.0, 0.01),
    "min_data_in_leaf": OneOf((200, 600, 1000)),
}


def propose(
    space: dict, trials: list[tuple[int, dict, float]], number: int, seed: int = 1, startup: int = 10, good_share: float = 0.25, candidates: int = 24,
) -> dict:
    """The parameters of trial `number`, from finished trials `(number, parameters, value)`; larger values are better, ties go to
    the earlier trial."""
    rng = np.random.default_rng([seed, number])
    if len(trials) < startup:
        return {name: kind.draw(rng) for name, kind in space.items()}
    ranked = sorted(trials, key=lambda t: (-t[2], t[0]))
    cut = max(1, math.ceil(good_share * len(ranked)))
    chosen = {}
    for name, kind in space.items():
        draw, good = kind.density([t[1][name] for t in ranked[:cut]])
        _, bad = kind.density([t[1][name] for t in ranked[cut:]])
        drawn = [draw(rng) for _ in range(candidates)]
        chosen[name] = max(drawn, key=lambda v: good(v) - bad(v))
    return chosen


def stored_trials(spark: SparkSession, path: str) -> list[tuple[int, dict, float]]:
    """The trials below a folder; none where there is no folder yet. A trial that was stored twice counts once."""
    try:
        rows = bounded_rows(spark.read.schema("trial int, parameters string, value double").parquet(path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted({r["trial"]: (r["trial"], json.loads(r["parameters"]), r["value"]) for r in rows}.values(), key=lambda t: t[0])


def search(
    spark: SparkSession, objective: Callable[[dict], float], path: str, space: dict = SPACE, trials: int = 40, per_round: int = 4, seed: int = 1,
    startup: int = 10, good_share: float = 0.25, candidates: int = 24,
) -> tuple[dict, DataFrame]:
    """Look for the parameters with the largest value of `objective`; returns them and the table of trials: `trial`, one text column per
    parameter, `value`.

    The trials of a round run at a time, from threads of the driver (each starts Spark jobs of its own), and are appended to the
    table at `path` when all are done. A search over a folder with trials goes on behind its last whole round; a value
    that is not finite is an error. Parameters are plain JSON values.
    """
    done = stored_trials(spark, path)
    done = done[:len(done) // per_round * per_round] if len(done) < trials else done[:trials]
    while len(done) < trials:
        numbers = range(len(done), min(len(done) + per_round, trials))
        asked = [propose(space, done, n, seed, startup, good_share, candidates) for n in numbers]
        with ThreadPool(len(asked)) as pool:
            values = [float(v) for v in pool.map(objective, asked)]
        if not all(map(math.isfinite, values)):
            raise ValueError(f"a trial has no finite value: {values}")
        found = [(n, json.loads(json.dumps(p)), v) for n, p, v in zip(numbers, asked, values)]
        rows = [(n, json.dumps(p), v) for n, p, v in found]
        spark.createDataFrame(rows, "trial int, parameters string, value double").coalesce(1).write.mode("append").parquet(path)
        done += found
    best = min(done, key=lambda t: (-t[2], t[0]))
    schema = "trial int, " + ", ".join(f"`{name}` string" for name in space) + ", value double"
    table = spark.createDataFrame([(n, *[str(p[name]) for name in space], v) for n, p, v in done], schema)
    return best[1], table
