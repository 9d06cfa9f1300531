"""Choosing a classification pipeline: Spark ML candidates by successive halving, under a budget."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.schema import FEATURES

LABEL = "isBot"
FOLDS = 5
#: A round keeps one candidate in so many, and the next shows them so many times the rows.
THIRD = 3
PLACES = 1 << 20


@dataclass(frozen=True)
class Candidate:
    """A classifier with settings, with or without scaled features."""

    name: str
    make: Callable[[str], object]
    scaled: bool = False

    @property
    def title(self) -> str:
        return self.name + ("/scaled" if self.scaled else "")

    def pipeline(self, columns: Sequence[str]) -> Pipeline:
        stages = [VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep")]
        if self.scaled:
            stages.append(StandardScaler(inputCol="features", outputCol="scaled"))
        return Pipeline(stages=[*stages, self.make("scaled" if self.scaled else "features")])


def _common(column: str) -> dict:
    return {"featuresCol": column, "labelCol": LABEL}


def candidates() -> list[Candidate]:
    """The default search space; of equally good candidates the earlier wins."""
    makers = [
        ("tree-5", lambda c: DecisionTreeClassifier(maxDepth=5, seed=1, **_common(c))),
        ("bayes", lambda c: NaiveBayes(modelType="gaussian", **_common(c))),
        ("logistic-0", lambda c: LogisticRegression(maxIter=50, **_common(c))),
        ("logistic-0.1", lambda c: LogisticRegression(maxIter=50, regParam=0.1, **_common(c))),
        ("tree-10", lambda c: DecisionTreeClassifier(maxDepth=10, seed=1, **_common(c))),
        ("svc", lambda c: LinearSVC(maxIter=50, regParam=0.01, **_common(c))),
        ("forest-20", lambda c: RandomForestClassifier(numTrees=20, maxDepth=8, seed=1, **_common(c))),
        ("forest-100", lambda c: RandomForestClassifier(numTrees=100, maxDepth=10, seed=1, **_common(c))),
        ("boosted-20", lambda c: GBTClassifier(maxIter=20, seed=1, **_common(c))),
    ]
    return [Candidate(name, make, scaled) for name, make in makers for scaled in (False, True)]


def accuracy(predicted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose prediction equals the label."""
    hit = (F.col("prediction").cast("int") == F.col(LABEL)).cast("int")
    return predicted.groupBy(*by).agg(F.avg(hit).alias("accuracy"), F.count("*").alias("n_rows"))


@dataclass(frozen=True)
class Selection:
    """The fitted pipeline, its name, and (name, validation accuracy) of everything tried,
    as of the last round it was in."""

    model: PipelineModel
    name: str
    tried: tuple[tuple[str, float], ...]

    def predict(self, rows: DataFrame) -> DataFrame:
        return run(self.model, rows)


def run(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with a 0/1 ``prediction``; the vectors made on the way are dropped."""
    out = model.transform(rows)
    return out.select(*rows.columns, F.col("prediction").cast("int").alias("prediction"))


def select_model(
    rows: DataFrame,
    columns: Sequence[str] = tuple(FEATURES),
    time_limit: float | None = 60.0,
    max_candidates: int | None = None,
    space: Sequence[Candidate] | None = None,
    parallel: int = 4,
    least_rows: int = 2000,
) -> Selection:
    """Successive halving over the candidates; the best is fitted again on all rows.

    All candidates learn from a small share of the training rows and are scored on the held-out
    rows; the best third goes on to a share three times as large, until the last few have seen
    all of them. The first share is a ninth, or what gives ``least_rows`` if that is more. Shares
    and held-out rows go by a hash of the values, so they do not depend on partitions, a smaller
    share lies within a larger one, and copies of a row stay on one side. Of equal scores the
    candidate earlier in the space wins, so without a time limit the outcome can be repeated.

    Candidates of a round run side by side. When the time is up the jobs of those still running
    are cancelled and the best of the scored ones wins; one is always scored. Nothing is capped
    unless ``max_candidates`` says so.
    """
    deadline = None if time_limit is None else time.monotonic() + time_limit
    space = list(space or candidates())[:max_candidates]
    typed = [F.col(c).cast("double").alias(c) for c in columns]
    mark = F.xxhash64(*columns)
    data = rows.select(*typed, F.col(LABEL).cast("int").alias(LABEL)).withColumns({
        "held": F.pmod(mark, F.lit(FOLDS)) == 0, "_place": F.pmod(F.xxhash64(mark), F.lit(PLACES)),
    }).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        seen = data.selectExpr(
            f"min(CASE WHEN NOT held THEN {LABEL} END) AS low", f"max(CASE WHEN NOT held THEN {LABEL} END) AS high",
            "count_if(held) AS n_held", "count_if(NOT held) AS n_train",
        ).first()
        # without two classes to learn from, or nothing to test on, all rows serve both ends
        whole = seen.low == seen.high or seen.n_held == 0
        train = data if whole else data.filter(~F.col("held"))
        test = data if whole else data.filter("held")
        share = 1.0 if whole else min(max(1 / THIRD**2, least_rows / max(seen.n_train, 1)), 1.0)
        scores: dict[int, float] = {}
        running, fitted = list(range(len(space))), {}
        while True:
            part = train.filter(F.col("_place") < int(share * PLACES)) if share < 1 else train
            made = _scored([(n, space[n]) for n in running], columns, part, test, deadline, parallel, not scores)
            scores |= {n: score for n, (score, _) in made.items()}
            fitted = made or fitted
            order = sorted(fitted, key=lambda n: (-fitted[n][0], n))
            late = deadline is not None and time.monotonic() > deadline
            if share >= 1 or late or len(order) == 1:
                break
            running = sorted(order[: -(-len(order) // THIRD)])
            share = min(share * THIRD, 1.0)
        best = order[0]
        model = fitted[best][1] if whole else space[best].pipeline(columns).fit(data)
        return Selection(model, space[best].title, tuple((space[n].title, scores[n]) for n in sorted(scores)))
    finally:
        data.unpersist()


def _scored(
    tries: Sequence[tuple[int, Candidate]], columns: Sequence[str], train: DataFrame, test: DataFrame,
    deadline: float | None, parallel: int, first: bool,
) -> dict[int, tuple[float, PipelineModel]]:
    """Fit and score candidates side by side; those that the deadline cuts off are missing.

    In the ``first`` round the first of them is waited for, whatever the time.
    """
    context = train.sparkSession.sparkContext
    tag = f"candidates-{uuid.uuid4().hex}"

    def one(candidate: Candidate) -> tuple[float, PipelineModel]:
        context.addJobTag(tag)
        try:
            model = candidate.pipeline(columns).fit(train)
            return accuracy(run(model, test)).first()["accuracy"], model
        finally:
            context.removeJobTag(tag)

    out = {}
    if first:
        number, candidate = tries[0]
        out[number], tries = one(candidate), tries[1:]
    pool, waiting = ThreadPoolExecutor(parallel), {}
    try:
        waiting = {number: pool.submit(inheritable_thread_target(one), c) for number, c in tries}
        left = None if deadline is None else max(deadline - time.monotonic(), 0)
        wait(waiting.values(), timeout=left)
        for number, future in waiting.items():
            if future.done():
                out[number] = future.result()
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
        while any(not f.done() for f in waiting.values()):  # a candidate cut off may begin another job
            context.cancelJobsWithTag(tag)
            time.sleep(0.2)
    return out


def as_json(selection: Selection) -> str:
    """Settings of the chosen pipeline, stage by stage."""
    stages = [
        {
            "stage": type(stage).__name__,
            "settings": {p.name: v for p, v in stage.extractParamMap().items()},
        }
        for stage in selection.model.stages
    ]
    return json.dumps({"name": selection.name, "stages": stages}, default=str)
