"""Sweeps and grid searches over model settings; Spark fits every model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from statistics import fmean, pstdev

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsight.constants import (
    C_GRID,
    C_SWEEP,
    C_VALIDATION,
    DEPTH_GRID,
    DEPTH_SWEEP,
    FEATURES_GRID,
    FOLDS,
    MAX_ITER_GRID,
    TREES,
    TREES_SWEEP,
)
from subsight.operators.models import (
    DEEPEST,
    LABEL,
    PenalisedLogit,
    TrainingData,
    forest,
    iterations_of,
)

FITS_AT_ONCE = 8


def _side_by_side(data: TrainingData, work: Callable, items: list, at_once: int = FITS_AT_ONCE) -> list:
    """Run independent fits from several driver threads, so that their jobs share the cluster.

    Each call is wrapped by itself: one wrapper for all would share the
    thread's job properties, and the fits would overwrite each other's.
    """
    session = data.train.sparkSession
    calls = [inheritable_thread_target(session)(lambda item=item: work(item)) for item in items]
    with ThreadPool(min(at_once, len(calls))) as pool:
        return pool.map(lambda call: call(), calls, chunksize=1)


def _table(data: TrainingData, rows: list[tuple], schema: str) -> DataFrame:
    return data.train.sparkSession.createDataFrame(rows, schema)


# --- cross-validation ----------------------------------------------------------------


@dataclass(frozen=True)
class Search:
    """Accuracy of each setting over the folds, and the best setting fitted on all train rows."""

    settings: list[dict]
    train_scores: list[list[float]]
    scores: list[list[float]]
    best: int
    model: Model

    def rows(self) -> list[tuple]:
        return [
            (
                ", ".join(f"{name}={value}" for name, value in sorted(setting.items())),
                fmean(self.train_scores[i]),
                fmean(self.scores[i]),
                pstdev(self.scores[i]),
                len(self.scores[i]),
                i == self.best,
            )
            for i, setting in enumerate(self.settings)
        ]


def _alike(settings: list[dict]) -> list[list[int]]:
    """Numbers of the settings that differ in the limit of iterations, or in the depth, only; the largest first."""
    groups: dict[tuple, list[int]] = {}
    for i, setting in enumerate(settings):
        limit = "depth" if "depth" in setting else "maxIter"
        rest = tuple(sorted((k, v) for k, v in setting.items() if k != limit))
        groups.setdefault(rest, []).append(i)
    return [sorted(g, key=lambda i: -settings[i].get("depth", settings[i].get("maxIter", 0))) for g in groups.values()]


def _accuracies(scored: DataFrame, fold: int) -> tuple[float, float]:
    """Accuracy on the fitted and on the held-out rows, in one pass."""
    held = F.col("fold") == fold
    right = F.avg((F.col("prediction") == F.col(LABEL)).cast("double"))
    found = {r["held"]: r["accuracy"] for r in scored.groupBy(held.alias("held")).agg(right.alias("accuracy")).collect()}
    return found.get(False, float("nan")), found.get(True, float("nan"))


def cross_validate(
    data: TrainingData,
    make: Callable[..., Estimator],
    settings: list[dict],
    folds: int = FOLDS,
) -> Search:
    """Fit every setting on every fold. A fold without rows has no score; ``folds_used`` tells.

    Settings that differ in the limit of iterations share a fit that none of their limits ends;
    forests that differ in the depth are cut from one.
    """
    train = data.train.persist(StorageLevel.MEMORY_AND_DISK)

    def fitted(fold: int, i: int) -> Model:
        estimator = make(**settings[i])
        if estimator.hasParam("rows"):
            estimator.set(estimator.getParam("rows"), total - held[fold])
        return estimator.fit(train.where(F.col("fold") != fold))

    def run(task: tuple[int, list[int]]) -> list[tuple[int, float, float]]:
        fold, alike = task
        if "depth" in settings[alike[0]]:
            grown = make(**settings[alike[0]]).fit_depths(train.where(F.col("fold") != fold), [settings[i]["depth"] for i in alike])
            return [(i, *_accuracies(grown[settings[i]["depth"]].transform(train), fold)) for i in alike]
        found, model = [], None
        for i in alike:
            # A fit that ended within a smaller limit is the fit of that limit, step by step.
            if model is None or "maxIter" not in settings[i] or iterations_of(model) > settings[i]["maxIter"]:
                model = fitted(fold, i)
                pair = _accuracies(model.transform(train), fold)
            found.append((i, *pair))
        return found

    held = {row["fold"]: row["count"] for row in train.groupBy("fold").count().collect()}
    total = sum(held.values())
    tasks = [(fold, alike) for alike in _alike(settings) for fold in sorted(held) if fold < folds]
    train_scores = [[] for _ in settings]
    scores = [[] for _ in settings]
    try:
        for found in _side_by_side(data, run, tasks):
            for i, on_train, on_held_out in found:
                train_scores[i].append(on_train)
                scores[i].append(on_held_out)
    finally:
        train.unpersist()
    means = [fmean(s) for s in scores]
    best = means.index(max(means))
    return Search(settings, train_scores, scores, best, make(**settings[best]).fit(data.train))


def search_results(data: TrainingData, found: Search) -> DataFrame:
    """All settings of a search with their accuracy; the first best one is marked."""
    return _table(
        data,
        found.rows(),
        "setting string, train_accuracy double, mean_accuracy double, std_accuracy double,"
        " folds_used int, is_best boolean",
    )


def validation_curve(data: TrainingData, values: list[float] = C_VALIDATION) -> DataFrame:
    """Accuracy on the fitted and on the held-out folds for each value of C."""
    found = cross_validate(data, PenalisedLogit, [{"C": c} for c in values])
    rows = [
        (c, fmean(t), pstdev(t), fmean(s), pstdev(s), len(s))
        for c, t, s in zip(values, found.train_scores, found.scores)
    ]
    return _table(
        data,
        rows,
        "c double, train_accuracy double, train_std double, mean_accuracy double, std_accuracy double,"
        " folds_used int",
    )


def search_logistic(
    data: TrainingData, cs: list[float] = C_GRID, iterations: list[int] = MAX_ITER_GRID
) -> Search:
    """Grid search over C and the iteration limit."""
    settings = [{"C": c, "maxIter": m} for c in cs for m in iterations]
    return cross_validate(data, PenalisedLogit, settings)


def search_forest(
    data: TrainingData,
    depths: list[int] = DEPTH_GRID,
    features: list[int] = FEATURES_GRID,
    trees: int = TREES,
) -> Search:
    """Grid search over depth and features per split."""

    def make(depth: int, features: int) -> Estimator:
        return forest(trees, depth, features_per_split=str(features))

    settings = [{"depth": d, "features": f} for d in depths for f in features]
    return cross_validate(data, make, settings)


# --- sweeps -------------------------------------------------------------------------


def _areas(data: TrainingData, model: Model) -> tuple[float, float]:
    """Exact AUC on train and test rows."""
    judge = BinaryClassificationEvaluator(
        labelCol=LABEL, rawPredictionCol="probability", metricName="areaUnderROC", numBins=0
    )
    return judge.evaluate(model.transform(data.train)), judge.evaluate(model.transform(data.test))


def _sweep(data: TrainingData, make: Callable[[float], Estimator], values: list) -> list[tuple]:
    areas = _side_by_side(data, lambda v: _areas(data, make(v).fit(data.train)), values)
    return [(v, *pair) for v, pair in zip(values, areas)]


def sweep_c(data: TrainingData, values: list[float] = C_SWEEP) -> DataFrame:
    """Train and test AUC of logistic regression for each value of C."""
    rows = _sweep(data, lambda c: PenalisedLogit(C=c), values)
    return _table(data, rows, "c double, train_auc double, test_auc double")


def sweep_trees(data: TrainingData, values: list[int] = TREES_SWEEP) -> DataFrame:
    """Train and test AUC of an entropy forest for each number of trees."""
    rows = _sweep(data, lambda n: forest(trees=n, impurity="entropy"), values)
    return _table(data, rows, "trees int, train_auc double, test_auc double")


def sweep_depth(data: TrainingData, values: list[int] = DEPTH_SWEEP, trees: int = TREES) -> DataFrame:
    """Train and test AUC of a forest for each depth.

    Spark cannot grow trees past its limit, so deeper settings have NULL areas
    and a NULL ``depth_used``.
    """
    used = sorted({v for v in values if v <= DEEPEST})
    grown = forest(trees, used[-1]).fit_depths(data.train, used) if used else {}
    pairs = _side_by_side(data, lambda d: _areas(data, grown[d]), used) if used else []
    areas = dict(zip(used, pairs))
    rows = [(v, v if v in areas else None, *areas.get(v, (None, None))) for v in values]
    return _table(data, rows, "max_depth int, depth_used int, train_auc double, test_auc double")
