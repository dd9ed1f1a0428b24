import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from subsight.constants import CATEGORICAL_FEATURES, NUMERIC_FEATURES, TEST_SHARE
from subsight.operators import models, tuning
from subsight.operators.models import TrainingData


@pytest.fixture(scope="module")
def data(spark):
    """Four features; churn depends on the first two."""
    rng = random.Random(8)
    rows = []
    for i in range(240):
        x = [rng.random() for _ in range(4)]
        chance = 1 / (1 + math.exp(-(5 * x[0] - 4 * x[1] - 0.3)))
        rows.append((i, float(rng.random() < chance), i % 5, x))
    df = spark.createDataFrame(rows, "subid long, churn double, fold int, f array<double>")
    df = df.select("subid", "churn", "fold", array_to_vector("f").alias("features")).cache()
    return TrainingData(df.where("subid < 160"), df.where("subid >= 160"), ["a", "b", "c", "d"])


def test_fits_see_every_train_row(spark):
    """More train rows than a fit once took: none is left out."""
    n = 1_800_000
    numbers = [F.lit(0e0).alias(c) for c in NUMERIC_FEATURES]
    people = spark.range(n).select(F.col("id").alias("subid"), (F.col("id") % 2).alias("churn"), *numbers, *[F.lit("a").alias(c) for c in CATEGORICAL_FEATURES])
    found = models.training_data(people)
    held_out = math.ceil(TEST_SHARE * n)
    assert (found.train.count(), found.test.count(), found.everyone.count()) == (n - held_out, held_out, n)


def matrix(df):
    rows = df.orderBy("subid").collect()
    return np.array([r.features.toArray() for r in rows]), np.array([r.churn for r in rows])


def test_logit_is_at_the_minimum_of_the_penalised_loss(data):
    x, y = matrix(data.train)
    x = np.hstack([x, np.ones((len(x), 1))])
    for c in (0.5, 2.0):
        w = np.array(models.weights(models.PenalisedLogit(C=c).fit(data.train)))
        slope = w + c * x.T @ (1 / (1 + np.exp(-x @ w)) - y)
        assert np.abs(slope).max() < 1e-2


def test_scores_are_keyed_probabilities(data):
    rows = models.score(data.test, models.PenalisedLogit().fit(data.train)).collect()
    assert {r.subid for r in rows} == set(range(160, 240))
    assert all(0 <= r.prob <= 1 and r.prediction == (r.prob > 0.5) for r in rows)


def test_elimination_keeps_what_matters(data):
    ranks = {r.feature: r.ranking for r in models.rfe(data, keep=2).collect()}
    assert ranks["a"] == ranks["b"] == 1 and sorted(ranks.values()) == [1, 1, 2, 3]


def test_plain_logit_matches_newton(data):
    x, y = matrix(data.train)
    w = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x
        w += np.linalg.solve(h, x.T @ (y - p))
    rows = models.logit_summary(data, ["a", "b", "c", "d", "missing"]).collect()
    assert [r.feature for r in rows] == ["a", "b", "c", "d", "missing"]
    missing = rows.pop()
    assert missing.reason == "absent" and missing.coef is None
    assert [r.coef for r in rows] == pytest.approx(list(w), abs=1e-4)
    assert [r.std_err for r in rows] == pytest.approx(list(np.sqrt(np.diag(np.linalg.inv(h)))), rel=1e-3)
    p = 1 / (1 + np.exp(-x @ w))
    fit = models.logit_fit(data, ["a", "b", "c", "d"]).first()
    assert fit.log_likelihood == pytest.approx(float(np.sum(np.log(np.where(y == 1, p, 1 - p)))), abs=1e-4)
    m = y.mean()
    assert fit.null_log_likelihood == pytest.approx(len(y) * (m * math.log(m) + (1 - m) * math.log(1 - m)))
    assert fit.aic == pytest.approx(8 - 2 * fit.log_likelihood)


@pytest.mark.parametrize("x, dof, tail", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (16.918978, 9, 0.05)])
def test_chi_square_tail(x, dof, tail):
    assert models._chi2_upper(x, dof) == pytest.approx(tail, abs=1e-6)


def test_forest_importances_votes_and_repeatability(data):
    first, second = (models.fit_forest(data.train, trees=15) for _ in range(2))
    importance = models.importances(first, data)
    assert sum(r.importance for r in importance.collect()) == pytest.approx(1)
    assert first.featureImportances == second.featureImportances
    assert {r.feature for r in models.top_features(importance, 2).collect()} == {"a", "b"}
    votes = models.vote_features(models.rfe(data, keep=2), importance, 2).collect()
    assert {r.feature for r in votes} == {"a", "b"} and all(r.votes > 1 for r in votes)


def test_search_equals_fitting_every_setting(data):
    found = tuning.search_logistic(data, cs=[0.1], iterations=[2, 100, 140])
    assert len(found.scores) == 3 and all(len(s) == 5 for s in found.scores)
    for setting, scores in zip(found.settings, found.scores):
        for fold in range(5):
            model = models.PenalisedLogit(**setting).fit(data.train.where(F.col("fold") != fold))
            held_out = models.score(data.train.where(F.col("fold") == fold), model)
            accuracy = held_out.agg(F.avg((F.col("churn") == F.col("prediction")).cast("int"))).first()[0]
            assert accuracy == pytest.approx(scores[fold])
    rows = tuning.search_results(data, found).collect()
    assert sum(r.is_best for r in rows) == 1
    assert max(r.mean_accuracy for r in rows) == next(r.mean_accuracy for r in rows if r.is_best)


def test_forest_search_fits_every_depth(data):
    found = tuning.search_forest(data, depths=[3, 29, 30], features=[2], trees=5)
    assert found.scores[1] == found.scores[2]
    assert models.grown_depth(found.model) <= 29


def test_sweeps(data):
    c = tuning.sweep_c(data, [0.1, 1.0]).collect()
    assert [r.c for r in c] == [0.1, 1.0] and all(0.5 < r.train_auc <= 1 for r in c)
    depth = {r.max_depth: r for r in tuning.sweep_depth(data, [2, 30, 70], trees=5).collect()}
    assert depth[30].depth_used == 30 and depth[30].train_auc > 0.5
    assert depth[70].depth_used is None and depth[70].train_auc is None
    with pytest.raises(ValueError, match="depth 50"):
        models.forest(depth=50)
    trees = tuning.sweep_trees(data, [3, 6]).collect()
    assert [r.trees for r in trees] == [3, 6]
    curve = tuning.validation_curve(data, [0.001, 1.001]).collect()
    assert curve[0].mean_accuracy <= curve[1].mean_accuracy


def test_settings_share_a_fit_that_no_limit_ends(data, monkeypatch):
    fits = []
    plain = models.PenalisedLogit._fit

    def counted(self, rows):
        fits.append((self.getOrDefault("C"), self.getMaxIter()))
        return plain(self, rows)

    monkeypatch.setattr(models.PenalisedLogit, "_fit", counted)
    found = tuning.search_logistic(data, cs=[0.1, 1.0], iterations=[2, 100, 140])
    # For each C and fold: the limit of 140 serves 100, the limit of 2 does not; then the best one.
    assert len(fits) == 2 * 5 * 2 + 1 and sum(m == 100 for _, m in fits[:-1]) == 0
    assert found.scores[1] == found.scores[2] and found.scores[4] == found.scores[5]


def test_a_small_logistic_fit_needs_one_task(data, monkeypatch):
    parts = []
    plain = models.LogisticRegression._fit

    def counted(self, rows):
        parts.append(rows.rdd.getNumPartitions())
        return plain(self, rows)

    monkeypatch.setattr(models.LogisticRegression, "_fit", counted)
    spread = data.train.repartition(7)
    models.PenalisedLogit().fit(spread)
    monkeypatch.setattr(models, "ROWS_PER_TASK", 50)
    models.PenalisedLogit().fit(spread)
    assert parts == [1, 4]


def test_accuracies_of_both_parts(spark):
    scored = spark.createDataFrame([(0, 1.0, 1.0), (0, 0.0, 1.0), (1, 0.0, 0.0), (2, 1.0, 0.0)], "fold int, churn double, prediction double")
    assert tuning._accuracies(scored, 0) == (0.5, 0.5) and tuning._accuracies(scored, 1) == (pytest.approx(1 / 3), 1.0)
