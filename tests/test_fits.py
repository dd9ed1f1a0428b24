"""The fit queries end to end on the fixture tables: rows, keys and ranges."""

import math

import pytest

from subsight.plans.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def rows_of(spark, name):
    return QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", ["logistic_scores", "forest_scores", "saved_pipeline_scores"])
def test_scores(spark, name):
    rows = rows_of(spark, name)
    n = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert 0 < len(rows) < n and len({r.subid for r in rows}) == len(rows)
    for r in rows:
        assert 0 <= r.prob <= 1 and r.prediction == int(r.prob > 0.5) and r.churn in (0, 1)


def test_elimination_and_importance(spark):
    ranking = rows_of(spark, "rfe_ranking")
    kept = [r.feature for r in ranking if r.selected]
    assert len(kept) == 10 and all(r.selected == (r.ranking == 1) for r in ranking)
    assert sorted(r.ranking for r in ranking if not r.selected) == list(range(2, len(ranking) - 8))
    top = rows_of(spark, "top_features")
    assert [r.importance for r in top] == sorted((r.importance for r in top), reverse=True)
    assert {r.feature for r in top} <= {r.feature for r in ranking} and sum(r.importance for r in top) <= 1 + 1e-6


def test_plain_logit(spark):
    rows = rows_of(spark, "logit_summary")
    fitted = [r for r in rows if r.reason is None]
    assert fitted and all(r.low < r.coef < r.high and 0 <= r.p_value <= 1 for r in fitted)
    assert all(r.coef is None for r in rows if r.reason is not None)
    (fit,) = rows_of(spark, "logit_fit")
    assert fit.n_features == len(rows) and fit.n_fitted == len(fitted)
    assert math.isclose(fit.aic, 2 * fit.n_fitted - 2 * fit.log_likelihood, abs_tol=1e-4) and fit.log_likelihood < 0


def test_report_of_the_best_forest(spark):
    rows = rows_of(spark, "final_forest_report")
    assert {(r.rows, r.row_label) for r in rows} == {
        (part, label) for part in ("train", "test") for label in ("0", "1", "accuracy", "macro avg", "weighted avg")
    }
    assert all(0 <= v <= 1 for r in rows for v in (r.precision, r.recall, r.f1))
