"""The fitted pipeline: sparse encoding, folds that learn from their own rows, saving and loading."""

import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from subsight.constants import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from subsight.operators import fitted, models


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        numbers = [rng.random() * 10 for _ in NUMERIC_FEATURES]
        use, os = rng.choice(["a", "b.c", "d"]), rng.choice(["x", None])
        churn = int(numbers[0] + 4 * (use == "a") + rng.gauss(0, 1) > 7)
        rows.append((i, churn, *numbers, use, rng.random() < 0.5, rng.choice(["m", "n"]), os, "p"))
    kinds = {"intended_use": "string", "male_TF": "boolean", "attribution_technical": "string", "op_sys": "string", "plan_type": "string"}
    schema = "subid long, churn int, " + ", ".join(f"{c} double" for c in NUMERIC_FEATURES)
    schema += ", " + ", ".join(f"{c} {kinds[c]}" for c in CATEGORICAL_FEATURES)
    path = str(tmp_path_factory.mktemp("people") / "rows")
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.parquet(path)


def test_unseen_and_missing_categories_are_all_zero(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "a")], "subid long, plan string")
    encoded, model = fitted.sparse_one_hot(df, ["plan"])
    vectors = {r.subid: r.plan_hot.toArray().tolist() for r in encoded.collect()}
    assert vectors == {1: [0, 1], 2: [1, 0], 3: [0, 0], 4: [1, 0]}
    other = model.transform(spark.createDataFrame([(9, "new")], "subid long, plan string"))
    assert other.first().plan_hot.toArray().tolist() == [0, 0]
    assert fitted.hot_cells(other, model).count() == 0
    cells = fitted.hot_cells(encoded, model).collect()
    assert sorted(map(tuple, cells)) == [(1, "plan_b", 1), (2, "plan_a", 1), (4, "plan_a", 1)]


def test_a_hundred_thousand_categories(spark):
    df = spark.range(150_000).select(F.col("id").alias("subid"), F.concat(F.lit("c"), F.col("id") % 100_000).alias("plan"))
    encoded, model = fitted.sparse_one_hot(df, ["plan"])
    assert encoded.columns == ["subid", "plan", "plan_hot"]
    cells = fitted.hot_cells(encoded, model)
    wrong = cells.where((F.col("feature") != F.concat(F.lit("plan_c"), F.col("subid") % 100_000)) | (F.col("value") != 1))
    assert cells.count() == 150_000 and wrong.count() == 0
    with pytest.raises(ValueError, match="categories"):
        fitted.check_categories(df, ["plan"], most=1000)


def test_scores_are_the_same_after_loading(people, tmp_path):
    train, test = fitted.split_and_fold(people)
    train = train.withColumn("churn", F.col("churn").cast("double"))
    model = fitted.churn_pipeline(train).fit(train)
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    before, after = (sorted(map(tuple, models.score(test, m).collect())) for m in (model, loaded))
    assert before == after and len(before) == 160
    assert sum(r[1] == r[3] for r in before) / len(before) > 0.8


def test_a_fold_learns_nothing_from_its_held_out_rows(people):
    train, _ = fitted.split_and_fold(people)
    first = NUMERIC_FEATURES[0]
    # In the held-out rows of fold 0 the numbers are enormous and the categories new.
    odd = train.withColumn(first, F.when(F.col("fold") == 0, F.col(first) * 1e6).otherwise(F.col(first))).withColumn(
        "intended_use", F.when(F.col("fold") == 0, F.lit("zz")).otherwise(F.col("intended_use"))
    )
    rows = odd.withColumn("churn", F.col("churn").cast("double"))
    stages = fitted.churn_pipeline(rows).fit(rows.where("fold <> 0")).stages
    assert max(stages[3].getOrDefault("highs")) <= 10 and "zz" not in stages[0].labelsArray[0]
    plain = train.withColumn("churn", F.col("churn").cast("double"))
    own = fitted.churn_pipeline(plain).fit(plain.where("fold <> 0")).stages
    assert own[3].getOrDefault("highs") == stages[3].getOrDefault("highs")
    assert models.weights(own[-1]) == pytest.approx(models.weights(stages[-1]), abs=1e-9)


def test_accuracy_for_each_setting(people):
    train, _ = fitted.split_and_fold(people)
    found = fitted.cross_validate(train, [0.001, 1.0], folds=5)
    assert len(found.avgMetrics) == 2 and found.avgMetrics[1] > 0.8 >= 0.5 < found.avgMetrics[0] + 0.3
    assert isinstance(found.bestModel, PipelineModel)
