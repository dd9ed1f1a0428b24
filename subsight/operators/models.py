"""Churn models on Spark ML, over a training table ``(subid, churn, fold, features)``."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Interaction, SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, Param, Params, TypeConverters
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsight.constants import (
    CATEGORICAL_FEATURES,
    LOGIT_SUMMARY_FEATURES,
    NUMERIC_FEATURES,
    SELECTED_BY_ELIMINATION,
    TOP_IMPORTANCES,
    TOP_VOTES,
    TREES,
)
from subsight.operators import prep
from subsight.operators.forest import CellForest, CellForestModel
from subsight.sources.tables import materialize

LABEL = "churn"
# Spark grows trees to this depth at most.
DEEPEST = 30
# A step of a logistic fit is a job of its own. With no more tasks than the rows need, sums of few rows
# do not meet in shuffles of their own.
ROWS_PER_TASK = 1 << 16


@dataclass(frozen=True)
class TrainingData:
    """Train and test rows with assembled features, the names of the features, and all rows."""

    train: DataFrame
    test: DataFrame
    names: list[str]
    everyone: DataFrame | None = None

    def index(self, name: str) -> int:
        return self.names.index(name)


def training_data(people: DataFrame) -> TrainingData:
    """Encode, split exactly, scale on train rows, deal folds evenly by class and assemble.

    Scaling and fits see all train rows. The merged rows are written once, as encoding and scaling look at them
    first. So are the assembled ones, which all fits read: a lost executor
    costs a re-read and not a re-join.
    """
    rows = materialize(people.select("subid", LABEL, *NUMERIC_FEATURES, *CATEGORICAL_FEATURES))
    encoded, dummies = prep.one_hot(rows)
    held_out = prep.is_within(prep.split_bound(rows))
    train = encoded.where(~held_out)
    names = NUMERIC_FEATURES + dummies
    # The assembler reads dots in a name as nested fields.
    plain = [f"f{i}" for i in range(len(names))]
    scaled = prep.minmax(encoded, train).select(
        "subid",
        F.col(LABEL).cast("double").alias(LABEL),
        held_out.alias("is_test"),
        *[F.col(f"`{name}`").cast("double").alias(p) for name, p in zip(names, plain)],
    )
    folded = prep.stratified_folds(scaled, LABEL, within=("is_test",))
    table = materialize(
        prep.assemble(folded, plain).select("subid", LABEL, "fold", "is_test", "features")
    )
    return TrainingData(
        train=table.where(~F.col("is_test")).drop("is_test"),
        test=table.where("is_test").drop("is_test"),
        names=names,
        everyone=table.drop("is_test"),
    )


class PenalisedLogit(
    Estimator, HasFeaturesCol, HasLabelCol, HasMaxIter, DefaultParamsReadable, DefaultParamsWritable
):
    """Logistic regression with an L2 penalty of strength 1 / C on all weights.

    Minimises ``w.w / 2 + C * sum(loss)``, the intercept being one of the
    weights. Two things differ from what Spark fits by itself:

    - ``C`` weighs the sum over rows and Spark the mean, so its penalty
      depends on how many rows are fitted;
    - Spark ignores a feature that never varies, such as the constant an
      intercept weight needs. The loss of a row stays the same if its label
      and the signs of its features are all turned round, so half the rows
      are, and the constant varies.
    """

    C = Param(Params._dummy(), "C", "inverse strength of the penalty", TypeConverters.toFloat)
    keyCol = Param(Params._dummy(), "keyCol", "decides which rows are turned", TypeConverters.toString)
    rows = Param(Params._dummy(), "rows", "number of rows to fit if known, else 0", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, C=1.0, maxIter=100, featuresCol="features", labelCol=LABEL, keyCol="subid", rows=0):
        super().__init__()
        self._setDefault(C=1.0, maxIter=100, featuresCol="features", labelCol=LABEL, keyCol="subid", rows=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        label = F.col(self.getLabelCol())
        turned = F.pmod(F.xxhash64(self.getOrDefault(self.keyCol)), F.lit(2)) == 0
        constant = SQLTransformer(statement="SELECT *, 1e0 AS _constant FROM __THIS__")
        join = VectorAssembler(inputCols=[self.getFeaturesCol(), "_constant"], outputCol="_weighted")
        joined = join.transform(constant.transform(dataset)).select(
            "_weighted",
            F.when(turned, -1e0).otherwise(1e0).alias("_sign"),
            F.when(turned, 1 - label).otherwise(label).alias("_label"),
        )
        rows = Interaction(inputCols=["_sign", "_weighted"], outputCol="_signed").transform(joined)
        n = self.getOrDefault(self.rows) or dataset.count()
        fitted = LogisticRegression(
            featuresCol="_signed",
            labelCol="_label",
            maxIter=self.getMaxIter(),
            regParam=1 / (self.getOrDefault(self.C) * n),
            elasticNetParam=0.0,
            standardization=False,
            fitIntercept=False,
        ).fit(rows.coalesce(max(1, -(-n // ROWS_PER_TASK))))
        return PipelineModel(stages=[constant, join, fitted.setFeaturesCol("_weighted")])


def weights(model: PipelineModel) -> list[float]:
    """Feature weights of a fitted ``PenalisedLogit``; the intercept is the last."""
    return [float(w) for w in model.stages[-1].coefficients.toArray()]


def iterations_of(model: PipelineModel) -> int:
    """Iterations a fitted ``PenalisedLogit`` took."""
    return model.stages[-1].summary.totalIterations


def score(df: DataFrame, model: Transformer) -> DataFrame:
    """Keyed churn probabilities ``(subid, churn, prob, prediction)``.

    A model that saw no churn has no second class; its probability is 0.
    """
    return model.transform(df).select(
        "subid",
        F.col(LABEL).cast("int").alias(LABEL),
        F.coalesce(F.try_element_at(vector_to_array("probability"), F.lit(2)), F.lit(0e0)).alias("prob"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def rfe(data: TrainingData, keep: int = SELECTED_BY_ELIMINATION, C: float = 1.0) -> DataFrame:
    """Drop the feature with the smallest squared weight, refit, until ``keep`` are left.

    Rank 1 is kept; the last one dropped has rank 2. The driver holds feature
    numbers and weights only.
    """
    left = list(range(len(data.names)))
    rank = dict.fromkeys(left, 1)
    train = data.train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = train.count()
        while len(left) > keep:
            subset = VectorSlicer(inputCol="features", outputCol="_kept", indices=left).transform(train)
            fitted = weights(PenalisedLogit(C=C, featuresCol="_kept", rows=n).fit(subset))
            weakest = min(range(len(left)), key=lambda i: fitted[i] ** 2)
            rank[left[weakest]] = len(left) - keep + 1
            del left[weakest]
    finally:
        train.unpersist()
    rows = [(data.names[i], r, r == 1) for i, r in rank.items()]
    return data.train.sparkSession.createDataFrame(rows, "feature string, ranking int, selected boolean")


def fit_forest(
    train: DataFrame,
    trees: int = TREES,
    depth: int = DEEPEST,
    impurity: str = "gini",
    features_per_split: str = "sqrt",
    seed: int = 0,
) -> CellForestModel:
    """Random forest; trees grow until their leaves are pure or Spark's depth limit ends them."""
    return forest(trees, depth, impurity, features_per_split, seed).fit(train)


def forest(
    trees: int = TREES,
    depth: int = DEEPEST,
    impurity: str = "gini",
    features_per_split: str = "sqrt",
    seed: int = 0,
) -> CellForest:
    """The unfitted forest. Depths past Spark's limit are refused."""
    if depth > DEEPEST:
        raise ValueError(f"depth {depth}: Spark grows trees to depth {DEEPEST} at most")
    return CellForest(
        labelCol=LABEL,
        featuresCol="features",
        numTrees=trees,
        maxDepth=depth,
        impurity=impurity,
        featureSubsetStrategy=features_per_split,
        seed=seed,
    )


def grown_depth(model: CellForestModel) -> int:
    """Depth of the deepest tree."""
    return max(model.depths)


def importances(model: CellForestModel, data: TrainingData) -> DataFrame:
    """Importance of each feature."""
    values = model.featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(data.names, values)]
    return data.train.sparkSession.createDataFrame(rows, "feature string, importance double")


def top_features(importance: DataFrame, k: int = TOP_IMPORTANCES) -> DataFrame:
    """The ``k`` most important features."""
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def vote_features(ranking: DataFrame, importance: DataFrame, k: int = TOP_VOTES) -> DataFrame:
    """The ``k`` features with the highest sum of being kept (0/1) and importance."""
    votes = F.col("selected").cast("int") + F.col("importance")
    return (
        ranking.join(importance, "feature")
        .select("feature", votes.alias("votes"))
        .orderBy(F.desc("votes"), "feature")
        .limit(k)
    )


def _left_out(data: TrainingData, names: list[str]) -> dict[str, str]:
    """Why a named feature cannot be fitted: ``absent``, or ``constant`` in the train rows."""
    variances = data.train.select(Summarizer.variance(F.col("features"))).first()[0]
    absent = {n: "absent" for n in names if n not in data.names}
    return absent | {n: "constant" for n in names if n in data.names and not variances[data.index(n)] > 0}


def _plain_logit(data: TrainingData, names: list[str]):
    subset = VectorSlicer(
        inputCol="features", outputCol="_kept", indices=[data.index(n) for n in names]
    ).transform(data.train)
    return GeneralizedLinearRegression(
        family="binomial",
        link="logit",
        featuresCol="_kept",
        labelCol=LABEL,
        fitIntercept=False,
        maxIter=50,
    ).fit(subset)


def logit_summary(data: TrainingData, names: list[str] = LOGIT_SUMMARY_FEATURES) -> DataFrame:
    """Unpenalised logit without intercept: weight, standard error, z, p and 95 % bounds.

    One row per named feature. One that cannot be fitted has NULL statistics and
    a ``reason``.
    """
    reasons = _left_out(data, names)
    used = [n for n in names if n not in reasons]
    model = _plain_logit(data, used)
    summary = model.summary
    margin = NormalDist().inv_cdf(0.975)
    fitted = {
        n: tuple(float(v) for v in (w, e, z, p, w - margin * e, w + margin * e))
        for n, w, e, z, p in zip(
            used,
            model.coefficients.toArray(),
            summary.coefficientStandardErrors,
            summary.tValues,
            summary.pValues,
        )
    }
    rows = [(n, *fitted.get(n, (None,) * 6), reasons.get(n)) for n in names]
    return data.train.sparkSession.createDataFrame(
        rows,
        "feature string, coef double, std_err double, z double, p_value double, low double, high double,"
        " reason string",
    )


def _chi2_upper(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution for whole degrees of freedom."""
    y = x / 2
    a, tail = (0.5, math.erfc(math.sqrt(y))) if dof % 2 else (1.0, math.exp(-y))
    while a < dof / 2:
        tail += math.exp(a * math.log(y) - y - math.lgamma(a + 1)) if y > 0 else 0.0
        a += 1
    return tail


def logit_fit(data: TrainingData, names: list[str] = LOGIT_SUMMARY_FEATURES) -> DataFrame:
    """How well the plain logit fits: log-likelihoods, pseudo R2, AIC, BIC, ratio test.

    The null model has a constant only, so its log-likelihood comes from the
    share of churn. ``n_features`` counts the named features and ``n_fitted`` those
    with a weight, which AIC, BIC and the test go by.
    """
    reasons = _left_out(data, names)
    used = [n for n in names if n not in reasons]
    model = _plain_logit(data, used)
    n, share = data.train.agg(F.count("*"), F.avg(LABEL)).first()
    fitted = -model.summary.deviance / 2
    null = n * sum(s * math.log(s) for s in (share, 1 - share) if s > 0)
    k = len(used)
    row = (
        int(n),
        len(names),
        k,
        float(fitted),
        float(null),
        1 - fitted / null if null else None,
        float(2 * k - 2 * fitted),
        float(k * math.log(n) - 2 * fitted),
        _chi2_upper(max(0.0, 2 * (fitted - null)), max(1, k - 1)),
    )
    return data.train.sparkSession.createDataFrame(
        [row],
        "n_rows long, n_features int, n_fitted int, log_likelihood double, null_log_likelihood double,"
        " pseudo_r2 double, aic double, bic double, ratio_test_p double",
    )
