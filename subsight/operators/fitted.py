"""The churn model as one Spark ML pipeline: index, encode sparsely, scale, assemble, fit; to be saved and loaded."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.param.shared import HasInputCols, HasOutputCols, Param, Params, TypeConverters
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subsight.constants import C_VALIDATION, CATEGORICAL_FEATURES, FOLDS, NUMERIC_FEATURES
from subsight.operators import prep
from subsight.operators.models import LABEL, PenalisedLogit

#: An indexer holds a column's categories on the driver; a column with more is refused.
MAX_CATEGORIES = 1_000_000
FITS_AT_ONCE = 8


class RangeScaler(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Min-max scaling of number columns by the rows it is fitted on; a constant column gives 0."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> RangeScalerModel:
        names = self.getInputCols()
        ends = prep.scaling_ranges(dataset, names).first()
        model = RangeScalerModel(inputCols=names, outputCols=self.getOutputCols())
        # A column without a value has no range; its rows stay NULL whatever stands here.
        lows = [float(ends[f"{c}_min"] or 0) for c in names]
        highs = [float(ends[f"{c}_max"] or 0) for c in names]
        return model._set(lows=lows, highs=highs)


class RangeScalerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted ``RangeScaler``; values beyond the fitted range are not clipped."""

    lows = Param(Params._dummy(), "lows", "smallest value of each column", TypeConverters.toListFloat)
    highs = Param(Params._dummy(), "highs", "largest value of each column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ends = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault("lows"), self.getOrDefault("highs"))
        return dataset.withColumns(
            {out: prep.scaled(F.col(c).cast("double"), F.lit(low), F.lit(high)) for c, out, low, high in ends}
        )


def _texts(df: DataFrame, cols: list[str]) -> list[str]:
    return [c for c in cols if not isinstance(df.schema[c].dataType, T.BooleanType)]


def encoder(texts: list[str]) -> Pipeline:
    """Index and one-hot encode text columns as sparse vectors ``<col>_hot``.

    Categories are numbered in the order of their texts; none is left out. NULL and a
    category that the fit did not see are all zeros. No column is made per category.
    """
    index = StringIndexer(
        inputCols=texts,
        outputCols=[f"{c}_index" for c in texts],
        handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )
    # The last number stands for NULL and unseen categories, and the last one is dropped.
    hot = OneHotEncoder(
        inputCols=index.getOutputCols(), outputCols=[f"{c}_hot" for c in texts], dropLast=True, handleInvalid="error"
    )
    return Pipeline(stages=[index, hot])


def check_categories(df: DataFrame, texts: list[str], most: int = MAX_CATEGORIES) -> None:
    """Refuse columns with far more categories than the driver should hold."""
    counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in texts]).first()
    wide = [c for c in texts if counts[c] > most]
    if wide:
        raise ValueError(f"more than {most} categories in {', '.join(wide)}")


def sparse_one_hot(df: DataFrame, cols: list[str] = CATEGORICAL_FEATURES) -> tuple[DataFrame, PipelineModel]:
    """Add a sparse vector ``<col>_hot`` for each text column; with the fitted encoder for other rows."""
    texts = _texts(df, cols)
    check_categories(df, texts)
    model = encoder(texts).fit(df)
    return model.transform(df).drop(*[f"{c}_index" for c in texts]), model


def hot_cells(encoded: DataFrame, model: PipelineModel, key: str = "subid") -> DataFrame:
    """The cells of sparse one-hot vectors that are not zero: ``key, feature, value``."""
    index = model.stages[0]
    names = [c.removesuffix("_index") for c in index.getOutputCols()]
    rows = [(n, i, f"{n}_{label}") for n, labels in zip(names, index.labelsArray) for i, label in enumerate(labels)]
    known = encoded.sparkSession.createDataFrame(rows, "_name string, _at int, feature string")
    each = [F.struct(F.lit(n).alias("name"), F.unwrap_udt(f"{n}_hot").alias("v")) for n in names]
    cells = encoded.select(key, F.explode(F.array(*each)).alias("cell")).select(
        key, F.col("cell.name").alias("_name"), F.explode(F.arrays_zip("cell.v.indices", "cell.v.values")).alias("at")
    )
    found = cells.select(key, "_name", F.col("at.indices").alias("_at"), F.col("at.values").cast("int").alias("value"))
    # No more labels than the encoder holds.
    return found.join(F.broadcast(known), ["_name", "_at"]).select(key, "feature", "value")


def churn_pipeline(df: DataFrame, C: float = 1.0, maxIter: int = 100) -> Pipeline:
    """Everything from raw features to the logistic model; fitted on some rows, it learns from those alone."""
    texts = _texts(df, CATEGORICAL_FEATURES)
    flags = [c for c in CATEGORICAL_FEATURES if c not in texts]
    flagged = ", ".join(f"coalesce(cast({c} AS double), 0e0) AS {c}_flag" for c in flags)
    scaled = [f"{c}_scaled" for c in NUMERIC_FEATURES]
    stages = [
        *encoder(texts).getStages(),
        SQLTransformer(statement=f"SELECT *{', ' + flagged if flags else ''} FROM __THIS__"),
        RangeScaler(inputCols=NUMERIC_FEATURES, outputCols=scaled),
        VectorAssembler(inputCols=[*scaled, *[f"{c}_flag" for c in flags], *[f"{c}_hot" for c in texts]], outputCol="features"),
        PenalisedLogit(C=C, maxIter=maxIter),
    ]
    return Pipeline(stages=stages)


def cross_validate(
    train: DataFrame, cs: list[float] = C_VALIDATION, folds: int = FOLDS, at_once: int = FITS_AT_ONCE
) -> CrossValidatorModel:
    """Accuracy of each ``C`` over the folds in ``fold``; every fold indexes, scales and fits on its own rows.

    So held-out rows say nothing to the scaling or to the categories of their fold.
    """
    check_categories(train, _texts(train, CATEGORICAL_FEATURES))
    rows = train.withColumn(LABEL, F.col(LABEL).cast("double"))
    pipeline = churn_pipeline(rows)
    grid = ParamGridBuilder().addGrid(pipeline.getStages()[-1].C, cs).build()
    judge = MulticlassClassificationEvaluator(labelCol=LABEL, metricName="accuracy")
    return CrossValidator(
        estimator=pipeline, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, foldCol="fold", parallelism=at_once
    ).fit(rows)


def split_and_fold(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train rows with their ``fold`` and test rows, raw features and all; ``people`` is read more than once."""
    train, test = prep.exact_split(people)
    return prep.stratified_folds(train, LABEL), test
