"""Evaluation of a scored table ``(label, prediction, probability)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsight.functions.ordered import range_cuts, running_totals, with_next


def _cells(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row with the four cells of the confusion matrix; one pass, no shuffle of rows."""
    actual, said = F.col(label), F.col(prediction)
    return df.agg(
        F.count_if((actual == 0) & (said == 0)).alias("tn"),
        F.count_if((actual == 0) & (said == 1)).alias("fp"),
        F.count_if((actual == 1) & (said == 0)).alias("fn"),
        F.count_if((actual == 1) & (said == 1)).alias("tp"),
    )


def _or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0e0))


def confusion(df: DataFrame, label: str = "churn", prediction: str = "prediction") -> DataFrame:
    """Confusion matrix as four rows, empty cells included."""
    return _cells(df, label, prediction).selectExpr(
        "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) as (label, predicted, n)"
    )


def binary_metrics(df: DataFrame, label: str = "churn", prediction: str = "prediction") -> DataFrame:
    """Accuracy, recall, precision and F1 of class 1; a ratio without a base is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return _cells(df, label, prediction).select(
        _or_zero(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _or_zero(tp, tp + fn).alias("recall"),
        _or_zero(tp, tp + fp).alias("precision"),
        _or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def class_report(df: DataFrame, label: str = "churn", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted rows."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def one_class(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("row_label"),
            _or_zero(hit, hit + wrong).alias("precision"),
            _or_zero(hit, hit + missed).alias("recall"),
            _or_zero(2 * hit, 2 * hit + wrong + missed).alias("f1"),
            (hit + missed).alias("support"),
        )

    classes = _cells(df, label, prediction).select(
        "*", one_class("0", tn, fn, fp).alias("c0"), one_class("1", tp, fp, fn).alias("c1")
    )
    c0, c1 = F.col("c0"), F.col("c1")
    total = c0["support"] + c1["support"]
    accuracy = _or_zero(tp + tn, total)

    def combined(name: str, value) -> Column:
        return F.struct(
            F.lit(name).alias("row_label"),
            *[value(m).alias(m) for m in ("precision", "recall", "f1")],
            total.alias("support"),
        )

    rows = F.array(
        c0,
        c1,
        combined("accuracy", lambda m: accuracy),
        combined("macro avg", lambda m: (c0[m] + c1[m]) / 2),
        combined(
            "weighted avg", lambda m: _or_zero(c0[m] * c0["support"] + c1[m] * c1["support"], total)
        ),
    )
    return classes.select(F.explode(rows).alias("row")).select("row.*")


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score, before anything is ordered."""
    return (
        df.where(F.col(score).isNotNull())
        .groupBy(F.col(score).alias("threshold"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )


def roc(df: DataFrame, label: str = "churn", score: str = "prob", drop_intermediate: bool = False) -> DataFrame:
    """ROC points, one per distinct score, plus the start (NULL threshold, 0, 0).

    With ``drop_intermediate`` a point goes if the step to it and the step from it
    are the same, so that it lies on the line between its neighbours; the first and the
    last point stay.
    """
    grouped = _by_score(df, label, score)
    totals = grouped.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    cuts = range_cuts(df, score)
    points = running_totals(grouped, "threshold", {"tp": "pos", "fp": "neg"}, cuts, descending=True)
    if drop_intermediate:
        beside = with_next(points, "threshold", {"_pos": "pos", "_neg": "neg"}, cuts, descending=True)
        same = (F.col("pos") == F.col("_pos")) & (F.col("neg") == F.col("_neg"))
        # The first point is the only one whose running totals are its own counts.
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        points = beside.where(first | ~F.coalesce(same, F.lit(False)))
    points = points.withColumn("_all", totals).select(
        "threshold",
        F.try_divide("fp", F.col("_all")["n"]).alias("fpr"),
        F.try_divide("tp", F.col("_all")["p"]).alias("tpr"),
    )
    start = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0e0).alias("fpr"), F.lit(0e0).alias("tpr")
    )
    return points.unionByName(start)


def auc(df: DataFrame, label: str = "churn", score: str = "prob") -> DataFrame:
    """Area under the ROC curve by trapezoids; equal scores count half. NULL with one class only."""
    steps = running_totals(
        _by_score(df, label, score),
        "threshold",
        {"tp": "pos", "fp": "neg"},
        range_cuts(df, score),
        descending=True,
    )
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    # The last running totals are the class sizes. Taken from there, all parts
    # of the plan need both counts and share one grouping of the scores.
    return steps.agg(F.try_divide(area, F.max("tp").cast("double") * F.max("fp")).alias("auc"))
