"""Every analysis as a named query over a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subsight import constants as C
from subsight.functions import intervals, sketches, tiers
from subsight.operators import (
    abtest,
    acquisition,
    clv,
    cohort,
    counts,
    distribution,
    fitted,
    metrics,
    models,
    prep,
    tuning,
)
from subsight.operators import engagement as eng
from subsight.plans import churn_value
from subsight.plans.acquisition_cost import AcquisitionCost, acquisition_cost
from subsight.sources import tables
from subsight.sources.star import StarInputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def comparable(df: DataFrame, places: int = 6) -> DataFrame:
    """Round doubles and write dates as text at the very end, to compare with other engines."""
    changed = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.DoubleType):
            changed[field.name] = F.round(field.name, places)
        elif isinstance(field.dataType, T.DateType):
            changed[field.name] = F.date_format(field.name, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.TimestampType):
            changed[field.name] = F.date_format(field.name, "yyyy-MM-dd HH:mm:ss")
    return df.withColumns(changed)


def query(build: Callable[[StarInputs], DataFrame]) -> Query:
    """Register a function of the inputs as a query under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(build(StarInputs(spark, sf_dir)))

    QUERIES[build.__name__] = run
    return run


def _cost(t: StarInputs) -> AcquisitionCost:
    return acquisition_cost(t.customer_accounts, t.subscribers, t.spend)


def _merged(t: StarInputs) -> DataFrame:
    return churn_value.merged(t.subscribers, t.engagement)


def fixed_scores(merged: DataFrame) -> DataFrame:
    """Churn probabilities of the held-out rows from a formula, in place of a model."""
    points = (F.col("subid") * 37) % 60 + F.when(F.col("cancel_before_trial_end"), 40).otherwise(0)
    return (
        merged.where(prep.is_test_row())
        .select("subid", "churn", (points / 100).alias("prob"))
        .withColumn("prediction", (F.col("prob") > 0.5).cast("int"))
    )


def _scores(t: StarInputs) -> DataFrame:
    return fixed_scores(_merged(t))


def _all_scores(t: StarInputs) -> DataFrame:
    # The label needs no features, so the scores to join need no merge.
    return fixed_scores(eng.churn_label(t.subscribers))


def _written(df: DataFrame, *cols: str) -> DataFrame:
    """Columns that several passes will read: joined once, written, then only scanned."""
    return tables.materialize(df.select(*cols))


VALUE_COLUMNS = ["subid", "account_creation_date", "attribution_technical", "discount_price"]


def _value(t: StarInputs, people: DataFrame, *groups: str) -> DataFrame:
    # The mean price is a second pass over the people.
    kept = _written(people, *VALUE_COLUMNS, *groups)
    return churn_value.valued(kept, _cost(t).cost, _all_scores(t))


def _valued(t: StarInputs) -> DataFrame:
    return _value(t, _merged(t))


def _modelling_table(t: StarInputs) -> DataFrame:
    return churn_value.modelling_table(t.subscribers, t.engagement)


def _values_by(t: StarInputs, group: str, people: DataFrame | None = None) -> DataFrame:
    """Lifetime value beside one column to group by, written for the passes to come."""
    carried = [] if group == "tier" else [group]
    return _written(_value(t, _merged(t) if people is None else people, *carried), group, "CLV_i")


# --- scans --------------------------------------------------------------------


@query
def scan_subscribers(t: StarInputs) -> DataFrame:
    return t.subscribers


@query
def scan_ads(t: StarInputs) -> DataFrame:
    return t.spend


@query
def table_shapes(t: StarInputs) -> DataFrame:
    shapes = counts.table_profile(t.subscribers, "subscribers")
    for name, df in {"engagement": t.engagement, "customer": t.customer, "spend": t.spend}.items():
        shapes = shapes.unionByName(counts.table_profile(df, name))
    return shapes


@query
def engagement_preview(t: StarInputs) -> DataFrame:
    return counts.preview(t.engagement, ["subid", "date", "payment_period"])


@query
def cac_csv_roundtrip(t: StarInputs) -> DataFrame:
    path = tables.shared_dir(t.spark)
    tables.write_csv(acquisition.cost_wide(_cost(t).cost), path)
    return tables.read_csv(t.spark, path, tables.TABLES["acquisition_cost"])


def _from_file(t: StarInputs, df: DataFrame, name: str) -> DataFrame:
    """The table written to parquet, missing numbers as NaN, and read by the reader."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    path = tables.shared_dir(t.spark)
    with_nan = df.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in doubles})
    with_nan.write.parquet(f"{path}/{name}.parquet")
    return tables.read_table(t.spark, path, name)


def _spend_from_sheet(t: StarInputs) -> DataFrame:
    """The spend written as a sheet with a banner and a heading row, and read by the reader."""
    cells = t.spend.select("period_idx", *C.PAID_CHANNELS)
    texts = cells.select(*[F.col(c).cast("string").alias(c) for c in cells.columns])
    banner = ["Advertising spend", *[""] * len(C.PAID_CHANNELS)]
    kinds = ", ".join(f"`{c}` string" for c in cells.columns)
    top = t.spark.createDataFrame([banner, cells.columns], kinds)
    path = tables.shared_dir(t.spark)
    top.unionByName(texts).write.csv(path)
    return tables.read_spend(t.spark, path)


@query
def read_subscribers(t: StarInputs) -> DataFrame:
    return _from_file(t, t.subscribers, "subscribers")


@query
def read_spend_sheet(t: StarInputs) -> DataFrame:
    return _spend_from_sheet(t)


@query
def read_table_shapes(t: StarInputs) -> DataFrame:
    shapes = counts.table_profile(_spend_from_sheet(t), "spend")
    for name, df in {"subscribers": t.subscribers, "engagement": t.engagement, "customer": t.customer}.items():
        shapes = shapes.unionByName(counts.table_profile(_from_file(t, df, name), name))
    return shapes


# --- filters and projections -----------------------------------------------------


@query
def ab_variants(t: StarInputs) -> DataFrame:
    return abtest.variants(t.subscribers).select("subid", "join_fee", "variant")


@query
def paid_subscribers(t: StarInputs) -> DataFrame:
    return t.subscribers.where("paid_TF").select("subid", "plan_type", "discount_price")


@query
def tier_assign(t: StarInputs) -> DataFrame:
    return tiers.assign_tier(t.subscribers).select("subid", "tier")


@query
def tier_assign_range_join(t: StarInputs) -> DataFrame:
    bounds = tiers.tier_bounds(t.spark)
    return tiers.assign_tier_from_table(t.subscribers, bounds).select("subid", "tier")


@query
def band_lookup(t: StarInputs) -> DataFrame:
    """Balances by a table of as many overlapping bands as there are parts."""
    parts = t.spark.read.parquet(f"{t.directory}/part.parquet")
    low = (F.col("p_partkey") * 7919 % 12000 - 1500).cast("double")
    bands = parts.select(F.col("p_partkey").alias("band"), low.alias("lo"), (low + F.col("p_size") * 10).alias("hi"))
    balances = t.spark.read.parquet(f"{t.directory}/customer.parquet").select("c_custkey", "c_acctbal")
    return intervals.assign_interval(balances, bands, "c_acctbal").select("c_custkey", "band")


@query
def null_share_by_column(t: StarInputs) -> DataFrame:
    return counts.null_shares(eng.engaged_only(t.subscribers, t.engagement))


@query
def audit_activity_after_trial(t: StarInputs) -> DataFrame:
    return eng.activity_after_trial(_merged(t)).select("subid", "max_day", "trial_end_date")


@query
def churn_label(t: StarInputs) -> DataFrame:
    return _merged(t).select("subid", "paid_TF", "refund_after_trial_TF", "churn")


# --- A/B test --------------------------------------------------------------------


@query
def scope_counts(t: StarInputs) -> DataFrame:
    return abtest.scope_counts(t.subscribers)


@query
def approx_users_by_tier(t: StarInputs) -> DataFrame:
    """Distinct users per tier and in all (NULL tier) from sketches per tier and period, beside the exact ones."""
    alive = tiers.assign_tier(t.customer_accounts).where(F.col("tier").isNotNull()).select("tier", "subid")
    parts = alive.withColumn("part", F.pmod("subid", F.lit(8)))
    kept = tables.materialize(sketches.distinct_sketches(parts, ["tier", "part"], "subid"))
    everything = sketches.approx_distinct(kept, []).select(F.lit(None).cast("int").alias("tier"), "approx_distinct")
    found = sketches.approx_distinct(kept, ["tier"]).unionByName(everything)
    exact = alive.groupBy("tier").agg(F.count_distinct("subid").alias("users"))
    exact = exact.unionByName(alive.agg(F.count_distinct("subid").alias("users")).withColumn("tier", F.lit(None).cast("int")))
    off = F.abs(F.col("approx_distinct") - F.col("users")) / F.col("users")
    return found.join(exact, F.equal_null(found["tier"], exact["tier"])).select(
        found["tier"], "users", (off <= sketches.distinct_error()).alias("within_error")
    )


@query
def approx_revenue_percentiles(t: StarInputs) -> DataFrame:
    """Percentiles of revenue per plan from sketches per plan and system; their exact ranks must hold."""
    known = t.subscribers.where(F.col("revenue_net").isNotNull()).select("plan_type", "op_sys", "revenue_net")
    kept = tables.materialize(sketches.percentile_sketches(known, ["plan_type", "op_sys"], "revenue_net"))
    found = sketches.approx_percentiles(kept, ["plan_type"], C.PERCENTILES)
    # A row for each plan and share.
    beside = known.select("plan_type", "revenue_net").join(F.broadcast(found), "plan_type")
    value = F.col("revenue_net")
    ranked = beside.groupBy("plan_type", "share", "n", "approx_value").agg(
        F.count_if(value < F.col("approx_value")).alias("below"), F.count_if(value <= F.col("approx_value")).alias("upto")
    )
    holds = sketches.rank_holds(F.col("below"), F.col("upto"), F.col("n"), F.col("share"))
    return ranked.select("plan_type", "share", "n", holds.alias("within_error"))


@query
def join_fee_counts(t: StarInputs) -> DataFrame:
    return counts.value_counts(t.subscribers, "join_fee")


@query
def variant_profile(t: StarInputs) -> DataFrame:
    return abtest.variant_profile(t.subscribers)


@query
def ab_conversion(t: StarInputs) -> DataFrame:
    return abtest.conversion(t.subscribers)


@query
def ab_sample_size(t: StarInputs) -> DataFrame:
    return abtest.sample_size(t.subscribers)


@query
def ab_z_one_sample(t: StarInputs) -> DataFrame:
    return abtest.z_one_sample(t.subscribers)


@query
def ab_z_two_sample(t: StarInputs) -> DataFrame:
    return abtest.z_two_sample(t.subscribers)


@query
def sample_n(t: StarInputs) -> DataFrame:
    return abtest.sample_n(t.subscribers.select("subid", "paid_TF"), 1000)


@query
def ztest_trials(t: StarInputs) -> DataFrame:
    return abtest.z_trials(t.subscribers)


@query
def ztest_decisions(t: StarInputs) -> DataFrame:
    return abtest.trial_decisions(abtest.z_trials(t.subscribers))


@query
def sprt_decision(t: StarInputs) -> DataFrame:
    return abtest.sprt(t.subscribers)


@query
def sprt_trace(t: StarInputs) -> DataFrame:
    return abtest.sprt_trace(t.subscribers)


# --- acquisition cost --------------------------------------------------------------


@query
def account_date_range(t: StarInputs) -> DataFrame:
    day = F.col("account_creation_date")
    return t.subscribers.agg(F.min(day).alias("first"), F.max(day).alias("last"))


@query
def signups_by_tier(t: StarInputs) -> DataFrame:
    return acquisition.signups_by_tier(t.customer_accounts)


@query
def acquisition_by_tier_channel(t: StarInputs) -> DataFrame:
    return acquisition.acquisition(t.subscribers).select("tier", "channel", "n")


@query
def acquisition_paid(t: StarInputs) -> DataFrame:
    return acquisition.payers_only(acquisition.acquisition(t.subscribers))


@query
def acquisition_wide(t: StarInputs) -> DataFrame:
    return acquisition.acquisition_wide(acquisition.acquisition(t.subscribers))


@query
def known_share(t: StarInputs) -> DataFrame:
    return _cost(t).share


@query
def cac_scaled_spend(t: StarInputs) -> DataFrame:
    return _cost(t).spend


@query
def cac_by_tier_channel(t: StarInputs) -> DataFrame:
    return acquisition.with_means(_cost(t).cost)


@query
def cac_by_tier_channel_paid(t: StarInputs) -> DataFrame:
    return acquisition.with_means(_cost(t).cost_paid)


@query
def cac_wide(t: StarInputs) -> DataFrame:
    return acquisition.cost_wide(_cost(t).cost)


# --- cohorts --------------------------------------------------------------------


@query
def cohort_counts(t: StarInputs) -> DataFrame:
    return cohort.cohort_counts(t.customer)


@query
def cohort_counts_wide(t: StarInputs) -> DataFrame:
    """The wide table, its columns as one text: which there are depends on the data."""
    wide = cohort.cohort_counts_wide(tables.materialize(cohort.cohort_counts(t.customer)))
    return wide.select("tier", F.to_json(F.struct(*[c for c in wide.columns if c != "tier"])).alias("counts"))


@query
def cohort_retention(t: StarInputs) -> DataFrame:
    return cohort.cohort_retention(t.customer_up_to(C.LAST_COHORT_PERIOD)).drop("retention_1dp")


@query
def cohort_retention_wide(t: StarInputs) -> DataFrame:
    return cohort.cohort_retention_wide(cohort.cohort_retention(t.customer_up_to(C.LAST_COHORT_PERIOD)))


# --- engagement and validation ---------------------------------------------------------


@query
def billing_channel_counts(t: StarInputs) -> DataFrame:
    return counts.value_counts(t.customer_facts, "billing_channel")


@query
def engagement_scope(t: StarInputs) -> DataFrame:
    return eng.engagement_scope(t.engagement)


@query
def engagement_agg(t: StarInputs) -> DataFrame:
    return eng.engagement_totals(t.engagement)


@query
def engagement_features(t: StarInputs) -> DataFrame:
    return eng.engagement_features(t.engagement)


@query
def engaged_subscribers(t: StarInputs) -> DataFrame:
    return eng.engaged_only(t.subscribers, t.engagement).select("subid", "plan_type", "op_sys")


@query
def impute_by_frequency(t: StarInputs) -> DataFrame:
    return prep.impute_by_frequency(t.subscribers.select("subid", *C.IMPUTED_COLUMNS))


@query
def subscriber_features(t: StarInputs) -> DataFrame:
    # Which other columns survive the pruning depends on the data.
    return churn_value.modelling_table(t.subscribers, t.engagement).select(
        "subid",
        "account_creation_date",
        "trial_end_date",
        "paid_TF",
        "refund_after_trial_TF",
        "cancel_before_trial_end",
        "retarget_TF",
        "discount_price",
        "revenue_net",
        *C.CATEGORICAL_FEATURES,
        "active_days",
        "duration",
        "max_day",
        "min_day",
        *C.NUMERIC_FEATURES,
        "churn",
    )


@query
def validation_join(t: StarInputs) -> DataFrame:
    engaged = eng.engaged_only(t.subscribers, t.engagement)
    return eng.validation_join(t.customer_facts, engaged, spread_by="o_orderkey", hot=t.hot_subscribers)


@query
def trial_vs_cancel(t: StarInputs) -> DataFrame:
    engaged = eng.engaged_only(t.subscribers, t.engagement)
    return eng.validation_counts(t.trial_facts, engaged, "trial_completed_TF", "cancel_before_trial_end")


@query
def trial_days(t: StarInputs) -> DataFrame:
    engaged = eng.engaged_only(t.subscribers, t.engagement)
    return eng.validation_counts(t.trial_facts, engaged, "trial_completed_TF", "num_trial_days")


@query
def cancel_vs_paid(t: StarInputs) -> DataFrame:
    return counts.value_counts(_merged(t), "cancel_before_trial_end", "paid_TF")


@query
def paid_refund_counts(t: StarInputs) -> DataFrame:
    return counts.value_counts(_merged(t).where("paid_TF"), "refund_after_trial_TF")


@query
def refund_revenue_audit(t: StarInputs) -> DataFrame:
    return eng.revenue_audit(_merged(t))


@query
def churn_counts(t: StarInputs) -> DataFrame:
    return counts.value_counts(_merged(t), "churn")


@query
def channel_values(t: StarInputs) -> DataFrame:
    return counts.distinct_values(_merged(t), "attribution_technical")


# --- preparation ------------------------------------------------------------------


@query
def train_test_counts(t: StarInputs) -> DataFrame:
    rows = _written(_merged(t), "subid", "churn")
    held_out = prep.is_within(prep.split_bound(rows))
    return rows.groupBy(held_out.alias("is_test")).agg(
        F.count("*").alias("n_rows"), F.sum("churn").alias("churned")
    )


@query
def fold_counts(t: StarInputs) -> DataFrame:
    train, _ = prep.exact_split(_written(_merged(t), "subid", "churn"))
    return prep.stratified_folds(train).groupBy("fold", "churn").agg(F.count("*").alias("n_rows"))


@query
def one_hot(t: StarInputs) -> DataFrame:
    encoded, names = prep.one_hot(_written(_merged(t), "subid", *C.CATEGORICAL_FEATURES))
    return encoded.unpivot(["subid"], names, "feature", "value")


@query
def one_hot_cells(t: StarInputs) -> DataFrame:
    """The cells of sparse one-hot vectors that are not zero."""
    encoded, model = fitted.sparse_one_hot(_written(_merged(t), "subid", *C.CATEGORICAL_FEATURES))
    flags = encoded.where("male_TF").select("subid", F.lit("male_TF").alias("feature"), F.lit(1).alias("value"))
    return fitted.hot_cells(encoded, model).unionByName(flags)


@query
def minmax_scaled(t: StarInputs) -> DataFrame:
    rows = _written(_merged(t), "subid", *C.NUMERIC_FEATURES)
    train, _ = prep.exact_split(rows)
    return prep.minmax(rows, train)


# --- evaluation -------------------------------------------------------------------


@query
def confusion_matrix(t: StarInputs) -> DataFrame:
    return metrics.confusion(_scores(t))


@query
def binary_metrics(t: StarInputs) -> DataFrame:
    return metrics.binary_metrics(_scores(t))


@query
def classification_report(t: StarInputs) -> DataFrame:
    return metrics.class_report(_scores(t))


@query
def roc_curve(t: StarInputs) -> DataFrame:
    return metrics.roc(_written(_scores(t), "churn", "prob"))


@query
def roc_corners(t: StarInputs) -> DataFrame:
    return metrics.roc(_written(_scores(t), "churn", "prob"), drop_intermediate=True)


@query
def auc(t: StarInputs) -> DataFrame:
    return metrics.auc(_written(_scores(t), "churn", "prob"))


# --- lifetime value ----------------------------------------------------------------


@query
def tier_counts(t: StarInputs) -> DataFrame:
    return counts.value_counts(tiers.assign_tier(_merged(t)), "tier")


@query
def channel_fold(t: StarInputs) -> DataFrame:
    return clv.fold_channel(t.subscribers).select("subid", "attribution_technical", "cac_channel")


@query
def cac_per_subscriber(t: StarInputs) -> DataFrame:
    people = tiers.assign_tier(_merged(t))
    return clv.cac_audit(clv.assign_cac(people, _cost(t).cost))


@query
def cac_null_channels(t: StarInputs) -> DataFrame:
    people = tiers.assign_tier(_merged(t))
    return clv.cac_null_channels(clv.assign_cac(people, _cost(t).cost))


@query
def plan_price_counts(t: StarInputs) -> DataFrame:
    return counts.value_counts(_merged(t), "plan_type", "discount_price")


@query
def clv_per_subscriber(t: StarInputs) -> DataFrame:
    return _valued(t).select("subid", "tier", "CAC_i", "prob_churn", "CLV_i")


@query
def clv_from_files(t: StarInputs) -> DataFrame:
    """Lifetime value from the two files handed on: the cost table and the churn scores."""
    cost_file, score_file = tables.shared_dir(t.spark), tables.shared_dir(t.spark)
    tables.write_csv(acquisition.cost_wide(_cost(t).cost), cost_file)
    tables.write_csv(_all_scores(t).select(*tables.TABLES["scores"].names), score_file)
    cost = acquisition.cost_long(tables.read_csv(t.spark, cost_file, tables.TABLES["acquisition_cost"]))
    scores = tables.read_csv(t.spark, score_file, tables.TABLES["scores"])
    people = _written(_merged(t), *VALUE_COLUMNS)
    return churn_value.valued(people, cost, scores).select("subid", "tier", "CAC_i", "prob_churn", "CLV_i")


@query
def clv_summary(t: StarInputs) -> DataFrame:
    return clv.clv_summary(_written(_valued(t), "CLV_i"))


@query
def churn_by_channel(t: StarInputs) -> DataFrame:
    return clv.churn_by_channel(_merged(t))


@query
def churn_by_channel_group(t: StarInputs) -> DataFrame:
    return clv.churn_by_channel_group(_merged(t))


# --- distributions -----------------------------------------------------------------


@query
def clv_hist_fixed(t: StarInputs) -> DataFrame:
    low, high = C.CLV_PLOT_RANGE
    return distribution.histogram(_valued(t), "CLV_i", low=low, high=high)


@query
def clv_hist(t: StarInputs) -> DataFrame:
    return distribution.histogram(_written(_valued(t), "CLV_i"), "CLV_i")


@query
def clv_hist_by_tier(t: StarInputs) -> DataFrame:
    return distribution.histogram_by(_values_by(t, "tier"), "tier", "CLV_i")


@query
def clv_hist_by_intended_use(t: StarInputs) -> DataFrame:
    values = _values_by(t, "intended_use", _modelling_table(t))
    return distribution.histogram_by(values, "intended_use", "CLV_i")


@query
def clv_hist_by_op_sys(t: StarInputs) -> DataFrame:
    return distribution.histogram_by(_values_by(t, "op_sys", _modelling_table(t)), "op_sys", "CLV_i")


@query
def clv_kde(t: StarInputs) -> DataFrame:
    return distribution.kde(_written(_valued(t), "CLV_i"), "CLV_i")


@query
def clv_kde_by_gender(t: StarInputs) -> DataFrame:
    return distribution.kde_by(_values_by(t, "male_TF"), "male_TF", "CLV_i")


@query
def clv_kde_binned(t: StarInputs) -> DataFrame:
    return distribution.kde_binned(_written(_valued(t), "CLV_i"), "CLV_i")


@query
def clv_kde_binned_by_gender(t: StarInputs) -> DataFrame:
    return distribution.kde_binned(_values_by(t, "male_TF"), "CLV_i", "male_TF")


@query
def clv_kde_by_churn(t: StarInputs) -> DataFrame:
    return distribution.kde_by(_values_by(t, "churn"), "churn", "CLV_i")


# --- models -----------------------------------------------------------------------


def _training(t: StarInputs) -> models.TrainingData:
    return models.training_data(_modelling_table(t))


def _final_metrics(data: models.TrainingData, found: tuning.Search) -> DataFrame:
    """Metrics of the best model of a search on train and on test rows."""
    parts = []
    for name, rows in (("train", data.train), ("test", data.test)):
        scored = models.score(rows, found.model)
        area = metrics.auc(scored).scalar()
        parts.append(metrics.binary_metrics(scored).select(F.lit(name).alias("rows"), "*", area.alias("auc")))
    return parts[0].unionByName(parts[1])


@query
def final_forest_report(t: StarInputs) -> DataFrame:
    """Class report of the best forest of a search on train and on test rows."""
    data = _training(t)
    model = tuning.search_forest(data).model
    parts = [
        metrics.class_report(models.score(rows, model)).select(F.lit(name).alias("rows"), "*")
        for name, rows in (("train", data.train), ("test", data.test))
    ]
    return parts[0].unionByName(parts[1])


@query
def final_forest_roc(t: StarInputs) -> DataFrame:
    """ROC points of the best forest of a search on the test rows, without those on a line."""
    data = _training(t)
    scored = models.score(data.test, tuning.search_forest(data).model)
    return metrics.roc(_written(scored, "churn", "prob"), drop_intermediate=True)


@query
def logistic_scores(t: StarInputs) -> DataFrame:
    data = _training(t)
    return models.score(data.test, models.PenalisedLogit().fit(data.train))


@query
def rfe_ranking(t: StarInputs) -> DataFrame:
    return models.rfe(_training(t))


@query
def logit_summary(t: StarInputs) -> DataFrame:
    return models.logit_summary(_training(t))


@query
def logit_fit(t: StarInputs) -> DataFrame:
    return models.logit_fit(_training(t))


@query
def forest_scores(t: StarInputs) -> DataFrame:
    data = _training(t)
    return models.score(data.test, models.fit_forest(data.train))


@query
def top_features(t: StarInputs) -> DataFrame:
    data = _training(t)
    return models.top_features(models.importances(models.fit_forest(data.train), data))


@query
def voted_features(t: StarInputs) -> DataFrame:
    data = _training(t)
    importance = models.importances(models.fit_forest(data.train), data)
    return models.vote_features(models.rfe(data), importance)


def _channel_ranking(t: StarInputs) -> tuple[DataFrame, DataFrame]:
    """Channels in place of features: importance is their share of churn, support a churn rate above one half."""
    rates = _written(
        _merged(t).groupBy(F.col("attribution_technical").alias("feature")).agg(
            F.sum("churn").alias("churned"), F.avg("churn").alias("rate")
        ).where(F.col("feature").isNotNull()),
        "feature", "churned", "rate",
    )
    total = rates.agg(F.sum("churned")).scalar()
    importance = rates.select("feature", (F.col("churned") / total).alias("importance"))
    return rates.select("feature", (F.col("rate") > 0.5).alias("selected")), importance


@query
def top_channels(t: StarInputs) -> DataFrame:
    """The top-k of a table that is not fitted, so that it can be checked."""
    return models.top_features(_channel_ranking(t)[1], 5)


@query
def voted_channels(t: StarInputs) -> DataFrame:
    """The vote over tables that are not fitted, so that it can be checked."""
    return models.vote_features(*_channel_ranking(t), 5)


@query
def curve_c_accuracy(t: StarInputs) -> DataFrame:
    return tuning.validation_curve(_training(t))


@query
def curve_c_pipeline(t: StarInputs) -> DataFrame:
    """Accuracy for each C where every fold indexes, encodes and scales on its own rows."""
    train, _ = fitted.split_and_fold(tables.materialize(_modelling_table(t)))
    found = fitted.cross_validate(tables.materialize(train))
    rows = [(float(c), float(a), float(d)) for c, a, d in zip(C.C_VALIDATION, found.avgMetrics, found.stdMetrics)]
    return t.spark.createDataFrame(rows, "c double, mean_accuracy double, std_accuracy double")


@query
def saved_pipeline_scores(t: StarInputs) -> DataFrame:
    """Scores of the test rows by a fitted pipeline that was saved and loaded."""
    train, test = fitted.split_and_fold(tables.materialize(_modelling_table(t)))
    numbered = train.withColumn("churn", F.col("churn").cast("double"))
    path = tables.shared_dir(t.spark)
    fitted.churn_pipeline(numbered).fit(numbered).write().save(path)
    return models.score(test, PipelineModel.load(path))


@query
def curve_c_auc(t: StarInputs) -> DataFrame:
    return tuning.sweep_c(_training(t))


@query
def curve_depth_auc(t: StarInputs) -> DataFrame:
    return tuning.sweep_depth(_training(t))


@query
def curve_trees_auc(t: StarInputs) -> DataFrame:
    return tuning.sweep_trees(_training(t))


@query
def grid_logistic_best(t: StarInputs) -> DataFrame:
    data = _training(t)
    return tuning.search_results(data, tuning.search_logistic(data))


@query
def grid_forest_best(t: StarInputs) -> DataFrame:
    data = _training(t)
    return tuning.search_results(data, tuning.search_forest(data))


@query
def churn_scores(t: StarInputs) -> DataFrame:
    data = _training(t)
    return models.score(data.test, tuning.search_forest(data).model)


@query
def final_logistic_metrics(t: StarInputs) -> DataFrame:
    data = _training(t)
    return _final_metrics(data, tuning.search_logistic(data))


@query
def final_forest_metrics(t: StarInputs) -> DataFrame:
    data = _training(t)
    return _final_metrics(data, tuning.search_forest(data))


@query
def clv_from_model(t: StarInputs) -> DataFrame:
    people = tables.materialize(_modelling_table(t))
    data = models.training_data(people)
    scores = models.score(data.everyone, models.fit_forest(data.train))
    return clv.clv_summary(_written(churn_value.valued(people, _cost(t).cost, scores), "CLV_i"))
