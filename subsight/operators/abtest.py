"""A/B test of a join fee: variant A pays one (fee above 0), variant B does not."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsight.constants import (
    ALPHA,
    POWER_QUANTILE,
    PROFILE_COLUMNS,
    SAMPLE_SIZE,
    SPRT_LOWER,
    SPRT_SAMPLE,
    SPRT_UPPER,
    TRIALS,
    Z_CRITICAL,
)
from subsight.functions.hashing import SEED
from subsight.functions.ordered import ranked_sample, running_totals
from subsight.operators.counts import text_of

IN_A, IN_B = "variant = 'A'", "variant = 'B'"
STEPS_PER_RANGE = 4096


def variants(subscribers: DataFrame) -> DataFrame:
    """Rows in the test, with their ``variant``. A NULL fee is in neither."""
    fee = F.col("join_fee")
    return subscribers.where(fee.isNotNull()).withColumn(
        "variant", F.when(fee > 0, "A").when(fee <= 0, "B")
    )


def scope_counts(subscribers: DataFrame) -> DataFrame:
    """One row: users overall, rows without and with a fee, users per variant.

    Counts per subscriber first; several distinct counts side by side would
    copy every row once per count.
    """
    fee = F.col("join_fee")
    per_user = subscribers.groupBy("subid").agg(
        F.count_if(fee.isNull()).alias("null_fee"),
        F.count(fee).alias("with_fee"),
        F.max(fee > 0).alias("in_a"),
        F.max(fee <= 0).alias("in_b"),
    )
    known = F.col("subid").isNotNull()
    return per_user.agg(
        F.count_if(known).alias("total_users"),
        F.sum("null_fee").alias("null_fee_rows"),
        F.sum("with_fee").alias("focus_rows"),
        F.count_if(known & F.col("in_a")).alias("users_a"),
        F.count_if(known & F.col("in_b")).alias("users_b"),
    ).withColumn("users_in_test", F.col("users_a") + F.col("users_b"))


def variant_profile(subscribers: DataFrame, cols: list[str] = PROFILE_COLUMNS) -> DataFrame:
    """Percentage of each value of each column, per variant.

    All columns are counted in one pass, the rows of the two variants in another. The divisor counts all rows of the variant, NULL values too, so the shares
    of a column may add up to less than 100.
    """
    stacked = text_of(variants(subscribers).select("variant", *cols), cols).unpivot(
        ["variant"], cols, "dimension", "value"
    )
    counted = stacked.where(F.col("value").isNotNull()).groupBy("variant", "dimension", "value").agg(F.count("*").alias("n"))
    # Two rows.
    rows = F.broadcast(variants(subscribers).groupBy("variant").agg(F.count("*").alias("_rows")))
    return counted.join(rows, "variant").select(
        "variant", "dimension", "value", "n", (F.col("n") / F.col("_rows") * 100).alias("percent")
    )


def conversion(subscribers: DataFrame) -> DataFrame:
    """Rows, conversions and conversion rate per variant; rows with unknown payment count."""
    return (
        variants(subscribers)
        .groupBy("variant")
        .agg(F.count("*").alias("n_rows"), F.count_if("paid_TF").alias("conversions"))
        .withColumn("rate", F.col("conversions") / F.col("n_rows"))
    )


def rates(subscribers: DataFrame) -> DataFrame:
    """One row: sizes ``n0, n1`` and conversion rates ``p0, p1`` of variants A and B."""
    one_row = variants(subscribers).agg(
        F.expr(f"count_if({IN_A}) as n0"),
        F.expr(f"count_if({IN_B}) as n1"),
        F.expr(f"count_if({IN_A} and paid_TF) as x0"),
        F.expr(f"count_if({IN_B} and paid_TF) as x1"),
    )
    return one_row.withColumns(
        {"p0": F.try_divide("x0", "n0"), "p1": F.try_divide("x1", "n1")}
    )


def sample_size(
    subscribers: DataFrame, alpha: float = ALPHA, power_quantile: float = POWER_QUANTILE
) -> DataFrame:
    """Rows needed per variant to see the difference between the two rates."""
    z_alpha = NormalDist().inv_cdf(1 - alpha / 2)
    p0, p1 = F.col("p0"), F.col("p1")
    pooled = (p0 + p1) / 2
    spread = z_alpha * F.sqrt(2 * pooled * (1 - pooled)) + power_quantile * F.sqrt(
        p0 * (1 - p0) + p1 * (1 - p1)
    )
    return rates(subscribers).select(
        "p0",
        "p1",
        (p1 - p0).alias("delta"),
        F.lit(z_alpha).alias("z_alpha"),
        F.try_divide(F.pow(spread, F.lit(2)), F.pow(p1 - p0, F.lit(2))).alias("sample_size"),
    )


def z_against(rate: Column, baseline: Column, n: Column) -> Column:
    """One-sample z score of a rate over ``n`` rows against a baseline rate."""
    return F.try_divide(rate - baseline, F.sqrt(F.try_divide(baseline * (1 - baseline), n)))


def z_one_sample(subscribers: DataFrame) -> DataFrame:
    """z score of variant B against the rate of variant A."""
    p0, p1, n1 = F.col("p0"), F.col("p1"), F.col("n1")
    return rates(subscribers).select("p0", "p1", "n1", z_against(p1, p0, n1).alias("z"))


def z_two_sample(subscribers: DataFrame) -> DataFrame:
    """Pooled two-sample z score of variant B against variant A."""
    n0, n1 = F.col("n0"), F.col("n1")
    pooled = (F.col("p1") * n1 + F.col("p0") * n0) / (n0 + n1)
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), n1) + F.try_divide(F.lit(1), n0)))
    return rates(subscribers).select(
        "n0",
        "n1",
        pooled.alias("pooled_rate"),
        F.try_divide(F.col("p1") - F.col("p0"), error).alias("z"),
    )


def sample_n(df: DataFrame, n: int, key: str = "subid", seed=SEED) -> DataFrame:
    """``n`` rows without replacement, repeatable."""
    return ranked_sample(df, n, key, seed)


def z_trials(
    subscribers: DataFrame,
    n: int = SAMPLE_SIZE,
    trials: int = TRIALS,
    seed=SEED,
    critical: float = Z_CRITICAL,
) -> DataFrame:
    """z score of ``trials`` fresh samples of variant B against the rate of variant A.

    ``reject`` looks at the upper side only. A variant with fewer than ``n``
    rows is taken whole.
    """
    baseline = rates(subscribers).select("p0").scalar()
    numbers = F.sequence(F.lit(1), F.lit(trials))
    draws = variants(subscribers).where(IN_B).select(
        "subid", "paid_TF", F.explode(numbers).alias("trial")
    )
    return (
        ranked_sample(draws, n, "subid", seed, by=("trial",))
        .groupBy("trial")
        .agg(F.count("*").alias("n"), F.count_if("paid_TF").alias("conversions"))
        .withColumn("p_sample", F.col("conversions") / F.col("n"))
        .withColumn("z", z_against(F.col("p_sample"), baseline, F.col("n")))
        .withColumn("reject", F.col("z") >= critical)
    )


def trial_decisions(trials: DataFrame) -> DataFrame:
    """How many trials reject and how many accept that the variants are alike."""
    return trials.agg(
        F.count_if("reject").alias("reject_null"),
        F.count_if(F.coalesce(~F.col("reject"), F.lit(True))).alias("accept_null"),
    )


def sprt_steps(subscribers: DataFrame, n: int = SPRT_SAMPLE, seed=SEED) -> DataFrame:
    """Log-likelihood ratio after each of ``n`` sampled rows of variant B.

    Conversions so far are counted and weighted at the end, which gives the
    same sum in any order of work. A row with unknown payment adds nothing.
    """
    # Both rates in one subquery, so in one pass.
    base = rates(subscribers).select(F.struct("p0", "p1").alias("base")).scalar()
    sample = ranked_sample(
        variants(subscribers).where(IN_B).select("subid", "paid_TF"), n, "subid", seed
    ).select(
        F.col("sample_rank").alias("step"),
        F.coalesce(F.col("paid_TF").cast("int"), F.lit(0)).alias("paid"),
        F.coalesce((~F.col("paid_TF")).cast("int"), F.lit(0)).alias("unpaid"),
    )
    counted = running_totals(
        sample,
        "step",
        {"n_paid": "paid", "n_unpaid": "unpaid"},
        known_range=F.floor(F.col("step") / STEPS_PER_RANGE),
    )
    p0, p1 = F.col("_base")["p0"], F.col("_base")["p1"]
    gain = F.ln(F.try_divide(p1, p0))
    loss = F.ln(F.try_divide(1 - p1, 1 - p0))
    return counted.withColumn("_base", base).select(
        "step", (F.col("n_paid") * gain + F.col("n_unpaid") * loss).alias("log_ratio")
    )


def _crossed(lower: float, upper: float) -> Column:
    return (F.col("log_ratio") <= lower) | (F.col("log_ratio") >= upper)


def sprt(
    subscribers: DataFrame,
    n: int = SPRT_SAMPLE,
    lower: float = SPRT_LOWER,
    upper: float = SPRT_UPPER,
    seed=SEED,
) -> DataFrame:
    """Wald's sequential test: where it stops, with what sum and what decision.

    A sample that never leaves the band gives ``undecided`` at its last row.
    """
    row = F.struct("step", "log_ratio")
    ends = sprt_steps(subscribers, n, seed).agg(
        F.min(F.when(_crossed(lower, upper), row)).alias("stop"), F.max(row).alias("last")
    )
    stop = F.coalesce("stop", "last")
    return ends.select(
        stop["step"].alias("step"),
        stop["log_ratio"].alias("log_ratio"),
        F.when(F.col("stop")["log_ratio"] >= upper, "reject")
        .when(F.col("stop")["log_ratio"] <= lower, "accept")
        .otherwise("undecided")
        .alias("decision"),
    )


def sprt_trace(
    subscribers: DataFrame,
    n: int = SAMPLE_SIZE,
    lower: float = SPRT_LOWER,
    upper: float = SPRT_UPPER,
    seed=SEED,
) -> DataFrame:
    """Every step of the sequential test up to and including the one that stops it."""
    steps = sprt_steps(subscribers, n, seed)
    stop = steps.where(_crossed(lower, upper)).agg(F.min("step").alias("stop")).scalar()
    return steps.where(F.col("step") <= F.coalesce(stop, F.lit(n)))
