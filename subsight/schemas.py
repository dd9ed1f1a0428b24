"""One fixed schema per input or interchange table."""

from pyspark.sql import types as T

from subsight.constants import ACTIVITY_COUNTERS, PAID_CHANNELS


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_LONG, _INT, _DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()
_TEXT, _FLAG, _TIME, _DATE = T.StringType(), T.BooleanType(), T.TimestampType(), T.DateType()

# One row per subscriber.
SUBSCRIBERS = _struct(
    subid=_LONG,
    account_creation_date=_TIME,
    join_fee=_DOUBLE,
    paid_TF=_FLAG,
    refund_after_trial_TF=_FLAG,
    cancel_before_trial_end=_FLAG,
    retarget_TF=_FLAG,
    initial_credit_card_declined=_FLAG,
    op_sys=_TEXT,
    intended_use=_TEXT,
    male_TF=_FLAG,
    plan_type=_TEXT,
    payment_type=_TEXT,
    attribution_technical=_TEXT,
    attribution_survey=_TEXT,
    age=_DOUBLE,
    months_per_bill_period=_INT,
    language=_TEXT,
    monthly_price=_DOUBLE,
    discount_price=_DOUBLE,
    revenue_net=_DOUBLE,
    trial_end_date=_TIME,
)

# One row per subscriber, day and payment period (0 is the trial).
ENGAGEMENT = _struct(
    subid=_LONG, date=_DATE, payment_period=_INT, **{name: _LONG for name in ACTIVITY_COUNTERS}
)

# One row per subscriber and payment period.
CUSTOMER = _struct(
    subid=_LONG,
    account_creation_date=_TIME,
    payment_period=_INT,
    billing_channel=_TEXT,
    trial_completed_TF=_FLAG,
    num_trial_days=_INT,
)

# One row per sign-up tier, one column per paid channel.
SPEND = _struct(period_idx=_INT, **{name: _DOUBLE for name in PAID_CHANNELS})

# Cost per acquired person: tiers 0..8, then the mean row (NULL tier).
ACQUISITION_COST = _struct(row_label=_TEXT, tier=_INT, **{name: _DOUBLE for name in PAID_CHANNELS})

# Churn probabilities, keyed by subscriber.
SCORES = _struct(subid=_LONG, churn=_INT, prob=_DOUBLE)

TABLES = {
    "subscribers": SUBSCRIBERS,
    "engagement": ENGAGEMENT,
    "customer": CUSTOMER,
    "spend": SPEND,
    "acquisition_cost": ACQUISITION_COST,
    "scores": SCORES,
}
