"""These must stay as they are for results to be right."""

# --- fixed values: sign-up tiers, upper bounds (inclusive, at midnight) -----
TIER_UPPER_BOUNDS = [
    "2019-07-30",
    "2019-08-30",
    "2019-09-30",
    "2019-10-30",
    "2019-11-30",
    "2019-12-30",
    "2020-01-30",
    "2020-02-29",
    "2020-03-30",
]

# --- fixed values: channels --------------------------------------------------
PAID_CHANNELS = [
    "facebook",
    "email",
    "search",
    "brand sem intent google",
    "affiliate",
    "email_blast",
    "pinterest",
    "referral",
]
# Channels without a cost of their own, under the paid channel that stands in.
STAND_IN_CHANNELS = {
    "facebook": ["youtube", "podcast", "twitter"],
    "affiliate": ["display", "influencer", "samsung", "criteo"],
    "brand sem intent google": ["brand sem intent bing", "bing"],
}
ORGANIC_CHANNELS = [
    "organic",
    "google_organic",
    "facebook_organic",
    "discovery",
    "other",
    "internal",
    "bing_organic",
    "direct_mail",
    "pinterest_organic",
    "quora",
    "appstore",
    "playstore",
    "tv",
    "content_greatist",
    "ott",
    "vod",
]
CHANNEL_GROUPS = {
    "group_1": ["email", "affiliate", "email_blast"],
    "group_2": ["facebook", "search", "brand sem intent google", "pinterest", "referral"],
}
# The last row of the spend sheet has no sign-ups to set against it.
UNUSED_SPEND_PERIOD = 9

# --- fixed values: A/B test ----------------------------------------------------
PROFILE_COLUMNS = [
    "retarget_TF",
    "paid_TF",
    "op_sys",
    "plan_type",
    "discount_price",
    "cancel_before_trial_end",
    "payment_type",
    "refund_after_trial_TF",
]
ALPHA = 0.05
POWER_QUANTILE = 0.84162
SAMPLE_SIZE = 2946
TRIALS = 10
Z_CRITICAL = 1.96
SPRT_SAMPLE = 5000
SPRT_LOWER = -1.6
SPRT_UPPER = 2.99

# --- fixed values: cohorts ---------------------------------------------------
LAST_COHORT_PERIOD = 12

# --- fixed values: churn model -------------------------------------------------
ACTIVITY_COUNTERS = [
    "app_opens",
    "cust_service_mssgs",
    "num_videos_completed",
    "num_videos_more_than_30_seconds",
    "num_videos_rated",
    "num_series_started",
]
# Counters set against active days; the others go against the whole duration.
PER_ACTIVE_DAY = ["app_opens", "num_videos_more_than_30_seconds"]
NUMERIC_FEATURES = [
    "active_per_dur",
    "app_opens_per_duration",
    "cust_service_mssgs_per_duration",
    "num_videos_completed_per_duration",
    "num_videos_more_than_30_seconds_per_duration",
    "num_videos_rated_per_duration",
    "num_series_started_per_duration",
]
CATEGORICAL_FEATURES = ["intended_use", "male_TF", "attribution_technical", "op_sys", "plan_type"]
IMPUTED_COLUMNS = ["intended_use", "op_sys"]
UNUSED_COLUMNS = [
    "attribution_survey",
    "months_per_bill_period",
    "monthly_price",
    "language",
    "age",
    "initial_credit_card_declined",
]
MAX_NULL_PERCENT = 17
LOGIT_SUMMARY_FEATURES = NUMERIC_FEATURES + [
    "attribution_technical_pinterest_organic",
    "op_sys_Android",
    "op_sys_iOS",
]
TEST_SHARE = 0.4
FOLDS = 5
SELECTED_BY_ELIMINATION = 10
TOP_IMPORTANCES = 30
TOP_VOTES = 15
C_VALIDATION = [0.001 + i for i in range(10)]
C_SWEEP = [0.1, 0.5, 1.0, 1.5, 1.75, 2.0]
C_GRID = [0.8 + i * (2.0 - 0.8) / 9 for i in range(10)]
MAX_ITER_GRID = [100, 110, 120, 130, 140]
TREES = 100
TREES_SWEEP = [10, 30, 50, 70, 100, 200]
DEPTH_SWEEP = [5, 10, 30, 50, 70]
DEPTH_GRID = [20, 30]
FEATURES_GRID = [5, 15, 25]

# --- fixed values: lifetime value ------------------------------------------------
DISCOUNT_RATE = 0.10
HISTOGRAM_BINS = 50
CLV_PLOT_RANGE = (-7.36, 41.0)
DENSITY_POINTS = 100

PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.95]
