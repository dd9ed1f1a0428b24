"""The input tables, derived from star-schema tables (customer, orders, events, nation).

Stands in for the real files: ``customer`` rows become subscribers, ``events``
become daily engagement, ``orders`` become payment periods and ``nation`` rows
become advertising spend.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from subsight.constants import PAID_CHANNELS, TIER_UPPER_BOUNDS
from subsight.functions.joins import hot_keys, split_join
from subsight.functions.ordered import group_positions

_CHANNEL_BY_CODE = PAID_CHANNELS + [
    "youtube",
    "display",
    "bing",
    "organic",
    "google_organic",
    "internal",
    "facebook",
    "unmapped",
]
_CHANNEL_SQL = "element_at(array({}), cast((c_custkey * 31) % 16 as int) + 1)".format(
    ", ".join(f"'{name}'" for name in _CHANNEL_BY_CODE)
)

_SUBSCRIBERS = {
    "subid": "c_custkey",
    "account_creation_date": """if(c_custkey % 97 = 0, null,
        timestamp '2019-07-01 00:00:00' + interval '1' day * cast((c_custkey * 7919) % 275 as int))""",
    "join_fee": """case when c_custkey % 5 = 0 then null when c_custkey % 3 = 0 then 0e0
        else 0.1e0 * (1 + c_nationkey % 4) end""",
    "paid_TF": "if(c_custkey % 3 = 0, c_acctbal > 4200, c_acctbal > 5000)",
    "refund_after_trial_TF": "c_acctbal > 5000 and c_custkey % 11 = 0",
    "cancel_before_trial_end": "c_acctbal <= 4000",
    "retarget_TF": "c_nationkey % 6 = 0",
    "initial_credit_card_declined": "c_custkey % 19 = 0",
    "op_sys": "case when c_custkey % 13 = 0 then null when c_nationkey % 2 = 0 then 'iOS' else 'Android' end",
    "intended_use": "if(c_custkey % 17 = 0, null, lower(c_mktsegment))",
    "male_TF": "c_nationkey % 5 < 2",
    "plan_type": "element_at(array('plan_a', 'plan_b', 'plan_c'), c_nationkey % 3 + 1)",
    "payment_type": "nullif(element_at(array('', 'card', 'wallet', 'store'), c_nationkey % 4 + 1), '')",
    "attribution_technical": _CHANNEL_SQL,
    "attribution_survey": "if(c_custkey % 4 = 0, null, 'survey')",
    "age": "if(c_custkey % 3 = 0, null, cast(18 + c_nationkey as double))",
    "months_per_bill_period": "1",
    "language": "'eng'",
    "monthly_price": "cast(4.5e0 + c_nationkey % 3 as double)",
    "discount_price": "cast(3.5e0 + c_nationkey % 3 as double)",
    "revenue_net": "if(c_custkey % 23 = 0, null, c_acctbal / 1000)",
    "trial_end_date": "timestamp '2024-01-10 00:00:00' + interval '1' day * cast(c_custkey % 10 as int)",
}

_EVENT_COUNTERS = {
    "app_opens": "event_type = 'view'",
    "cust_service_mssgs": "event_type = 'error'",
    "num_videos_completed": "event_type = 'purchase'",
    "num_videos_more_than_30_seconds": "event_type = 'click' and value > 20",
    "num_videos_rated": "event_type = 'click'",
    "num_series_started": "event_type = 'signup'",
}


# The columns in use; a given schema spares a look into the files.
_STAR_SCHEMAS = {
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "ts timestamp_ntz, user_id bigint, event_type string, value double",
    "nation": "n_nationkey int",
}


class StarInputs:
    """Lazy access to the four input tables over one data folder."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_STAR_SCHEMAS[name]).parquet(f"{self.directory}/{name}.parquet")

    @cached_property
    def subscribers(self) -> DataFrame:
        return self._read("customer").selectExpr(
            *[f"{text} as {name}" for name, text in _SUBSCRIBERS.items()]
        )

    @cached_property
    def engagement(self) -> DataFrame:
        """Daily counters. A very active user shrinks to a row per day before the shuffle."""
        return (
            self._read("events")
            .groupBy(
                F.col("user_id").alias("subid"),
                F.to_date("ts").alias("date"),
                F.when(F.dayofmonth("ts") <= 14, 0).otherwise(1).alias("payment_period"),
            )
            .agg(*[F.expr(f"count_if({test}) as {name}") for name, test in _EVENT_COUNTERS.items()])
        )

    @cached_property
    def _order_facts(self) -> DataFrame:
        return self._read("orders").select(
            F.col("o_custkey").alias("subid"),
            F.col("o_orderdate"),
            F.col("o_orderkey"),
            F.col("o_orderpriority").alias("billing_channel"),
            (F.col("o_orderkey") % 15).cast("int").alias("num_trial_days"),
        )

    @cached_property
    def hot_subscribers(self) -> list[int]:
        """Subscribers with very many orders, counted once; a bounded number of them."""
        return sorted(r["subid"] for r in hot_keys(self._order_facts, "subid").collect())

    def _with_account(self, facts: DataFrame, hot: list[int] | None = None) -> DataFrame:
        """Add the account of each row; rows of ``hot`` subscribers are split by order."""
        accounts = self.subscribers.select(
            "subid",
            "account_creation_date",
            (~F.col("cancel_before_trial_end")).alias("trial_completed_TF"),
        )
        return facts.join(accounts, "subid") if hot is None else split_join(facts, accounts, "subid", "o_orderkey", hot=hot)

    @cached_property
    def customer(self) -> DataFrame:
        """All payment periods of all subscribers, numbered from 0 by order date.

        Numbered day by day, as one subscriber may hold a large part of all rows.
        """
        numbered = group_positions(self._order_facts, "subid", "o_orderdate", "o_orderkey")
        periods = numbered.withColumn("payment_period", F.col("position").cast("int"))
        return self._with_account(periods, self.hot_subscribers).select(
            "subid",
            "account_creation_date",
            "payment_period",
            "billing_channel",
            "trial_completed_TF",
            "num_trial_days",
        )

    def customer_up_to(self, last_period: int) -> DataFrame:
        """Payment periods 0..last_period only; the rest never leaves the scan tasks."""
        order = W.partitionBy("subid").orderBy("o_orderdate", "o_orderkey")
        periods = (
            self._order_facts.withColumn("rn", F.row_number().over(order))
            .where(F.col("rn") <= last_period + 1)
            .withColumn("payment_period", F.col("rn") - 1)
        )
        return self._with_account(periods).select("subid", "account_creation_date", "payment_period")

    @cached_property
    def customer_facts(self) -> DataFrame:
        """The customer table without its period number, which costs a shuffle to derive."""
        return self._with_account(self._order_facts, self.hot_subscribers).select(
            "subid",
            "account_creation_date",
            "billing_channel",
            "trial_completed_TF",
            "num_trial_days",
            "o_orderkey",
        )

    @cached_property
    def customer_accounts(self) -> DataFrame:
        """One row per subscriber in the customer table, reduced before the join."""
        seen = self._order_facts.select("subid").distinct()
        return self._with_account(seen).select("subid", "account_creation_date")

    @cached_property
    def trial_facts(self) -> DataFrame:
        """Customer rows counted per subscriber and trial outcome, reduced before the join."""
        counted = self._order_facts.groupBy("subid", "num_trial_days").agg(F.count("*").alias("n"))
        return self._with_account(counted).select("subid", "trial_completed_TF", "num_trial_days", "n")

    @cached_property
    def spend(self) -> DataFrame:
        period = F.col("n_nationkey")
        # Base and slope of each channel's spend rise with its place in the list.
        columns = {
            name: (1000 + 250 * place + period * 37 * (place + 1)).cast("double")
            for place, name in enumerate(PAID_CHANNELS)
        }
        return (
            self._read("nation")
            .where(period <= len(TIER_UPPER_BOUNDS))
            .select(
                period.cast("int").alias("period_idx"),
                *[value.alias(name) for name, value in columns.items()],
            )
        )
