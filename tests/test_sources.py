import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from subsight import schemas
from subsight.constants import PAID_CHANNELS
from subsight.operators import engagement
from subsight.sources import tables
from subsight.sources.star import StarInputs


@pytest.fixture(scope="module")
def star(spark, sf_dir):
    return StarInputs(spark, sf_dir)


@pytest.mark.parametrize("name", ["subscribers", "engagement", "customer", "spend"])
def test_inputs_have_the_fixed_schema(star, name):
    found = {f.name: f.dataType for f in getattr(star, name).schema.fields}
    assert found == {f.name: f.dataType for f in schemas.TABLES[name].fields}


def test_periods_are_numbered_by_order_date(star):
    exact = {(r.subid, r.payment_period): r.n for r in star.customer.groupBy("subid", "payment_period").agg(
        F.count("*").alias("n")).collect()}
    assert set(exact.values()) == {1}
    sizes = {r.subid: r.n for r in star.customer_facts.groupBy("subid").agg(F.count("*").alias("n")).collect()}
    assert set(exact) == {(s, p) for s, n in sizes.items() for p in range(n)}
    limited = {(r.subid, r.payment_period) for r in star.customer_up_to(3).collect()}
    assert limited == {k for k in exact if k[1] <= 3}


def test_reduced_customer_tables_agree_with_the_full_one(star):
    full = star.customer
    accounts = star.customer_accounts
    assert accounts.count() == full.select("subid").distinct().count() == accounts.distinct().count()
    assert star.trial_facts.agg(F.sum("n")).first()[0] == full.count()


def test_parquet_filters_and_columns_reach_the_scan(spark, star, tmp_path):
    star.engagement.write.parquet(f"{tmp_path}/engagement.parquet")
    df = tables.read_table(spark, str(tmp_path), "engagement")
    plan = engagement.trial_engagement(df).select("subid", "app_opens")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(payment_period,0)" in text
    assert "ReadSchema: struct<subid:bigint,payment_period:int,app_opens:bigint>" in text


def test_nan_becomes_null(spark, tmp_path):
    rows = [(1, math.nan), (2, 0.5), (3, None)]
    spark.createDataFrame(rows, "subid long, join_fee double").write.parquet(f"{tmp_path}/subscribers.parquet")
    df = tables.read_table(spark, str(tmp_path), "subscribers", has_nan=True)
    assert {r.subid: r.join_fee for r in df.collect()} == {1: None, 2: 0.5, 3: None}
    assert df.where("join_fee > 0").count() == 1


def test_spend_sheet_with_banner_rows(spark, tmp_path):
    lines = ["Advertising spend,,,,,,,,", "all amounts in dollars,,,,,,,,"]
    lines.append("period_idx," + ",".join(PAID_CHANNELS))
    lines += [f"{i}," + ",".join(str(100.5 + i + j) for j in range(8)) for i in range(10)]
    (tmp_path / "spend.csv").write_text("\n".join(lines))
    rows = tables.read_spend(spark, str(tmp_path / "spend.csv")).orderBy("period_idx").collect()
    assert [r.period_idx for r in rows] == list(range(10))
    assert rows[3].facebook == 103.5 and rows[3].referral == 110.5


def test_csv_keeps_keys_and_types(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0.25), (2, 1, None)], schemas.SCORES)
    tables.write_csv(df, f"{tmp_path}/scores")
    back = tables.read_csv(spark, f"{tmp_path}/scores", schemas.SCORES)
    assert sorted(map(tuple, back.collect())) == [(1, 0, 0.25), (2, 1, None)]


def test_materialized_tables_go_to_the_shared_folder(spark):
    df = tables.materialize(spark.range(5))
    base = spark.conf.get("spark.checkpoint.dir")
    assert all(base in name for name in df.inputFiles())
    assert df.count() == 5


def test_dates_survive_the_schema(spark):
    row = (1, dt.datetime(2020, 1, 1), 0, "card", True, 14)
    assert spark.createDataFrame([row], schemas.CUSTOMER).first().num_trial_days == 14
