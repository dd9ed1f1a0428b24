"""Trial churn to lifetime value, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame

from subsight.functions.tiers import assign_tier
from subsight.operators import clv as value
from subsight.operators import engagement as eng
from subsight.operators import prep
from subsight.sources.tables import materialize


def merged(subscribers: DataFrame, engagement: DataFrame) -> DataFrame:
    """Engaged subscribers with trial features and the churn label, columns as they come.

    Having features implies having engagement, so the semi-join on engagement
    is left out here.
    """
    features = eng.engagement_features(engagement)
    return eng.churn_label(eng.merge_features(subscribers, features))


def prepared_subscribers(subscribers: DataFrame, engagement: DataFrame) -> DataFrame:
    """Engaged subscribers, sparse and unused columns dropped, categories filled.

    Written before the looks at NULL shares and frequencies, so that the
    engagement table is read once and not for each of them.
    """
    engaged = materialize(eng.engaged_only(subscribers, engagement))
    return prep.impute_by_frequency(prep.drop_unused(prep.prune_null_columns(engaged)))


def modelling_table(subscribers: DataFrame, engagement: DataFrame) -> DataFrame:
    """Prepared subscribers with trial features and the churn label."""
    ready = prepared_subscribers(subscribers, engagement)
    return eng.churn_label(eng.merge_features(ready, eng.engagement_features(engagement)))


def valued(people: DataFrame, cost: DataFrame, scores: DataFrame) -> DataFrame:
    """Tier, cost, churn probability and lifetime value of each subscriber."""
    costed = value.assign_cac(assign_tier(people), cost)
    return value.clv(value.attach_probability(costed, scores), value.mean_payment(people))
