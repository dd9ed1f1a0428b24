"""Acquisition cost, end to end: sign-ups, known share, scaled spend, cost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from subsight.operators import acquisition as acq


@dataclass(frozen=True)
class AcquisitionCost:
    """Every table of the cost analysis; each is lazy and small."""

    signups: DataFrame
    acquired: DataFrame
    share: DataFrame
    spend: DataFrame
    cost: DataFrame
    cost_paid: DataFrame


def acquisition_cost(customer: DataFrame, subscribers: DataFrame, spend: DataFrame) -> AcquisitionCost:
    """Cost per person for all subscribers and for payers, from one count of subscribers."""
    signups = acq.signups_by_tier(customer)
    acquired = acq.acquisition(subscribers)
    share = acq.known_share(acquired, signups)
    scaled = acq.scaled_spend(spend, share)
    return AcquisitionCost(
        signups=signups,
        acquired=acquired,
        share=share,
        spend=scaled,
        cost=acq.cost_per_person(scaled, acquired),
        cost_paid=acq.cost_per_person(scaled, acquired, people="n_paid"),
    )
