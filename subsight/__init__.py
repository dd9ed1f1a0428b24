"""Subscription-marketing analytics as Spark DataFrame operators."""
