"""Ratings, costs and confidences as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def vote_rating(weight: Column) -> Column:
    """1500 +- 500 for a weight in [0, 1], rounded to an integer."""
    return (1500 + F.round(500 * (2 * weight - 1))).cast("int")


def folded_vote(rating: Column, n: Column, vote: Column) -> Column:
    """Integer running mean of ``n`` votes and one more."""
    return F.floor((rating * n + vote) / (n + 1)).cast("int")


def mass(rating: Column, observations: Column) -> Column:
    return rating * F.log10(observations + 1)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def edge_cost(rating: Column, observations: Column) -> Column:
    """At least 1: less for well rated and often observed edges."""
    return 1 / (clamp((rating - 800) / 1200, 0.01, 1.0) * clamp(F.log(observations + 1) / F.log(F.lit(1000.0)), 0.01, 1.0))


def feedback_delta(mean_signal: Column, n: Column) -> Column:
    return (mean_signal * 32 * F.least(F.lit(1.0), n / 100)).cast("int")


def path_confidence(rating: Column) -> Column:
    return 1 - 1 / (1 + rating)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def evidence_rating(n: Column, mean_weight: Column, sources: Column) -> Column:
    return 1500 + F.least(F.lit(1000.0), 0.1 * n) + 500 * mean_weight + F.least(F.lit(200.0), 20.0 * sources)


def npmi(joint: Column, left: Column, right: Column) -> Column:
    """Of probabilities; 0 where the joint one is 0 or 1."""
    return F.when((joint <= 0) | (joint >= 1), 0.0).otherwise(F.log2(joint / (left * right)) / -F.log2(joint))
