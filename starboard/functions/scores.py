"""Ranking scores."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def bayesian_score(average: Column, count: Column, m: int, prior: Column) -> Column:
    """The item's average, pulled to the prior as if m ratings of it had been added."""
    weight = count / (count + F.lit(m))
    return weight * average + (F.lit(m) / (count + F.lit(m))) * prior


def log_blend_score(average: Column, count: Column) -> Column:
    """0.7 of the average plus 0.3 of the natural logarithm of (count + 1)."""
    return average * 0.7 + F.log1p(count) * 0.3
