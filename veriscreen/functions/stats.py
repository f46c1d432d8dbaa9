"""Statistics as column expressions; undefined results are null, never NaN."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_value(confidence: float) -> float:
    if not 0 < confidence < 1:
        raise ValueError("confidence level must be between 0 and 1")
    return NormalDist().inv_cdf(1 - (1 - confidence) / 2)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(successes: Column, total: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Wilson score interval, within 0 and 1; null without trials."""
    z = z_value(confidence)
    n, p = total.cast("double"), ratio(successes, total)
    spread = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    scale, middle = 1 + F.lit(z * z) / n, p + F.lit(z * z) / (2 * n)
    valid = total > 0
    return F.when(valid, F.greatest(F.lit(0.0), (middle - spread) / scale)), F.when(valid, F.least(F.lit(1.0), (middle + spread) / scale))


def normal_interval(mean: Column, error: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    z = z_value(confidence)
    return mean - z * error, mean + z * error


def cohens_d(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> Column:
    """Difference in units of the pooled standard deviation; null below two values a side or without spread."""
    pooled = F.try_divide((n_a - 1) * var_a + (n_b - 1) * var_b, (n_a + n_b - 2).cast("double"))
    return F.when((n_a > 1) & (n_b > 1) & (pooled > 0), (mean_a - mean_b) / F.sqrt(pooled))


def softmax_positive(logit0: Column, logit1: Column) -> Column:
    """Probability of class 1 of two logits."""
    return 1 / (1 + F.exp(logit0 - logit1))
