"""Schedules, losses and probabilities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def learning_rate(step: Column, total: int, base: float, least: float, warmup: int, kind: str = "cosine") -> Column:
    """Linear warm-up, then cosine to the floor or constant."""
    if kind not in ("cosine", "constant"):
        raise ValueError("kind must be cosine or constant")
    progress = F.least(F.greatest((step - warmup) / F.lit(float(max(1, total - warmup))), F.lit(0.0)), F.lit(1.0))
    after = F.lit(base) if kind == "constant" else F.lit(least) + F.lit(base - least) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress))
    return F.when(step <= warmup, F.lit(base) * step / F.lit(float(warmup))).otherwise(after) if warmup > 0 else after


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def preference_loss(policy_margin: Column, reference_margin: Column, beta: float) -> Column:
    return softplus(-(policy_margin - reference_margin) * beta)


def masked_sum(values: Column, mask: Column) -> Column:
    """Sum of the values where the mask is true; an empty mask is an error."""
    kept = F.zip_with(values, mask, lambda v, m: F.when(m, v).otherwise(0.0))
    total = F.aggregate(kept, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.exists(mask, lambda m: m), total).otherwise(F.raise_error(F.lit("a completion has no tokens")).cast("double"))


def candidate_score(frequency: Column, length: Column, alpha: float, beta: float, epsilon: float) -> Column:
    return F.lit(alpha) * F.ln(frequency + epsilon) + F.lit(beta) * length


def uniform(seed: int, *keys: Column) -> Column:
    """A draw from [0, 1) that hangs on the seed and the keys alone, so that any partitioning agrees."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def percentage(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(0.0)
