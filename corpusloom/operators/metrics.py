"""Training logs: running minima, throughput, threshold crossings and groups of batches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunks import prefix_offsets

# 1M to 10M by 1M, then 20M to 100M by 10M.
CHECKPOINT_TARGETS = [k * 1_000_000 for k in (*range(1, 11), *range(20, 101, 10))]


def running_minimum(df: DataFrame, value: str, order: str, *partition: str) -> DataFrame:
    """Adds best, the least value so far, and improved: whether this row is below all before it."""
    past = W.partitionBy(*partition).orderBy(order)
    before = F.min(value).over(past.rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("improved", before.isNull() | (F.col(value) < before)).withColumn("best", F.least(before, value))


def throughput(df: DataFrame, tokens: str, ts: str, *partition: str) -> DataFrame:
    """Adds tokens_per_second: tokens since the row before over the seconds between; null for a first row."""
    past = W.partitionBy(*partition).orderBy(ts, tokens)
    at = F.col(ts).cast("timestamp").cast("double")
    seconds = at - F.lag(at).over(past)
    return df.withColumn("tokens_per_second", F.when(seconds > 0, (F.col(tokens) - F.lag(tokens).over(past)) / seconds))


def checkpoints(steps: DataFrame, tokens: str, step: str, *partition: str, targets: list[int] | None = None) -> DataFrame:
    """A row for each target that a step is the first to reach, with its name; several may fall on one step."""
    seen = prefix_offsets(steps, F.col(tokens), step, by=partition).withColumnRenamed("offset", "before")
    seen = seen.withColumn("seen", F.col("before") + F.col(tokens))
    goals = F.array(*[F.lit(t).cast("long") for t in targets or CHECKPOINT_TARGETS])
    hit = F.filter(goals, lambda t: (t <= F.col("seen")) & (t > F.col("before")))
    rows = seen.select(*partition, step, "seen", F.explode(hit).alias("target"))
    return rows.withColumn("name", F.concat(F.lit("chck_"), F.floor(F.col("target") / 1_000_000).cast("string"), F.lit("M")))


def pending(targets: DataFrame, saved: DataFrame) -> DataFrame:
    """Targets that are not saved yet."""
    return targets.join(saved, "target", "left_anti")


def accumulation_groups(df: DataFrame, size: int, order: str, *partition: str) -> DataFrame:
    """Adds step, the group of `size` batches in order, and weight, one over the group's own number of batches."""
    made = prefix_offsets(df, F.lit(1), order, by=partition).withColumn("step", F.floor(F.col("offset") / size) + 1).drop("offset")
    return made.withColumn("weight", F.lit(1.0) / F.count("*").over(W.partitionBy(*partition, "step")))


def mean_or_zero(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.count(value).alias("batches"))


def parameter_count(shapes: list[tuple[int, ...]]) -> int:
    """How many numbers tensors of these shapes hold."""
    return sum(math.prod(s) for s in shapes)


def steps_per_epoch(batches: int, accumulation: int) -> int:
    return -(-batches // accumulation)
