"""Next-token choices from scored candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.maths import uniform


def softmax(rows: DataFrame, temperature: float = 1.0, top_k: int | None = None, *, by: str = "step", score: str = "logit") -> DataFrame:
    """Adds p: the stable softmax of each group's scores over the temperature; with top_k all that tie with the k-th stay in."""
    group = W.partitionBy(by)
    if top_k is not None:
        rows = rows.withColumn("_rank", F.rank().over(group.orderBy(F.desc(score)))).where(F.col("_rank") <= top_k).drop("_rank")
    made = rows.withColumn("_z", F.exp((F.col(score) - F.max(score).over(group)) / temperature))
    return made.withColumn("p", F.col("_z") / F.sum("_z").over(group)).drop("_z")


def choose(rows: DataFrame, temperature: float = 1.0, top_k: int | None = None, seed: int = 0, *, by: str = "step", token: str = "token", score: str = "logit") -> DataFrame:
    """One row of each group: the best (smallest token in a tie) at temperature 0 or less, else one drawn by its probability.

    The draw is keyed by seed and group; tokens stand in their order, and the last one takes what rounding leaves.
    """
    group = W.partitionBy(by)
    if temperature <= 0:
        return rows.withColumn("_n", F.row_number().over(group.orderBy(F.desc(score), token))).where("_n = 1").drop("_n")
    ordered = group.orderBy(token)
    drawn = softmax(rows, temperature, top_k, by=by, score=score).withColumn("_sum", F.sum("p").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    drawn = drawn.withColumn("_last", F.lead(token).over(ordered).isNull()).where((F.col("_sum") > uniform(seed, F.col(by))) | F.col("_last"))
    return drawn.withColumn("_n", F.row_number().over(ordered)).where("_n = 1").drop("_n", "_sum", "_last")
