"""Preference records: checks, candidate filters, padded batches and the preference loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..functions.maths import masked_sum, preference_loss, uniform

FIELDS = ("prompt", "chosen", "rejected")
ID_FIELDS = ("prompt_ids", "chosen_ids", "rejected_ids")


def violations(records: DataFrame, key: str) -> DataFrame:
    """key, rule: a row for each rule that a record breaks."""
    rules = [F.when(F.col(f).isNull(), f"{f} is missing").when(T.is_blank(F.col(f)), f"{f} is blank") for f in FIELDS]
    same = T.collapse_spaces(F.col("chosen")) == T.collapse_spaces(F.col("rejected"))
    rules.append(F.when(same, "chosen equals rejected"))
    rules += [F.when(~A.valid_ids(F.col(f)), f"{f} has bad ids") for f in ID_FIELDS if f in records.columns]
    return records.select(key, F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("rule"))


def require_valid(records: DataFrame, key: str) -> None:
    if records.isEmpty():
        raise ValueError("there are no preference records")
    bad = violations(records, key).orderBy(key, "rule").limit(5).collect()
    if bad:
        raise ValueError("bad preference records: " + "; ".join(f"{r[key]}: {r.rule}" for r in bad))


def accepted(candidates: DataFrame, key: str, order: str) -> DataFrame:
    """Rejected candidates that may stand: ids, well-formed, not blank, other than chosen, and the first of equal ones for a prompt."""
    text = T.collapse_spaces(F.col("rejected"))
    rows = candidates.withColumn("_text", text).where((F.size("rejected_ids") > 0) & ~F.col("rejected").rlike(T.MALFORMED) & (text != ""))
    rows = rows.where((F.col("rejected_ids") != F.col("chosen_ids")) & (text != T.collapse_spaces(F.col("chosen"))))
    first = W.partitionBy(key, "_text").orderBy(order)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_text")


def long_enough(df: DataFrame, ids: str = "ids", least: int = 4) -> DataFrame:
    return df.where(F.size(ids) >= least)


def prompt_and_chosen(df: DataFrame, seed: int, key: str, ids: str = "ids") -> DataFrame:
    """Adds prompt_ids and chosen_ids: the ids cut at 30 to 50 per cent by a draw of their own."""
    at = A.split_at(F.col(ids), uniform(seed, F.col(key)))
    return df.withColumn("_at", at).withColumn("prompt_ids", F.slice(ids, F.lit(1), F.col("_at"))).withColumn("chosen_ids", F.slice(ids, F.col("_at") + 1, F.size(ids) - F.col("_at"))).drop("_at")


def batches(df: DataFrame, side: str, most: int, size: int, order: str, pad_id: int = 0, start_id: int = 2) -> DataFrame:
    """batch, order, input_ids, attention_mask, completion_mask: prompt and completion joined and padded to the longest of a batch.

    Rows need a column n, their place from 0; an empty prompt starts with the start id.
    """
    prompt = F.when(F.size("prompt_ids") == 0, F.array(F.lit(start_id))).otherwise(F.col("prompt_ids"))
    made = df.select(F.floor(F.col("n") / size).alias("batch"), order, A.prompt_and_completion(prompt, F.col(f"{side}_ids"), most).alias("x"))
    longest = F.max(F.size("x.ids")).over(W.partitionBy("batch"))
    made = made.withColumn("longest", longest)
    return made.select("batch", order, A.pad(F.col("x.ids"), F.lit(pad_id), F.col("longest")).alias("input_ids"), A.attention(F.col("x.ids"), F.col("longest")).alias("attention_mask"), A.pad(F.col("x.mask"), F.lit(False), F.col("longest")).alias("completion_mask"))


def completion_log_probability(log_probabilities: Column, mask: Column) -> Column:
    return masked_sum(log_probabilities, mask)


def pad_id(pad: int, eos: int, unk: int, bos: int) -> int:
    """The first of these that is not negative, else 0."""
    return next((x for x in (pad, eos, unk, bos) if x >= 0), 0)


def accuracy(pairs: DataFrame, beta: float = 0.1) -> DataFrame:
    """One row over (policy_chosen, policy_rejected, reference_chosen, reference_rejected): accuracy, mean margin, mean loss, count."""
    margin = F.col("policy_chosen") - F.col("policy_rejected")
    loss = preference_loss(margin, F.col("reference_chosen") - F.col("reference_rejected"), beta)
    return pairs.agg(F.avg((margin > 0).cast("double")).alias("accuracy"), F.avg(margin).alias("mean_margin"), F.avg(loss).alias("mean_loss"), F.count("*").alias("pairs"))
