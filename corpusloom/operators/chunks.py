"""Fixed-size chunks of the token stream of ordered documents, and splits of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.maths import uniform
from ..plans.staging import stage


def check_chunk_arguments(block: int, stride: int) -> None:
    if block < 1:
        raise ValueError("block must be at least 1")
    if not 1 <= stride <= block:
        raise ValueError("stride must be from 1 to block")


def prefix_offsets(df: DataFrame, length: Column, *order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds offset, the sum of the lengths of all rows before, in the order; by: of rows that agree in these columns.

    Rows are dealt by ranges of the order, so that one value of `by` may lie in many ranges; only the sum of each range meets
    in one place, and the running sums are taken within the ranges.
    """
    dealt = stage(df.withColumn("_n", length.cast("long")).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*by, "_range").agg(F.sum("_n").alias("_sum"))
    before = W.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(F.struct("_range", *by).alias("_at"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    own = W.partitionBy("_range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.join(bases, F.struct("_range", *by).eqNullSafe(F.col("_at"))) if by else dealt.join(bases.select("_at._range", "_base"), "_range")
    return placed.withColumn("offset", F.col("_base") + F.coalesce(F.sum("_n").over(own), F.lit(0))).drop("_n", "_range", "_at", "_base")


def with_eos(ids: Column, eos: int) -> Column:
    """ids and the end id; a negative end id adds none."""
    return F.concat(ids, F.array(F.lit(eos))) if eos >= 0 else ids


def chunk_stream(df: DataFrame, block: int, stride: int | None = None, labels: bool = False, *, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """chunk_id, input_ids (and labels): windows of `block` ids every `stride` ids over the ids of all documents in order.

    Each document gives each chunk it reaches one slice, so what is shuffled is slices, not tokens. Chunks that the stream's end
    leaves short are dropped.
    """
    stride = block if stride is None else stride
    check_chunk_arguments(block, stride)
    n = F.size("ids")
    placed = prefix_offsets(df.select(*order, "ids").where(n > 0), n, *order)
    first = F.greatest(F.lit(0), F.ceil((F.col("offset") - block + 1) / stride))
    last = F.floor((F.col("offset") + n - 1) / stride)
    parts = placed.where(last >= first).withColumn("chunk_id", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    start = F.col("chunk_id") * stride
    begin = F.greatest(F.lit(0), start - F.col("offset"))
    end = F.least(n.cast("long"), start + block - F.col("offset"))
    piece = F.struct((F.col("offset") + begin).alias("at"), F.slice("ids", (begin + 1).cast("int"), (end - begin).cast("int")).alias("ids"))
    chunks = parts.where(end > begin).select("chunk_id", piece.alias("piece")).groupBy("chunk_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    chunks = chunks.select("chunk_id", F.flatten(F.col("pieces.ids")).alias("input_ids")).where(F.size("input_ids") == block)
    return chunks.withColumn("labels", F.col("input_ids")) if labels else chunks


def split_chunks(df: DataFrame, block: int, stride: int | None = None, split: str = "split", values: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """Chunks of each split's own stream, with the split as a column."""
    parts = [chunk_stream(df.where(F.col(split) == v), block, stride).withColumn(split, F.lit(v)) for v in values]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chunk_statistics(df: DataFrame, block: int, stride: int | None = None) -> DataFrame:
    """One row in closed form: consumed tokens, examples, dropped tail, largest id."""
    stride = block if stride is None else stride
    check_chunk_arguments(block, stride)
    sums = df.agg(F.coalesce(F.sum(F.size("ids").cast("long")), F.lit(0)).alias("consumed_tokens"), F.max(F.array_max("ids")).alias("max_token_id"))
    made = sums.withColumn("num_examples", F.when(F.col("consumed_tokens") < block, 0).otherwise(F.floor((F.col("consumed_tokens") - block) / stride) + 1).cast("long"))
    return made.withColumn("dropped_tail_tokens", F.col("consumed_tokens") - F.col("num_examples") * stride)


def dataset_profile(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("examples"), F.min(F.size("input_ids")).alias("min_length"), F.max(F.size("input_ids")).alias("max_length"), F.max(F.array_max("input_ids")).alias("max_token_id"))


def check_compatible(chunks: DataFrame, vocab_size: int, block_size: int) -> None:
    r = dataset_profile(chunks).first()
    if not r.examples:
        raise ValueError("the dataset is empty")
    if r.min_length != r.max_length:
        raise ValueError("the dataset's examples differ in length")
    if r.max_token_id >= vocab_size:
        raise ValueError(f"vocab_size {vocab_size} does not hold token id {r.max_token_id}")
    if r.max_length > block_size:
        raise ValueError(f"block_size {block_size} is less than the examples' length {r.max_length}")


def bernoulli_split(df: DataFrame, fraction: float = 0.05, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """Adds split: each document goes to validation by a draw of its own."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction must be between 0 and 1")
    return df.withColumn("split", F.when(uniform(seed, F.col(key)) < fraction, "validation").otherwise("train"))


def exact_split(df: DataFrame, fraction: float, seed: int = 0, key: str = "doc_id", zero: bool = False) -> DataFrame:
    """Adds split: max(1, int(n f)) rows, n - 1 at most, with the smallest draws go to validation.

    zero: with fraction 0 or under two rows all rows are in both splits; else under two rows are an error.
    """
    n = df.count()
    if zero and (fraction == 0 or n < 2):
        return df.withColumn("split", F.explode(F.array(F.lit("train"), F.lit("validation"))))
    if n < 2:
        raise ValueError("At least two rows are needed for a split")
    k = min(n - 1, max(1, int(n * fraction)))
    placed = prefix_offsets(df.withColumn("_u", uniform(seed, F.col(key))), F.lit(1), "_u", key)
    return placed.withColumn("split", F.when(F.col("offset") < k, "validation").otherwise("train")).drop("_u", "offset")


def shuffled(df: DataFrame, epoch: int, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """Rows in the order of an epoch's draws."""
    return df.withColumn("u", uniform(seed, F.lit(epoch), F.col(key))).orderBy("u", key)


def packing_statistics(df: DataFrame, lines: Column, packed: Column) -> DataFrame:
    """One row: input, output and split lines, and the most characters of each."""
    rows = df.select(lines.alias("line"), packed.alias("packed")).where(F.size("packed") > 0)
    flat = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    most = F.array_max(F.transform("packed", F.length))
    return rows.agg(
        F.count("*").alias("input_lines"), F.coalesce(F.sum(F.size("packed").cast("long")), F.lit(0)).alias("output_lines"), F.count(F.when(F.size("packed") > 1, 1)).alias("split_lines"),
        F.coalesce(F.max(F.length(flat)), F.lit(0)).alias("max_input_chars"), F.coalesce(F.max(most), F.lit(0)).alias("max_output_chars"),
    )
