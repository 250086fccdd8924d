"""Filters, limits, counts and rankings of corpus items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .chunks import prefix_offsets


def allow_list(df: DataFrame, **allowed: list | None) -> DataFrame:
    """Rows whose columns hold one of the allowed values each; null is not allowed where a list is given."""
    for column, values in allowed.items():
        if values is not None:
            df = df.where(F.col(column).isin(values))
    return df


def text_only(df: DataFrame, id_column: str = "doc-id") -> DataFrame:
    return df.select(F.col(f"`{id_column}`").alias("doc_id"), "text")


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order: a limit on what the filters before it left."""
    return df.orderBy(*order).limit(n)


def first_kept(df: DataFrame, n: int, keep: Column, *order: str) -> tuple[DataFrame, DataFrame]:
    """Of the first n rows those that are kept, and one row of counts: seen, kept, skipped. Skipped rows count towards n."""
    seen = first_n(df, n, *order)
    counts = seen.agg(F.count("*").alias("seen"), F.count(F.when(keep, 1)).alias("kept"))
    return seen.where(keep), counts.withColumn("skipped", F.col("seen") - F.col("kept"))


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*(F.when(~T.is_blank(c), c) for c in columns))


def not_blank(df: DataFrame, column: str = "text") -> DataFrame:
    return df.where(~T.is_blank(F.col(column)))


def token_total(df: DataFrame, epochs: int = 1) -> DataFrame:
    total = F.coalesce(F.sum(F.size(T.words(F.col("text"))).cast("long")), F.lit(0))
    return df.select("text").agg(F.count("*").alias("documents"), total.alias("tokens")).withColumn("training_tokens", F.col("tokens") * epochs)


def items(df: DataFrame, tokens: Column, order: str = "doc_id") -> DataFrame:
    """A row for each item with its place: the order column, pos, item."""
    return df.select(order, F.posexplode(tokens).alias("pos", "item"))


def place(order: str, pos: str = "pos") -> Column:
    """A row's place as one number, by which a hash aggregate can keep the first; a pair would make it sort all rows."""
    return F.col(order).cast("decimal(19,0)") * F.lit(2**32).cast("decimal(10,0)") + F.col(pos).cast("decimal(10,0)")


def first(order: str, pos: str = "pos") -> Column:
    """The least place of a group, as an aggregate. Orders of 32 bits are compared as whole numbers, which are far cheaper than decimals."""
    few = F.col(order).between(-(2**31), 2**31 - 1)
    near = F.min(F.when(few, F.col(order).cast("long") * F.lit(2**32) + F.col(pos)))
    return F.least(near.cast("decimal(31,0)"), F.min(F.when(~few, place(order, pos))))


def first_place(column: str) -> tuple[Column, Column]:
    """The order and the position that a place stands for."""
    pos = F.expr(f"pmod({column}, 4294967296)")
    return F.expr(f"({column} - pmod({column}, 4294967296)) div 4294967296"), pos.cast("int")


def classified_counts(rows: DataFrame, order: str = "doc_id") -> DataFrame:
    """Class, item, cnt and the first place of each item (first_doc, first_pos), which settles ties by first seen."""
    counted = rows.groupBy("item").agg(F.count("*").alias("cnt"), first(order).alias("first"))
    return _classified(counted)


def _made(x: Column) -> Column:
    """x, made by a generator: filters on it stay above, where else they would be pushed below the counting and make it for each token."""
    return F.explode(F.array(x))


def _classified(counted: DataFrame) -> DataFrame:
    doc, pos = first_place("first")
    return counted.select(_made(T.item_class(F.col("item"))).alias("class"), "item", "cnt", doc.alias("first_doc"), pos.alias("first_pos"))


def routed_counts(raw: DataFrame, order: str = "doc_id") -> DataFrame:
    """classified_counts of what lexed tokens (order, pos, item) become.

    What a token becomes hangs on its spelling alone, so tokens are counted as they stand, and only the different ones are
    routed and classified. first_pos is the place among all lexed tokens, which orders items as the place among the kept ones does.
    """
    counted = raw.groupBy("item").agg(F.count("*").alias("cnt"), first(order).alias("first"))
    routed = counted.select(_made(T.route(F.col("item"))).alias("item"), "cnt", "first").where("item is not null")
    return _classified(routed.groupBy("item").agg(F.sum("cnt").alias("cnt"), F.min("first").alias("first")))


def kept_positions(counts: DataFrame, raw: DataFrame, order: str = "doc_id") -> DataFrame:
    """routed_counts with first_pos as the place among the kept tokens: less the dropped ones before it in its document.

    A token of visible ASCII characters alone is never dropped, so that only the others are routed here.
    """
    dropped = raw.where(~F.col("item").rlike("^[!-~]+$") & T.route(F.col("item")).isNull()).select(F.col(order).alias("first_doc"), F.col("pos").alias("first_pos"), F.lit(None).cast("string").alias("item"))
    marked = counts.unionByName(dropped, allowMissingColumns=True)
    before = W.partitionBy("first_doc").orderBy("first_pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    lost = F.count(F.when(F.col("item").isNull(), 1)).over(before)
    return marked.withColumn("first_pos", (F.col("first_pos") - lost).cast("int")).where("item is not null")


def corpus_statistics(counts: DataFrame) -> DataFrame:
    """One row: items in all, distinct and by class, and distinct encoded words of several atoms."""
    kinds = ("special", "encoded", "preserved", "invalid")
    of = lambda k, x: F.coalesce(F.sum(F.when(F.col("class") == k, x)), F.lit(0))
    return counts.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_items"), F.count("*").alias("unique_items"),
        *(of(k, F.col("cnt")).alias(f"{k}_occurrences") for k in kinds), *(of(k, F.lit(1)).alias(f"{k}_unique") for k in kinds),
        F.count(F.when((F.col("class") == "encoded") & (T.atom_count(F.col("item")) > 1), 1)).alias("multi_atom_unique"),
    )


def most_common(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent; ties by first seen."""
    return counts.orderBy(F.desc("cnt"), "first_doc", "first_pos").limit(n)


def first_examples(rows: DataFrame, kind: str, n: int, order: str = "doc_id") -> DataFrame:
    return rows.where(T.item_class(F.col("item")) == kind).orderBy(order, "pos").limit(n)


def ordered_distinct(rows: DataFrame, order: str = "doc_id") -> DataFrame:
    """item, ord: distinct items numbered from 0 in the order they are first seen."""
    return numbered(rows.groupBy("item").agg(first(order).alias("first")), "first")


def numbered(items_: DataFrame, *order: str) -> DataFrame:
    """item, ord: rows numbered from 0 in an order."""
    return prefix_offsets(items_, F.lit(1), *order).select("item", F.col("offset").alias("ord"))


def head_and_tail(ranked: DataFrame, k: int, *order: tuple[str, bool]) -> DataFrame:
    """The first k and the last k rows of a ranking by (column, ascending) pairs, with end telling which."""
    by = lambda turned: [F.asc(c) if up != turned else F.desc(c) for c, up in order]
    ends = [ranked.orderBy(*by(turned)).limit(k).withColumn("end", F.lit(end)) for end, turned in (("head", False), ("tail", True))]
    return ends[0].unionByName(ends[1])


def top_with_ties(df: DataFrame, k: int, by: str, *partition: str) -> DataFrame:
    """Rows at or above each group's k-th value, all that tie with it included."""
    return df.withColumn("rank", F.rank().over(W.partitionBy(*partition).orderBy(F.desc(by)))).where(F.col("rank") <= k)
