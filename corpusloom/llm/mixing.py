"""Mixing sources to target weights by weighted pivotal rounding, in DataFrame expressions alone.

A source's target over its size is the expected number of copies of each of its documents. Its whole part is certain;
the fractions are rounded dependently. Units are dealt into blocks of bounded expected size by a keyed hash, and each block
folds over its units, largest first: the carried unit and the next one are a pair, and probability moves between them,
weighed by their sizes so that the block's expected words stay exactly as they are, until one of the two is 0 or 1. The
direction is drawn by a keyed hash with the odds that leave each unit's expectation unchanged. What a block can't decide
is one unit; these residuals are dealt into blocks again, level after level, until each source has one block. Its last
unit is rounded, and the words this leaves missing or in excess are made up by flipping units of that block that fit, so
a source's words differ from its target by less than half a document, and mostly by a few words.

Sources are ordered by code point, null last, and null is a source of its own. Null texts have size 0; such units are
taken by the whole part of their ratio. Rows equal in id, source and size are one unit and get the same number of copies.
An empty table gives an empty result; all draws hang on the seed and the id, so that reruns and any partitioning agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import WORD, documents, scoped, staged

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Expected units of a block.
BLOCK = 128
#: Source tables up to this many rows are broadcast (a row is a name and four numbers); larger ones are joined by a shuffle.
BROADCAST_SOURCES = 2_000


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds target to a table (source, source_size): share of all sizes by weight, at most `most` times a source's size.

    The level is found by water-filling: with the sources in the order of size over weight, the level that the rest would
    reach once the first k are full rises while these are truly full and then falls, so its maximum is the level. The table has one row for each source; only it, never the documents, is ordered as a whole.
    """
    everything = W.partitionBy(F.lit(0))
    placed = sources.withColumn("n", F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("n") - 1) % len(weights) + 1)
    filled = everything.orderBy("edge", "n").rowsBetween(W.unboundedPreceding, -1)
    return (
        placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("edge", F.col("cap") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(everything) * share)
        .withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))))
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))
    )


def _uniform(seed: int, *parts: str) -> str:
    return f"(pmod(xxhash64({', '.join([str(seed), *parts])}), 9007199254740992) / 9007199254740992D)"


def _folded(seed: int, level: int) -> Column:
    """Folds an array `units` of (w, id, size, p) into done, an array of (id, size, w, p) with p 0 or 1, and the unit carried."""
    draw = _uniform(seed, str(level), "s.id", "s.size", "u.id", "u.size")
    up, down = "least(1 - s.p, u.p * u.w / s.w)", "least(s.p, (1 - u.p) * u.w / s.w)"
    step = f"""
      CASE WHEN s.w IS NULL THEN named_struct('done', s.done, 'w', u.w, 'id', u.id, 'size', u.size, 'p', u.p) ELSE
      element_at(transform(array(named_struct('a', {up}, 'b', {down})), m ->
        element_at(transform(array(if({draw} * (m.a + m.b) < m.b,
            named_struct('p', if(m.a >= 1 - s.p, 1D, s.p + m.a), 'q', if(m.a >= 1 - s.p, u.p - m.a * s.w / u.w, 0D)),
            named_struct('p', if(m.b >= s.p, 0D, s.p - m.b), 'q', if(m.b >= s.p, u.p + m.b * s.w / u.w, 1D)))), r ->
          if(r.p = 0 OR r.p = 1,
            named_struct('done', concat(s.done, array(named_struct('w', s.w, 'id', s.id, 'size', s.size, 'up', CAST(r.p AS int)))), 'w', u.w, 'id', u.id, 'size', u.size, 'p', least(1D, greatest(0D, r.q))),
            named_struct('done', concat(s.done, array(named_struct('w', u.w, 'id', u.id, 'size', u.size, 'up', CAST(r.q AS int)))), 'w', s.w, 'id', s.id, 'size', s.size, 'p', r.p))), 1)), 1) END"""
    start = "named_struct('done', CAST(array() AS array<struct<w: double, id: bigint, size: bigint, up: int>>), 'w', CAST(NULL AS double), 'id', CAST(NULL AS bigint), 'size', CAST(NULL AS bigint), 'p', CAST(NULL AS double))"
    return F.expr(f"aggregate(units, {start}, (s, u) -> {step})")


def _settled() -> Column:
    """What a source's last block decides, its carried unit included: that unit is rounded either way, units that fit into
    the words then missing (or in excess) are flipped, largest first, and the way that ends nearer is taken."""

    def way(up: int) -> str:
        rest = f"f.w * {'(1 - f.p)' if up else 'f.p'}"
        flip = f"named_struct('rest', s.rest - d.w, 'out', concat(s.out, array(named_struct('w', d.w, 'id', d.id, 'size', d.size, 'up', {1 - up}))))"
        keep = "named_struct('rest', s.rest, 'out', concat(s.out, array(d)))"
        own = f"array(named_struct('w', f.w, 'id', f.id, 'size', f.size, 'up', {up}))"
        return f"aggregate(sort_array(f.done, false), named_struct('rest', {rest}, 'out', {own}), (s, d) -> if(d.up = {up} AND d.w <= s.rest, {flip}, {keep}))"

    return F.expr(f"if(f.w IS NULL, f.done, element_at(transform(array(named_struct('a', {way(0)}, 'b', {way(1)})), x -> if(x.a.rest <= x.b.rest, x.a.out, x.b.out)), 1))")


@scoped
def plan_copies(rows: DataFrame, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """From rows (doc_id, source, size) one row for each unit: these, rows (how many it stands for), source_size, target, copies."""
    units = staged(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "units")
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("units"))
    sums = staged(sums, "sources")
    wanted = staged(targets(sums.select("source", "source_size"), weights, share, most).join(sums.select(F.col("source").alias("s"), "units"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    table = wanted.withColumnRenamed("source", "s").withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    if wanted.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    spread = staged(units.join(table, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("whole", F.floor("ratio")), "spread")
    p = F.col("ratio") - F.col("whole")
    open_ = spread.where((F.col("size") > 0) & (p > 0)).select("source", "units", F.col("doc_id").alias("id"), "size", (F.col("size") * F.col("rows")).cast("double").alias("w"), p.alias("p"))

    decided, level, most_units = None, 0, wanted.agg(F.max("units")).first()[0] or 0
    while True:  # as many rounds as levels: the logarithm of the largest source's units
        blocks = F.greatest(F.lit(1), F.ceil(F.col("units") / F.lit(float(block) ** (level + 1)))).cast("long")
        place = F.pmod(F.xxhash64(F.lit(seed), F.lit(-1 - level), "id", "size"), blocks)
        unit = F.struct((-F.col("w")).alias("order"), F.xxhash64("id").alias("tie"), "id", "size", "w", "p")
        grouped = open_.groupBy("source", "units", place.alias("block")).agg(F.sort_array(F.collect_list(unit)).alias("units_"))
        folded = grouped.withColumn("units_", F.expr("transform(units_, x -> named_struct('w', x.w, 'id', x.id, 'size', x.size, 'p', x.p))"))
        folded = staged(folded.withColumnRenamed("units", "total").withColumnRenamed("units_", "units").withColumn("f", _folded(seed, level)).select("source", F.col("total").alias("units"), "f"), "folded")
        level += 1
        last = F.col("units") <= F.lit(float(block) ** level)  # the source had one block here
        done = folded.select("source", F.explode(F.when(last, _settled()).otherwise(F.col("f.done"))).alias("d")).select("source", "d.id", "d.size", "d.up")
        decided = done if decided is None else decided.union(done)
        if most_units <= block**level:
            break
        left = folded.where(~last & F.col("f.w").isNotNull()).select("source", "units", "f.id", "f.size", "f.w", "f.p")
        decided = decided.union(left.where("p in (0, 1)").select("source", "id", "size", F.col("p").cast("int").alias("up")))
        open_ = left.where("p not in (0, 1)")

    up = decided.select(F.col("source").alias("s"), F.col("id"), F.col("size").alias("z"), "up")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    return spread.join(up, same, "left").select("doc_id", "source", "size", "rows", "source_size", "target", (F.col("whole") + F.coalesce("up", F.lit(0))).cast("long").alias("copies"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__loom_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


@scoped
def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row of docs as often as it is taken, with its own columns."""
    rows = sized(docs)
    plan = plan_copies(rows.select(F.col("doc_id").cast("long"), "source", F.col("__loom_size").alias("size")), **options)
    taken = staged(plan.where("copies > 0").select(F.col("doc_id").alias("__loom_id"), F.col("source").alias("__loom_source"), F.col("size").alias("__loom_sized"), F.col("copies").alias("__loom_copies")), "taken")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__loom_id")) & F.col("source").eqNullSafe(F.col("__loom_source")) & (F.col("__loom_size") == F.col("__loom_sized"))
    return rows.join(taken.hint("merge"), same).select(*(rows[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col("__loom_copies"))).alias("__loom_copy")).drop("__loom_copy")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sized(documents(spark, sf_dir)).select("doc_id", "source", F.col("__loom_size").alias("size"))
    plan = plan_copies(rows).withColumn("taken", F.col("copies") * F.col("size"))
    return plan.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row")).drop("row")
