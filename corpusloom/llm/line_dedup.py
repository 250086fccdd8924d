"""Line deduplication within one edit, in DataFrame expressions alone.

A line is dropped if it occurred before, or if an earlier line (by the first place it occurs: doc_id, nulls first, then
position) is within one inserted, deleted or replaced character of it. Lines shorter than 20 characters are compared
exactly; lines without a word are left alone. A document keeps its other lines in order.

Equal lines are one row. For the others: with a threshold of one edit a line falls into two segments, and whatever the
edit, one of them stays as it is; its place is known from the length of the shorter line. So each line of length L is
indexed by its length and each segment, and is a probe for lines of length L - 1 with the segments that such a line would
have, shifted behind the edit. Buckets with very many members are not paired off: their lines are indexed again with
sixteen segments, where all but one must stay, and those still crowded with one segment for each character, where
only lines that truly differ by a character meet. A pair within one edit meets at each of these levels, so none is lost.
Candidates are verified by a banded bit-parallel automaton: one word for each number of edits, whose bits are the
diagonals of the band.

Null texts stay null and have no lines. Rows equal in doc_id and text are one document and keep the same lines; rows that
share only a doc_id are ordered by their text's hash. Other columns are passed through. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, scoped, staged

EDITS, MIN_CHARS = 1, 20
LINES, DROPPED = "__loom_lines", "__loom_dropped"
#: Segments at each level; None: one for each character.
LEVELS = (2, 16, None)
#: Buckets with more members than this go on to the next level.
CROWD = 24
#: Tables up to so many rows (of at most 64 bytes) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A staged table, broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if limit is None else limit) else df


def edit_distance(a: str, b: str, most: int = EDITS) -> Column:
    """Edits between two string columns, null if over `most`.

    Word e of the state has bit d set if the first j characters of b and the first j + d - most of a are e edits apart or
    less. A match stays on its diagonal, a replacement too, an insertion goes one down and a deletion one up.
    """
    band = 2 * most + 1
    full = (1 << band) - 1
    bits = " + ".join(f"if(get(x, j + {d - most}) <=> get(y, j) AND j + {d - most} >= 0, {1 << d}, 0)" for d in range(band))
    words = ["s.r0 & m"]
    for e in range(1, most + 1):
        words.append(f"((s.r{e} & m) | s.r{e - 1} | shiftright(s.r{e - 1}, 1) | shiftleft({words[-1]}, 1)) & {full}")
    start = ", ".join(f"'r{e}', {sum(1 << (most + k) for k in range(e + 1) if most + k < band)}" for e in range(most + 1))
    step = ", ".join(f"'r{e}', {w}" for e, w in enumerate(words))
    end = f"(length({a}) - length({b}) + {most})"
    return F.expr(f"""
      CASE WHEN abs(length({a}) - length({b})) > {most} THEN NULL WHEN length({b}) = 0 THEN length({a}) ELSE
      element_at(transform(array(struct(split({a}, '') AS x, split({b}, '') AS y)), p ->
        aggregate(transform(sequence(0, size(p.y) - 1), j -> {bits.replace("get(x", "get(p.x").replace("get(y", "get(p.y")}), named_struct({start}), (s, m) -> named_struct({step}),
          s -> CASE {" ".join(f"WHEN shiftright(s.r{e}, {end}) & 1 = 1 THEN {e}" for e in range(most + 1))} END)), 1) END""")


def _keys(segments: int | None, shift: int) -> Column:
    """Keys of `line` as one of length L = size - shift: for each segment, of what stands before and behind it."""
    n = f"(chars - {shift})"
    k = str(segments) if segments else n
    start = f"((o - 1) * ({n} div {k}) + greatest(0, o - 1 - ({k} - {n} % {k})))"
    end = f"(o * ({n} div {k}) + greatest(0, o - ({k} - {n} % {k})))"
    key = f"xxhash64({n}, o, substring(line, 1, {start}), substring(line, {end} + {1 + shift}))"
    if segments and segments <= 4:
        return F.expr("array(" + ", ".join(key.replace("o - ", f"{o} - ").replace("(o *", f"({o} *").replace(", o,", f", {o},") for o in range(1, segments + 1)) + ")")
    return F.expr(f"transform(sequence(1, {k}), o -> {key})")


def _candidates(lines: DataFrame, level: int = 0, crowd: int = CROWD, limit: int | None = None) -> DataFrame:
    """Pairs (a, b) of line ids that may be within one edit, from lines (id, line, chars)."""
    rows = lines.select("id", F.lit(False).alias("longer"), F.explode(_keys(LEVELS[level], 0)).alias("key"))
    rows = rows.union(lines.where(F.col("chars") > MIN_CHARS).select("id", F.lit(True), F.explode(_keys(LEVELS[level], 1))))
    buckets = staged(rows.groupBy("key").agg(F.count("*").alias("n"), F.count(F.when(~F.col("longer"), 1)).alias("short")).where("n > 1 and short > 0").select("key", "n"), "buckets")
    members = staged(rows.join(_small(buckets, limit), "key"), "members")
    last = level + 1 == len(LEVELS)
    cold = members if last else members.where(F.col("n") <= crowd)
    other = cold.where("not longer").select("key", F.col("id").alias("other"))
    pairs = cold.join(other, "key").where("longer and id <> other or id < other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    pairs = staged(pairs, "pairs")
    if last:
        return pairs
    hot = staged(members.where(F.col("n") > crowd).select("id").distinct(), "hot")
    if hot.isEmpty():
        return pairs
    return pairs.union(_candidates(lines.join(_small(hot, limit), "id", "left_semi"), level + 1, crowd, limit))


def near_lines(distinct: DataFrame, crowd: int = CROWD, limit: int | None = None) -> DataFrame:
    """Pairs of lines within one edit: from lines (id, k, first, line, chars) rows (k, first, other_k, other_first)."""
    long = distinct.where(F.col("chars") >= MIN_CHARS)
    pairs = staged(_candidates(long.select("id", "line", "chars"), 0, crowd, limit).distinct(), "candidates")
    ids = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    texts = staged(long.join(_small(ids, limit), "id", "left_semi").select("id", "k", "first", "line"), "texts")
    x, y = (texts.select(F.col("id").alias(i), F.col("k").alias(f"{i}_k"), F.col("first").alias(f"{i}_first"), F.col("line").alias(f"{i}_line")) for i in "ab")
    near = pairs.join(x, "a").join(y, "b").where(edit_distance("a_line", "b_line").isNotNull())
    return near.select(F.col("a_k").alias("k"), F.col("a_first").alias("first"), F.col("b_k").alias("other_k"), F.col("b_first").alias("other_first"))


def dropped_lines(docs: DataFrame, crowd: int = CROWD, limit: int | None = None) -> DataFrame:
    """For each document (did, hash) that loses lines: n_dropped, and their positions as the bits of an array of longs."""
    rows = docs.select(F.col("doc_id").alias("did"), F.xxhash64("text").alias("hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("k", F.struct(F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2")))
    place = F.struct("did", "hash", "pos")
    distinct = rows.groupBy("k.k1", "k.k2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("line").alias("line"))
    distinct = distinct.select(F.struct("k1", "k2").alias("k"), F.col("k1").alias("id"), "first", "n", "line", F.length("line").alias("chars"))
    distinct = staged(distinct, "lines")
    near = near_lines(distinct, crowd, limit)
    late = near.select(F.when(F.col("first") > F.col("other_first"), F.col("k")).otherwise(F.col("other_k")).alias("k")).distinct()
    late = staged(late.select(F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2"), F.lit(True).alias("late")), "late")
    hit = distinct.select("k.k1", "k.k2", "first", "n").join(_small(late, limit), ["k1", "k2"], "left").where("n > 1 or late")
    hit = staged(hit.select("k1", "k2", "first", F.coalesce("late", F.lit(False)).alias("late")), "hit")
    gone = rows.select("k.k1", "k.k2", place.alias("place")).join(_small(hit, limit), ["k1", "k2"]).where(F.col("late") | (F.col("place") != F.col("first")))
    bits = gone.groupBy("place.did", "place.hash", F.shiftright("place.pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, place.pos % 64)")).alias("bits"))
    per = bits.groupBy("did", "hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"), F.max("word").alias("last"), F.sum(F.bit_count("bits")).alias("n_dropped"))
    return per.select("did", "hash", "n_dropped", F.expr("transform(sequence(0, last), w -> coalesce(words[w], 0L))").alias("drop"))


@scoped
def dedup_lines(docs: DataFrame, crowd: int = CROWD, limit: int | None = None) -> DataFrame:
    """The documents with their text less the dropped lines, and two more columns: LINES with a word, DROPPED of them."""
    drops = dropped_lines(docs.select("doc_id", "text"), crowd, limit).select(*(F.col(c).alias(f"__loom_{c}") for c in ("did", "hash", "n_dropped", "drop")))
    drops = staged(drops, "drops")
    same = F.col("doc_id").eqNullSafe(F.col("__loom_did")) & (F.xxhash64("text") == F.col("__loom_hash"))
    most = BROADCAST_ROWS if limit is None else limit
    held = drops.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("__loom_drop")), F.lit(0)).alias("longs")).first()
    joined = docs.join(F.broadcast(drops) if held.n <= most and held.longs <= 5 * most else drops, same, "left")
    lines = F.expr(r"size(filter(split(text, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]'))")
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (x, i) -> coalesce(shiftright(get(__loom_drop, shiftright(i, 6)), i % 64) & 1, 0L) = 0), '\\n')")
    columns = [F.when(F.col("__loom_drop").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return joined.select(*columns, F.when(F.col("text").isNull(), 0).otherwise(lines).cast("long").alias(LINES), F.coalesce("__loom_n_dropped", F.lit(0)).cast("long").alias(DROPPED))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).withColumnsRenamed({LINES: "n_lines", DROPPED: "n_dropped"})


#: DuckDB counts edits of bytes, so letters outside ASCII are first replaced by control characters, one for one.
ORACLE_SQL = r"""
WITH rows AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), worded AS (
  SELECT * FROM rows WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), lines AS (
  SELECT line, min(struct_pack(d := doc_id, p := pos)) AS place, length(line) AS n, length(line) // 2 AS h,
         translate(line, 'éèêçäöüßóíñáúÉÈÊÇÄÖÜÓÍÑÁÚ', (SELECT string_agg(chr(c), '' ORDER BY c) FROM (SELECT unnest([1,2,3,4,5,6,7,8,11,12,14,15,16,17,18,19,20,21,22,23,24,25,26,27,28]) AS c))) AS t
  FROM worded GROUP BY line
), late AS (
  SELECT DISTINCT b.line FROM lines a JOIN lines b ON a.n BETWEEN b.n - 1 AND b.n + 1 AND (left(a.line, least(a.h, b.h)) = left(b.line, least(a.h, b.h)) OR right(a.line, least(a.h, b.h)) = right(b.line, least(a.h, b.h)))
  WHERE a.n >= 20 AND b.n >= 20 AND a.place < b.place AND levenshtein(a.t, b.t) <= 1
), judged AS (
  SELECT r.doc_id, r.pos, r.line, w.line IS NOT NULL AS worded, w.line IS NOT NULL AND (late.line IS NOT NULL OR lines.place <> struct_pack(d := r.doc_id, p := r.pos)) AS gone
  FROM rows r LEFT JOIN worded w USING (doc_id, pos) LEFT JOIN lines ON lines.line = w.line LEFT JOIN late ON late.line = w.line
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(j.line, chr(10) ORDER BY j.pos) FILTER (NOT j.gone), '') END AS text,
       count(*) FILTER (j.worded) AS n_lines, count(*) FILTER (j.gone) AS n_dropped
FROM documents d LEFT JOIN judged j USING (doc_id) GROUP BY d.doc_id, d.text
"""
