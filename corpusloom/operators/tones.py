"""Statistics of syllable cases: histograms, crosstabs and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.maths import percentage

TONES = ("1", "2", "3", "4", "blank")
TONE_BUCKETS = ("tone_1", "tone_2", "tone_4", "tone_3_or_5")
LENGTH_BUCKETS = ("length_1_or_2", "length_3", "length_4_to_6")


def cases(rows: DataFrame) -> DataFrame:
    """Distinct (character, pinyin, tone) and length, from rows (character, syllable)."""
    syllable = F.col("syllable")
    return rows.select("character", F.lower(syllable).alias("pinyin"), T.case_tone(syllable).alias("tone"), T.case_length(F.lower(syllable)).alias("length")).distinct()


def zipped_cases(rows: DataFrame) -> DataFrame:
    """(character, syllable) pairs by place of rows (characters, syllables); the longer array's rest is left out."""
    n = F.least(F.size("characters"), F.size("syllables"))
    pair = F.arrays_zip(F.slice("characters", F.lit(1), n).alias("character"), F.slice("syllables", F.lit(1), n).alias("syllable"))
    return rows.select(F.explode(pair).alias("p")).select("p.character", "p.syllable")


def _total(df: DataFrame, count: str = "cnt") -> Column:
    return F.sum(count).over(W.partitionBy(F.lit(0)))


def tone_histogram(found: DataFrame) -> DataFrame:
    """tone, cnt, percentage of all five tones, zero where none occurs. At most five rows are windowed."""
    counts = found.groupBy(F.col("tone").alias("t")).agg(F.count("*").alias("n"))
    domain = found.sparkSession.createDataFrame([(t,) for t in TONES], "tone string")
    full = domain.join(counts, F.col("tone") == F.col("t"), "left").select("tone", F.coalesce("n", F.lit(0)).alias("cnt"))
    return full.select("tone", "cnt", percentage(F.col("cnt"), _total(full)).alias("percentage"))


def length_histogram(found: DataFrame) -> DataFrame:
    counts = found.groupBy("length").agg(F.count("*").alias("cnt"))
    return counts.select("length", "cnt", percentage(F.col("cnt"), _total(counts)).alias("percentage"))


def tone_length_matrix(found: DataFrame) -> DataFrame:
    """A row for each tone bucket with the counts of the length buckets, zero where none occurs."""
    rows = found.select(T.tone_bucket(F.col("tone")).alias("tone_bucket"), T.length_bucket(F.col("length")).alias("length_bucket"))
    made = rows.groupBy("tone_bucket").pivot("length_bucket", list(LENGTH_BUCKETS)).count()
    domain = found.sparkSession.createDataFrame([(t,) for t in TONE_BUCKETS], "tone_bucket string")
    return domain.join(made, "tone_bucket", "left").na.fill(0)


def marginals(tones: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts by tone bucket and by length bucket, from the two histograms; every bucket is there."""
    spark = tones.sparkSession
    out = []
    for df, source, name, bucket, domain in ((tones, "tone", "tone_bucket", T.tone_bucket, TONE_BUCKETS), (lengths, "length", "length_bucket", T.length_bucket, LENGTH_BUCKETS)):
        sums = df.groupBy(bucket(F.col(source)).alias("b")).agg(F.sum("cnt").alias("s"))
        whole = spark.createDataFrame([(b,) for b in domain], f"{name} string")
        out.append(whole.join(sums, F.col(name) == F.col("b"), "left").select(name, F.coalesce("s", F.lit(0)).alias("cnt")))
    return out[0], out[1]


def independence(tones: DataFrame, lengths: DataFrame, total: int | None = None) -> DataFrame:
    """tone_bucket, length_bucket, estimate: the outer product (four by three rows) of the marginals over the total."""
    a, b = marginals(tones, lengths)
    whole = F.lit(total) if total else F.sum("tone_cnt").over(W.partitionBy("length_bucket"))
    pairs = a.withColumnRenamed("cnt", "tone_cnt").crossJoin(F.broadcast(b.withColumnRenamed("cnt", "length_cnt")))
    return pairs.withColumn("whole", whole).select("tone_bucket", "length_bucket", F.when(F.col("whole") > 0, F.col("tone_cnt") * F.col("length_cnt") / F.col("whole")).otherwise(0.0).alias("estimate"))


def matrix_payload(cells: DataFrame, value: str = "estimate") -> DataFrame:
    """Adds probability (6 digits) and percentage (4 digits, of the rounded probability) to the cells of a matrix."""
    total = F.sum(value).over(W.partitionBy(F.lit(0)))
    made = cells.withColumn("probability", F.when(total > 0, F.round(F.col(value) / total, 6)).otherwise(0.0))
    return made.withColumn("percentage", F.round(F.col("probability") * 100, 4))


def payload(tones: DataFrame, lengths: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """tone_bucket, length_bucket, value, probability, percentage: counted exactly where there are cases, else the estimate from the
    two histograms."""
    if cases is None:
        return matrix_payload(independence(tones, lengths).withColumnRenamed("estimate", "value"), "value")
    return matrix_payload(unpivoted(tone_length_matrix(cases)).withColumnRenamed("cnt", "value"), "value")


def printed(matrix: DataFrame, width: int = 16) -> str:
    """The matrix of tone_length_matrix as lines of columns of one width: four rows at most."""
    rows = [("tone", *LENGTH_BUCKETS), *sorted((r.tone_bucket, *(r[c] for c in LENGTH_BUCKETS)) for r in matrix.collect())]
    return "\n".join("".join(f"{x!s:>{width}}" if n else f"{x!s:<{width}}" for n, x in enumerate(r)) for r in rows)


def unpivoted(matrix: DataFrame) -> DataFrame:
    return matrix.unpivot("tone_bucket", list(LENGTH_BUCKETS), "length_bucket", "cnt")


def aligned(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Two small lists side by side, row by row, with nulls where one is shorter."""
    a, b = (df.withColumn("row", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*o))) for df, o in ((left, left_order), (right, right_order)))
    return a.join(b, "row", "full_outer")


def check_totals(tones: DataFrame, lengths: DataFrame, total: int) -> None:
    a = {r.tone: r.cnt for r in tones.collect()}
    b = lengths.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n")).first().n
    if set(a) != set(TONES):
        raise ValueError("the summary needs all five tones")
    if not sum(a.values()) == b == total:
        raise ValueError(f"totals disagree: tones {sum(a.values())}, lengths {b}, reported {total}")


def latex_table(tones: DataFrame, lengths: DataFrame, total: int) -> str:
    """The report of two aligned lists; at most as many rows as there are lengths or tones."""
    check_totals(tones, lengths, total)
    place = F.array_position(F.array(*map(F.lit, TONES)), F.col("tone"))
    rows = aligned(tones.select("tone", F.col("cnt").alias("a"), F.col("percentage").alias("p")), lengths.select("length", F.col("cnt").alias("b"), F.col("percentage").alias("q")), [place], [F.col("length")])
    cell = lambda x, form="{}": "" if x is None else form.format(x)
    body = [" & ".join([cell(r.tone), cell(r.a), cell(r.p, "{:.2f}"), cell(r.length), cell(r.b), cell(r.q, "{:.2f}")]) + r" \\" for r in rows.orderBy("row").collect()]
    return "\n".join([r"\begin{tabular}{lrrlrr}", r"Tone & Count & \% & Length & Count & \% \\", r"\hline", *body, r"\hline", rf"Total & {total} & & & {total} & \\", r"\end{tabular}"])
