"""Vocabularies of encoded words, and segmentation by them."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..functions.maths import candidate_score, uniform
from ..plans.staging import scoped, stage
from .chunks import prefix_offsets

# Fixed values.
FIXED_TOKENS = ["<pad>", "<unk>", "<s>", "</s>", "<mask>"]
UNKNOWN = 1
INITIALS, DIGITS = string.ascii_uppercase + string.ascii_lowercase, string.digits
MODES = ("greedy", "softmax")


def check_parameters(mode: str = "greedy", alpha: float = 1.0, beta: float = 0.0, temperature: float = 1.0, epsilon: float = 1e-8) -> str:
    """The mode in its normal form; wrong parameters are errors."""
    mode = mode.strip().lower()
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if not (math.isfinite(alpha) and math.isfinite(beta)):
        raise ValueError("alpha and beta must be finite")
    for name, x in (("temperature", temperature), ("epsilon", epsilon)):
        if not (math.isfinite(x) and x > 0):
            raise ValueError(f"{name} must be positive and finite")
    return mode


def atomic_tokens(initials: str = INITIALS, digits: str = DIGITS) -> list[str]:
    return list(dict.fromkeys(a + b for a in initials for b in digits))


def require_valid(counts: DataFrame, examples: int = 5) -> None:
    """Strict mode: items of no class are an error that shows the first of them."""
    bad = counts.where("class = 'invalid'").orderBy("first_doc", "first_pos").limit(examples).collect()
    if bad:
        raise ValueError("invalid items: " + ", ".join(f"{r.item!r} (document {r.first_doc}, position {r.first_pos})" for r in bad))


@scoped
def build_vocabulary(spark: SparkSession, counts: DataFrame, size: int, least: int = 20, atomic_only: bool = False) -> DataFrame:
    """token, token_id, score: fixed and special tokens, preserved ones in order, atoms, then the most frequent words that fit.

    counts has class, item and cnt. Ids are places in the order; counts and the vocabulary are staged, so that joins with it
    don't count again.
    """
    counts = stage(counts.where("class in ('preserved', 'encoded')").select("class", "item", F.col("cnt").cast("long").alias("cnt")), "counts")
    fixed = FIXED_TOKENS + T.SPECIAL_TOKENS
    head = spark.createDataFrame([(0, i, t) for i, t in enumerate(fixed)] + [(2, i, t) for i, t in enumerate(atomic_tokens())], "part int, n long, token string")
    preserved = counts.where("class = 'preserved'").select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("n"), F.col("item").alias("token"))
    base = head.unionByName(preserved).groupBy("token").agg(F.min(F.struct("part", "n")).alias("at")).select(F.col("at.part").alias("part"), F.col("at.n").alias("n"), "token", F.lit(None).cast("double").alias("score"))
    n_base = base.count()
    if n_base > size and not atomic_only:
        raise ValueError(f"the base vocabulary of {n_base} tokens exceeds the size {size}")
    budget = 0 if atomic_only else size - n_base
    chosen = selected_words(counts, budget, least).select(F.lit(3).alias("part"), (-F.col("cnt")).alias("n"), F.col("item").alias("token"), F.col("cnt").cast("double").alias("score"))
    ordered = prefix_offsets(base.unionByName(chosen), F.lit(1), "part", "n", "token")
    return stage(ordered.select("token", F.col("offset").cast("int").alias("token_id"), "score"), "vocabulary")


def selected_words(counts: DataFrame, budget: int, least: int) -> DataFrame:
    """Encoded words of several atoms and enough frequency, most frequent first, ties by code point, as many as the budget."""
    fit = counts.where((F.col("class") == "encoded") & (T.atom_count(F.col("item")) > 1) & (F.col("cnt") >= least))
    return fit.orderBy(F.desc("cnt"), "item").limit(max(0, budget)).select("item", "cnt")


def to_ids(rows: DataFrame, vocabulary: DataFrame, unknown: int = UNKNOWN) -> DataFrame:
    """Adds token_id to rows with a column item. Adaptive execution broadcasts the vocabulary if its measured size is small."""
    known = vocabulary.select(F.col("token").alias("item"), "token_id")
    return rows.join(known, "item", "left").withColumn("token_id", F.coalesce("token_id", F.lit(unknown)))


def to_tokens(rows: DataFrame, vocabulary: DataFrame, unknown: str = "<unk>") -> DataFrame:
    """Adds item to rows with a column token_id."""
    known = vocabulary.select("token_id", F.col("token").alias("item"))
    return rows.join(known, "token_id", "left").withColumn("item", F.coalesce("item", F.lit(unknown)))


def coverage(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row over rows (word): occurrences, whole-word hits, fallbacks and mean pieces per word; 0 where nothing is there."""
    encoded = words.where(T.is_encoded(F.col("word")))
    whole = vocabulary.where(T.is_encoded(F.col("token")) & (T.atom_count(F.col("token")) > 1)).select(F.col("token").alias("word"), F.lit(True).alias("whole"))
    n = T.atom_count(F.col("word"))
    hit = F.col("whole").isNotNull() | (n == 1)
    sums = encoded.join(whole, "word", "left").agg(F.count("*").alias("occurrences"), F.count(F.when(hit, 1)).alias("hits"), F.coalesce(F.sum(F.when(hit, 1).otherwise(n)), F.lit(0)).alias("pieces"))
    share = lambda x: F.when(F.col("occurrences") > 0, x / F.col("occurrences")).otherwise(0.0)
    return sums.select("occurrences", "hits", "pieces", share(F.col("hits")).alias("coverage"), share(F.col("occurrences") - F.col("hits")).alias("fallback_rate"), share(F.col("pieces")).alias("pieces_per_word"))


def candidates(words: DataFrame, vocabulary: DataFrame, span: int) -> DataFrame:
    """For each word and atom position the vocabulary entries that cover 1 to span whole atoms from there.

    A join of all such substrings of distinct words with the vocabulary; a word has at most its atoms times span of them.
    """
    n = T.atom_count(F.col("word"))
    starts = words.select("word").where(T.is_encoded(F.col("word"))).select("word", n.alias("atoms"), F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    spans = starts.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(span), F.col("atoms") - F.col("start")))).alias("length"))
    pieces = spans.withColumn("token", F.expr("substring(word, 2 * start + 1, 2 * length)"))
    return pieces.join(vocabulary.select("token", "token_id", F.coalesce("score", F.lit(0.0)).alias("frequency")), "token")


def longest_span(vocabulary: DataFrame) -> int:
    return vocabulary.where(T.is_encoded(F.col("token"))).agg(F.max(T.atom_count(F.col("token")))).first()[0] or 1


def probabilities(found: DataFrame, alpha: float = 1.0, beta: float = 0.0, temperature: float = 1.0, epsilon: float = 1e-8) -> DataFrame:
    """Adds score and p, the stable softmax over the candidates of each word position."""
    check_parameters("softmax", alpha, beta, temperature, epsilon)
    place = W.partitionBy("word", "start")
    scored = found.withColumn("score", candidate_score(F.col("frequency"), F.col("length"), alpha, beta, epsilon))
    scored = scored.withColumn("z", F.exp((F.col("score") - F.max("score").over(place)) / temperature))
    return scored.withColumn("p", F.col("z") / F.sum("z").over(place)).drop("z")


def _lengths(found: DataFrame, words: DataFrame) -> DataFrame:
    """word, atoms and, by position, the candidate lengths with their probabilities if there are any."""
    entry = F.struct("length", *(c for c in ("p",) if c in found.columns))
    by_start = found.groupBy("word", "start").agg(F.sort_array(F.collect_list(entry)).alias("lengths"))
    by_word = by_start.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("start", "lengths"))).alias("at"))
    return words.select("word").where(T.is_encoded(F.col("word"))).distinct().join(by_word, "word", "left").withColumn("atoms", T.atom_count(F.col("word")))


def _walk(pick, strict: bool, mode: str) -> Column:
    """Folds over a word's positions: at the next free one, pick gives the length to take."""
    start = F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(0).alias("next"))

    def step(s: Column, i: Column) -> Column:
        options = F.element_at("at", i)
        lacking = F.concat(F.lit("no candidate in word "), F.col("word"), F.lit(" at atom "), i.cast("string"), F.lit(f" in mode {mode}"))
        length = F.when(options.isNotNull(), pick(options, i)).otherwise(F.raise_error(lacking).cast("int") if strict else F.lit(1))
        taken = F.struct(F.concat(s["pieces"], F.array(F.substring(F.col("word"), i * 2 + 1, length * 2))).alias("pieces"), (i + length).alias("next"))
        return F.when(i < s["next"], s).otherwise(taken)

    return F.aggregate(F.sequence(F.lit(0), F.col("atoms") - 1), start, step, lambda s: s["pieces"])


def segment_greedy(words: DataFrame, vocabulary: DataFrame, strict: bool = False) -> DataFrame:
    """word, pieces: the longest candidate at each free position. Each distinct word is segmented once."""
    found = candidates(words.distinct(), vocabulary, longest_span(vocabulary))
    longest = lambda options, i: F.element_at(options, -1)["length"]
    return _lengths(found.drop("frequency", "token", "token_id"), words).select("word", _walk(longest, strict, "greedy").alias("pieces"))


def segment_softmax(words: DataFrame, vocabulary: DataFrame, seed: int, alpha: float = 1.0, beta: float = 0.0, temperature: float = 1.0, epsilon: float = 1e-8, strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, word, pieces (and the columns to keep) of rows (id, word): candidates drawn by their probabilities, with a draw keyed by seed, id and position."""
    found = probabilities(candidates(words.select("word").distinct(), vocabulary, longest_span(vocabulary)), alpha, beta, temperature, epsilon)
    by_word = _lengths(found, words)

    def draw(options: Column, i: Column) -> Column:
        u = uniform(seed, F.col("id"), i)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("length"))
        fold = lambda s, o: F.struct((s["sum"] + o["p"]).alias("sum"), F.when(s["length"].isNull() & (u < s["sum"] + o["p"]), o["length"]).otherwise(s["length"]).alias("length"))
        return F.coalesce(F.aggregate(options, start, fold, lambda s: s["length"]), F.element_at(options, -1)["length"])

    return words.where(T.is_encoded(F.col("word"))).join(by_word, "word").select("id", "word", *keep, _walk(draw, strict, "softmax").alias("pieces"))


def tokenize_items(
    rows: DataFrame, vocabulary: DataFrame, strict: bool = False, mode: str = "greedy", key: str = "doc_id", seed: int = 0,
    alpha: float = 1.0, beta: float = 0.0, temperature: float = 1.0, epsilon: float = 1e-8,
) -> DataFrame:
    """Rows (.., item) with pieces: encoded words are segmented, known items stay, others are errors or unknown.

    In mode softmax each occurrence, told by key and pos, has draws of its own.
    """
    mode = check_parameters(mode, alpha, beta, temperature, epsilon)
    known = vocabulary.select(F.col("token").alias("item"), F.lit(True).alias("known"))
    lost = F.raise_error(F.concat(F.lit("unknown item "), F.col("item"))).cast("string") if strict else F.lit("<unk>")
    other = F.array(F.when(F.col("known"), F.col("item")).otherwise(lost))
    if mode == "greedy":
        pieces = segment_greedy(rows.select(F.col("item").alias("word")), vocabulary, strict).withColumnRenamed("word", "item")
        made = rows.join(pieces, "item", "left")
    else:
        place = F.concat_ws("/", F.col(key).cast("string"), F.col("pos").cast("string"))
        words = rows.select(F.struct(key, "pos").alias("_place"), place.alias("id"), F.col("item").alias("word"))
        pieces = segment_softmax(words, vocabulary, seed, alpha, beta, temperature, epsilon, strict, keep=("_place",))
        made = rows.withColumn("_place", F.struct(key, "pos")).join(pieces.select("_place", "pieces"), "_place", "left").drop("_place")
    return made.join(known, "item", "left").withColumn("pieces", F.coalesce("pieces", other)).drop("known")


def tokens_per_line(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row over rows (line, item): lines, pieces of all their items by actual segmentation, and the mean."""
    made = tokenize_items(rows, vocabulary).agg(F.countDistinct("line").alias("lines"), F.coalesce(F.sum(F.size("pieces").cast("long")), F.lit(0)).alias("pieces"))
    return made.withColumn("tokens_per_line", F.when(F.col("lines") > 0, F.col("pieces") / F.col("lines")).otherwise(0.0))


def encoded_words(df: DataFrame) -> DataFrame:
    """l_orderkey, word: the flags and numbers of an order's lines, in order, as atoms."""
    atom = F.struct("l_linenumber", "l_returnflag")
    made = df.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(atom)).alias("lines"))
    return made.select("l_orderkey", F.array_join(F.transform("lines", lambda x: F.concat(x["l_returnflag"], x["l_linenumber"].cast("string"))), "").alias("word"))


def decode(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", A.joined(F.col("pieces")))


def infer_merges(pieces: list[str]) -> list[tuple[str, str]]:
    """For each piece, in order of id, the last split into two pieces of the vocabulary. The vocabulary is small: driver side."""
    known = set(pieces)
    splits = (next(((p[:k], p[k:]) for k in range(len(p) - 1, 0, -1) if p[:k] in known and p[k:] in known), None) for p in pieces)
    return [s for s in splits if s]
