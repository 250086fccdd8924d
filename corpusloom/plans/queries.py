"""Queries over the tables, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import maths as M
from ..functions import text as T
from ..operators import chunks, codebook, counting, hanzi, metrics, pieces, preferences, sampling, tones, vocabulary
from ..operators.tokenizer import Tokenizer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt to all cores where they come in few pieces: a small table is one row group, which one task would lex alone. A
    table of more splits than a few for each core is left as it is."""
    df, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < 4 * cores else df


# ---------------------------------------------------------------- pieces of SQL

WORDS = r"words AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS item FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents))"
_LATIN = T.LATIN_WORD
_PUNCT = "(" + ", ".join("'" + c.replace("'", "''") + "'" for c in T.PUNCTUATION) + ")"
_SPECIAL = "(" + ", ".join(f"'{t}'" for t in T.SPECIAL_TOKENS) + ")"
LEXED = rf"lexed AS (SELECT doc_id, unnest(range(len(w))) AS n, unnest(w) AS token FROM (SELECT doc_id, regexp_extract_all(text, '{T.MARKER}|[{T.HANZI}]+|{_LATIN}|\S') AS w FROM documents))"
ROUTED = rf"""routed AS (SELECT doc_id, n, CASE
    WHEN starts_with(token, '<') AND ends_with(token, '>') AND length(token) > 1 THEN token
    WHEN regexp_full_match(token, '[{T.HANZI}]+') THEN token
    WHEN token IN {_PUNCT} THEN token
    WHEN regexp_full_match(token, '{_LATIN}') THEN CASE WHEN upper(token) IN ('A', 'B', 'C', 'D') THEN upper(token) ELSE lower(token) END
    WHEN regexp_full_match(token, '{T.NUMBER}') THEN '<NUM>'
    WHEN token <> '�' AND regexp_full_match(token, '[\p{{L}}\p{{P}}\p{{S}}]*') THEN lower(token) END AS item FROM lexed)"""
ITEMS = "items AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos, item FROM routed WHERE item IS NOT NULL)"
CLASS = rf"""CASE WHEN item IN {_SPECIAL} THEN 'special' WHEN regexp_full_match(item, '{T.ENCODED_WORD}') THEN 'encoded'
    WHEN item IN {_PUNCT} OR regexp_full_match(item, '{_LATIN}') OR (item <> '�' AND regexp_full_match(item, '[\p{{L}}\p{{P}}\p{{S}}]*')) THEN 'preserved' ELSE 'invalid' END"""
COUNTS = f"counts AS (SELECT {CLASS} AS class, item, count(*) AS cnt, min(struct_pack(d := doc_id, p := pos)) AS f FROM items GROUP BY item)"
WORD_COUNTS = f"counts AS (SELECT {CLASS} AS class, item, count(*) AS cnt, min(struct_pack(d := doc_id, p := pos)) AS f FROM words GROUP BY item)"
ENCODED = "encoded AS (SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, '' ORDER BY l_linenumber, l_returnflag) AS word FROM lineitem GROUP BY 1)"
SIZE, LEAST = 700, 5
SELECTED = f"""wcounts AS (SELECT word AS item, count(*) AS cnt FROM encoded GROUP BY 1),
selected AS (SELECT item, cnt, row_number() OVER (ORDER BY cnt DESC, item) AS rank FROM wcounts WHERE length(item) > 2 AND cnt >= {LEAST} ORDER BY cnt DESC, item LIMIT {SIZE - 535})"""
VOCAB = f"""fixed AS (SELECT unnest(range(15)) AS n, unnest([{", ".join(f"'{t}'" for t in vocabulary.FIXED_TOKENS + T.SPECIAL_TOKENS)}]) AS token),
letters AS (SELECT unnest(range(52)) AS a, unnest(string_split('{vocabulary.INITIALS}', '')) AS x),
atoms AS (SELECT a * 10 + d AS n, x || d AS token FROM letters, (SELECT unnest(range(10)) AS d)),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY part, n) - 1 AS INT) AS token_id, score FROM (
  SELECT 0 AS part, n, token, CAST(NULL AS DOUBLE) AS score FROM fixed UNION ALL SELECT 2, n, token, NULL FROM atoms UNION ALL SELECT 3, rank, item, CAST(cnt AS DOUBLE) FROM selected))"""
CANDIDATES = """spans AS (SELECT max(length(token) // 2) AS most FROM vocab WHERE regexp_full_match(token, '(?:[A-Za-z][0-9])+')),
places AS (SELECT word, length(word) // 2 AS n, unnest(range(length(word) // 2)) AS start FROM (SELECT DISTINCT word FROM encoded)),
pieces AS (SELECT word, start, len AS length, substring(word, 2 * start + 1, 2 * len) AS token FROM (SELECT word, start, unnest(range(1, least(most, n - start) + 1)) AS len FROM places, spans)),
found AS (SELECT p.word, p.start, p.length, p.token, v.token_id, coalesce(v.score, 0.0) AS frequency FROM pieces p JOIN vocab v USING (token))"""
GREEDY = """walk AS (SELECT word, 0 AS k, 0 AS at, CAST(NULL AS VARCHAR) AS piece FROM (SELECT DISTINCT word FROM encoded)
  UNION ALL SELECT w.word, w.k + 1, w.at + b.len, substring(w.word, 2 * w.at + 1, 2 * b.len) FROM walk w JOIN best b ON b.word = w.word AND b.start = w.at)"""
DOC_VOCAB, DOC_SIZE = f"{WORDS}, dv AS (SELECT item, CAST(row_number() OVER (ORDER BY count(*) DESC, item) + 4 AS INT) AS token_id FROM words GROUP BY item ORDER BY count(*) DESC, item LIMIT 2000)", 2000
DOC_IDS = f"{DOC_VOCAB}, ids AS (SELECT doc_id, pos, coalesce(token_id, 1) AS id FROM words LEFT JOIN dv USING (item) UNION ALL SELECT doc_id, 1000000000, 3 FROM (SELECT DISTINCT doc_id FROM words))"
BLOCK, STRIDE = 128, 96
STREAM = f"{DOC_IDS}, stream AS (SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS g, id FROM ids), size AS (SELECT count(*) AS n, CASE WHEN count(*) < {BLOCK} THEN 0 ELSE (count(*) - {BLOCK}) // {STRIDE} + 1 END AS chunks FROM stream)"
SYLLABLES = r"""syl AS (SELECT DISTINCT substring(lower(item), 1, 1) AS character, lower(item) || CASE pos % 6 WHEN 0 THEN '' ELSE CAST(pos % 6 AS VARCHAR) END AS syllable FROM words WHERE regexp_full_match(item, '[A-Za-z]{1,6}'))"""
PARTS = r"""parts AS (SELECT syllable, CASE WHEN regexp_full_match(lower(syllable), '[a-zü]+[1-5]?') THEN regexp_extract(lower(syllable), '^([a-zü]+)', 1) ELSE syllable END AS plain,
  CASE WHEN regexp_full_match(lower(syllable), '[a-zü]+[1-5]') THEN CAST(right(syllable, 1) AS INT) ELSE 5 END AS tone FROM (SELECT DISTINCT syllable FROM syl))"""
CASES = r"""cases AS (SELECT DISTINCT character, lower(syllable) AS pinyin, CASE WHEN regexp_matches(syllable, '[1-4]$') THEN right(syllable, 1) ELSE 'blank' END AS tone,
  CAST(length(regexp_replace(lower(syllable), '[1-4]$', '')) AS INT) AS length FROM syl WHERE length(regexp_replace(lower(syllable), '[1-4]$', '')) <= 6)"""
TONE_HIST = "th AS (SELECT d.tone, count(c.tone) AS cnt FROM (SELECT unnest(['1', '2', '3', '4', 'blank']) AS tone) d LEFT JOIN cases c USING (tone) GROUP BY 1)"
LENGTH_HIST = "lh AS (SELECT length, count(*) AS cnt FROM cases GROUP BY 1)"
MARGINALS = """tm AS (SELECT CASE WHEN tone IN ('1', '2', '4') THEN 'tone_' || tone ELSE 'tone_3_or_5' END AS tone_bucket, sum(cnt) AS a FROM th GROUP BY 1),
lm AS (SELECT d.length_bucket, coalesce(sum(cnt), 0) AS b FROM (SELECT unnest(['length_1_or_2', 'length_3', 'length_4_to_6']) AS length_bucket) d
  LEFT JOIN lh ON d.length_bucket = CASE WHEN length <= 2 THEN 'length_1_or_2' WHEN length = 3 THEN 'length_3' ELSE 'length_4_to_6' END GROUP BY 1)"""
PAIRS = r"pairs AS (SELECT doc_id, pos, lower(left(item, 2)) AS code, item AS word FROM words WHERE regexp_full_match(item, '[A-Za-z]+'))"
BOOK = "book AS (SELECT code, word, count(*) AS cnt, min(struct_pack(d := doc_id, p := pos)) AS f FROM pairs GROUP BY 1, 2)"
TURNS = r"""turns AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
asked AS (SELECT conv_id, turn, text AS prompt, next_text AS chosen FROM turns WHERE role = 'user' AND next_role = 'assistant'),
other AS (SELECT conv_id + 1 AS conv_id, min(text) AS rejected FROM conversations WHERE role = 'assistant' GROUP BY 1),
records AS (SELECT a.conv_id, a.turn, prompt, chosen, rejected FROM asked a LEFT JOIN other o USING (conv_id))"""
FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


#: Digits' characters, their readings and codes; they stand in for letters a to j, since the tables have no Hanzi.
READINGS = [("一", "yi1", "Y1"), ("二", "er4", "e6"), ("三", "san1", "S2"), ("四", "si4", "s6"), ("五", "wu3", "W6"), ("六", "liu4", "l7"), ("七", "qi1", "Q1"), ("八", "ba1", "B1"), ("九", "jiu3", "J7")]
HANZI_TEXTS = f"""readings AS (SELECT unnest({[r[0] for r in READINGS]}) AS character, unnest({[r[1] for r in READINGS]}) AS syllable, unnest({[r[2] for r in READINGS]}) AS code),
hanzi AS (SELECT doc_id, translate(text, 'abcdefghij', '一二三四五六七八九十') AS text FROM documents)"""


def flat(x: str) -> str:
    return FLAT.format(x)


# ---------------------------------------------------------------- rows shared by queries


def hanzi_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "abcdefghij", "一二三四五六七八九十").alias("text"))


def readings(spark: SparkSession) -> DataFrame:
    """One character of the ten has none."""
    return spark.createDataFrame([r[:2] for r in READINGS], "character string, syllable string")


def words_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.items(texts(spark, sf_dir).select("doc_id", "text"), T.words(F.col("text")))


def lexed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lexed tokens as they stand."""
    return counting.items(texts(spark, sf_dir).select("doc_id", "text"), T.lex(F.col("text")))


def lexed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.routed_counts(lexed_items(spark, sf_dir))


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.encoded_words(table(spark, sf_dir, "lineitem"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, sf_dir).groupBy(F.col("word").alias("item")).agg(F.count("*").alias("cnt")).select(T.item_class(F.col("item")).alias("class"), "item", "cnt")


def word_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.build_vocabulary(spark, word_counts(spark, sf_dir), SIZE, LEAST)


def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids: places of words among the most frequent ones, and the end id."""
    words = words_of(spark, sf_dir)
    top = words.groupBy("item").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "item").limit(DOC_SIZE)
    ranked = top.select(F.col("item").alias("token"), (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("cnt"), "item")) + 4).cast("int").alias("token_id"))
    ids = vocabulary.to_ids(words, ranked).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token_id"))), lambda x: x["token_id"]).alias("ids"))
    return ids.select("doc_id", chunks.with_eos(F.col("ids"), 3).alias("ids"))


def syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """character, syllable: short Latin words of the documents with a tone by their place stand in for readings."""
    words = words_of(spark, sf_dir).where(F.col("item").rlike("^[A-Za-z]{1,6}$"))
    tone = F.when(F.col("pos") % 6 == 0, "").otherwise((F.col("pos") % 6).cast("string"))
    return words.select(F.substring(F.lower("item"), 1, 1).alias("character"), F.concat(F.lower("item"), tone).alias("syllable")).distinct()


def tone_cases_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tones.cases(syllables(spark, sf_dir)).where("length <= 6")


def code_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = words_of(spark, sf_dir).where(F.col("item").rlike("^[A-Za-z]+$"))
    return words.select("doc_id", "pos", F.lower(F.substring("item", 1, 2)).alias("code"), F.col("item").alias("word"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, prompt, chosen, rejected: a user's turn, the answer to it, and an answer of the conversation before."""
    rows = table(spark, sf_dir, "conversations")
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = rows.withColumn("next_role", F.lead("role").over(order)).withColumn("chosen", F.lead("text").over(order))
    asked = turns.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "chosen")
    other = rows.where("role = 'assistant'").groupBy((F.col("conv_id") + 1).alias("conv_id")).agg(F.min("text").alias("rejected"))
    return asked.join(other, "conv_id", "left")


# ---------------------------------------------------------------- filters, limits, projections


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src3')")
def allow_list_filter(spark, sf_dir):
    return counting.allow_list(table(spark, sf_dir, "documents"), lang=["en", "fr"], source=["src1", "src2", "src3"]).select("doc_id", "lang", "source")


@query("SELECT doc_id, text FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 25")
def limit_after_filter(spark, sf_dir):
    return counting.first_n(counting.allow_list(table(spark, sf_dir, "documents"), lang=["de"]), 25, "doc_id").select("doc_id", "text")


@query("SELECT doc_id, lang FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 100) WHERE lang = 'de'")
def limit_before_filter(spark, sf_dir):
    return counting.allow_list(counting.first_n(table(spark, sf_dir, "documents"), 100, "doc_id"), lang=["de"]).select("doc_id", "lang")


@query('SELECT "doc-id" AS doc_id, text FROM (SELECT doc_id AS "doc-id", text, lang FROM documents)')
def project_text_only(spark, sf_dir):
    return counting.text_only(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "doc-id"))


@query(r"SELECT conv_id, turn, CASE WHEN role = 'system' THEN role WHEN regexp_matches(text, '\S') THEN text ELSE role END AS first FROM conversations")
def first_non_blank_field(spark, sf_dir):
    system = F.when(F.col("role") == "system", F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", counting.first_non_blank(system, F.col("text"), F.col("role")).alias("first"))


@query(r"SELECT page_id, regexp_matches(url, '\S') AS filled FROM pages WHERE regexp_matches(html, '\S')")
def not_blank_pages(spark, sf_dir):
    return counting.not_blank(table(spark, sf_dir, "pages"), "html").select("page_id", (~T.is_blank(F.col("url"))).alias("filled"))


# ---------------------------------------------------------------- text


@query(rf"SELECT page_id, {flat(r"regexp_replace(url || ' ' || html, '(?i)\b(?:https?://\S*|www\.\S+)', ' <URL> ', 'g')")} AS text FROM pages")
def normalize_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.normalize(F.concat_ws(" ", "url", "html"), "urls", "spaces").alias("text"))


@query(rf"SELECT doc_id, {flat(r"regexp_replace(regexp_replace(text, '(?s)\$\$.*?\$\$', ' <MATH> ', 'g'), '[（(]\s*[）)]', ' <BLANK> ', 'g')")} AS text FROM documents")
def normalize_math_and_blanks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text"), "math", "blanks", "spaces").alias("text"))


_NO = rf"regexp_replace({{}}, '(^|[^{T.LATIN}])(?i:no)(?:$|([^{T.LATIN}]))', '\1 ☒ \2', 'g')"


@query(f"SELECT doc_id, {flat(f"replace({_NO.format(_NO.format('text'))}, '☒', '<NO>')")} AS text FROM documents")
def normalize_answers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_spaces(T.mark_answers(F.col("text"))).alias("text"))


@query()
def process_documents(spark, sf_dir):
    """Normalised, lexed and routed tokens: the look-arounds of the steps have no form in the other engine."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.process(F.col("text")), " ").alias("tokens"))


@query(f"WITH {LEXED}, {ROUTED} SELECT doc_id, string_agg(item, ' ' ORDER BY n) AS tokens FROM routed WHERE item IS NOT NULL GROUP BY 1")
def lex_and_route(spark, sf_dir):
    kept = F.filter(F.transform(T.lex(F.col("text")), lambda t: T.route(t)), lambda x: x.isNotNull())
    # made by a generator, so that the filter isn't pushed below it and the tokens are made once
    return texts(spark, sf_dir).select("doc_id", F.explode(F.array(F.array_join(kept, " "))).alias("tokens")).where("tokens <> ''")


@query(rf"SELECT conv_id, turn, CASE WHEN length({flat('text')}) > 180 THEN substring({flat('text')}, 1, 177) || '...' ELSE {flat('text')} END AS clipped FROM conversations")
def clip_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clip(F.col("text")).alias("clipped"))


@query(r"""SELECT page_id, array_to_string(list_transform(string_split(url, ''), lambda c: CASE c WHEN '\' THEN '\textbackslash{}' WHEN '&' THEN '\&' WHEN '%' THEN '\%' WHEN '$' THEN '\$' WHEN '#' THEN '\#'
  WHEN '_' THEN '\_' WHEN '{' THEN '\{' WHEN '}' THEN '\}' WHEN '~' THEN '\textasciitilde{}' WHEN '^' THEN '\textasciicircum{}' ELSE c END), '') AS escaped FROM pages""")
def latex_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.latex(F.col("url")).alias("escaped"))


@query(rf"SELECT doc_id, regexp_matches(text, '{T.MARKER}') OR regexp_matches(text, '(?:^|[^A-Za-z0-9]){T.ENCODED_WORD}(?:$|[^A-Za-z0-9])') AS preprocessed, regexp_matches(text, '[{T.HANZI}]') AS hanzi FROM documents")
def preprocessed_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.looks_preprocessed(F.col("text")).alias("preprocessed"), T.has_hanzi(F.col("text")).alias("hanzi"))


@query()
def preprocess_once(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preprocess_once(F.col("text")).alias("text"))


@query(rf"WITH {WORDS}, {SYLLABLES}, {PARTS} SELECT syllable, plain, tone, lower(left(plain, 1)) AS initial, CASE WHEN plain = '' THEN '' ELSE (CASE WHEN tone IN (1, 3, 5) THEN upper(left(plain, 1)) ELSE lower(left(plain, 1)) END) || CAST((CASE WHEN tone >= 3 THEN 5 ELSE 0 END) + least(greatest(length(plain), 1), 5) - 1 AS VARCHAR) END AS atom FROM parts")
def syllable_codes(spark, sf_dir):
    s = F.col("syllable")
    return syllables(spark, sf_dir).select("syllable").distinct().select("syllable", T.syllable_plain(s).alias("plain"), T.syllable_tone(s).alias("tone"), T.syllable_initial(s).alias("initial"), T.syllable_atom(s).alias("atom"))


@query(f"WITH {HANZI_TEXTS} SELECT doc_id, unnest(regexp_extract_all(text, '[{T.HANZI}]+')) AS span FROM hanzi")
def hanzi_spans(spark, sf_dir):
    return hanzi_texts(spark, sf_dir).select("doc_id", F.explode(T.hanzi_spans(F.col("text"))).alias("span"))


_CODED = f"""{HANZI_TEXTS}, {LEXED.replace("FROM documents", "FROM hanzi")}, {ROUTED}, parted AS (SELECT doc_id, n, i, CASE WHEN regexp_full_match(token, '[{T.HANZI}]+') THEN (SELECT §code FROM readings WHERE character = c) ELSE item END AS item
  FROM (SELECT doc_id, n, token, item, unnest(CASE WHEN regexp_full_match(token, '[{T.HANZI}]+') THEN string_split(token, '') ELSE [token] END) AS c, unnest(range(CASE WHEN regexp_full_match(token, '[{T.HANZI}]+') THEN len(token) ELSE 1 END)) AS i FROM routed JOIN lexed USING (doc_id, n)))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, i) - 1 AS pos, item FROM parted WHERE item IS NOT NULL"""


@query("WITH " + _CODED.replace("§code", "code"))
def hanzi_codes(spark, sf_dir):
    return hanzi.encode(hanzi_texts(spark, sf_dir), readings(spark), normal=False)


@query("WITH " + _CODED.replace("§code", "left(syllable, 1)"))
def hanzi_initials(spark, sf_dir):
    return hanzi.encode(hanzi_texts(spark, sf_dir), readings(spark), mode="pinyin-initial", normal=False)


@query(f"WITH {HANZI_TEXTS}, seen AS (SELECT DISTINCT unnest(string_split(text, '')) AS character FROM hanzi) SELECT character, syllable AS pinyin, right(syllable, 1) AS tone, CAST(length(syllable) - 1 AS INT) AS length FROM seen JOIN readings USING (character)")
def hanzi_cases(spark, sf_dir):
    return tones.cases(hanzi.syllable_cases(hanzi_texts(spark, sf_dir), readings(spark)))


# ---------------------------------------------------------------- counting


@query(r"SELECT count(*) AS documents, sum(len(regexp_extract_all(text, '\S+'))) AS tokens, sum(len(regexp_extract_all(text, '\S+'))) * 3 AS training_tokens FROM documents")
def token_total(spark, sf_dir):
    return counting.token_total(table(spark, sf_dir, "documents"), epochs=3)


@query(f"WITH {LEXED}, {ROUTED}, {ITEMS}, {COUNTS} SELECT class, item, cnt, f.d AS first_doc, f.p AS first_pos FROM counts")
def classified_counts(spark, sf_dir):
    return counting.kept_positions(lexed_counts(spark, sf_dir), lexed_items(spark, sf_dir))


@query(f"""WITH {LEXED}, {ROUTED}, {ITEMS}, {COUNTS} SELECT sum(cnt) AS total_items, count(*) AS unique_items, {", ".join(f"coalesce(sum(cnt) FILTER (class = '{k}'), 0) AS {k}_occurrences, count(*) FILTER (class = '{k}') AS {k}_unique" for k in ("special", "encoded", "preserved", "invalid"))},
  count(*) FILTER (class = 'encoded' AND length(item) > 3) AS multi_atom_unique FROM counts""")
def corpus_statistics(spark, sf_dir):
    return counting.corpus_statistics(lexed_counts(spark, sf_dir))


@query(f"WITH {LEXED}, {ROUTED}, {ITEMS}, {COUNTS} SELECT item, cnt FROM counts WHERE class = 'preserved' ORDER BY cnt DESC, f LIMIT 50")
def preserved_top50(spark, sf_dir):
    counts = lexed_counts(spark, sf_dir)
    return counting.most_common(counts.where("class = 'preserved'"), 50).select("item", "cnt")


@query(f"WITH {WORDS} SELECT doc_id, pos, item FROM words WHERE {CLASS} = 'invalid' ORDER BY doc_id, pos LIMIT 20")
def invalid_examples(spark, sf_dir):
    return counting.first_examples(words_of(spark, sf_dir), "invalid", 20)


@query(f"WITH {LEXED}, {ROUTED}, {ITEMS} SELECT item, row_number() OVER (ORDER BY min(struct_pack(d := doc_id, p := pos))) - 1 AS ord FROM items GROUP BY item")
def ordered_dedupe(spark, sf_dir):
    return counting.numbered(lexed_counts(spark, sf_dir).select("item", "first_doc", "first_pos"), "first_doc", "first_pos")


@query(f"""WITH {LEXED}, {ROUTED}, {ITEMS}, {COUNTS} SELECT * FROM (SELECT item, cnt, 'head' AS "end" FROM counts ORDER BY cnt DESC, item LIMIT 10) UNION ALL SELECT * FROM (SELECT item, cnt, 'tail' FROM counts ORDER BY cnt, item DESC LIMIT 10)""")
def head_and_tail(spark, sf_dir):
    return counting.head_and_tail(lexed_counts(spark, sf_dir).select("item", "cnt"), 10, ("cnt", False), ("item", True))


@query("SELECT event_type, event_id, value, rank FROM (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY value DESC) AS rank FROM (SELECT event_type, event_id, round(value) AS value FROM events)) WHERE rank <= 5")
def top_values_with_ties(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", F.round("value").alias("value"))
    return counting.top_with_ties(rows, 5, "value", "event_type")


# ---------------------------------------------------------------- vocabulary and segmentation


@query(f"WITH {ENCODED}, {SELECTED}, {VOCAB} SELECT token, token_id, score FROM vocab")
def build_vocabulary(spark, sf_dir):
    return word_vocabulary(spark, sf_dir)


@query(f"""WITH {ENCODED}, {SELECTED}, {VOCAB}, hits AS (SELECT e.word, length(e.word) // 2 AS n, v.token IS NOT NULL OR length(e.word) = 2 AS hit FROM encoded e LEFT JOIN (SELECT token FROM vocab WHERE length(token) > 2 AND regexp_full_match(token, '(?:[A-Za-z][0-9])+')) v ON v.token = e.word)
SELECT count(*) AS occurrences, count(*) FILTER (hit) AS hits, sum(CASE WHEN hit THEN 1 ELSE n END) AS pieces, count(*) FILTER (hit) / count(*) AS coverage, count(*) FILTER (NOT hit) / count(*) AS fallback_rate, sum(CASE WHEN hit THEN 1 ELSE n END) / count(*) AS pieces_per_word FROM hits""")
def vocabulary_coverage(spark, sf_dir):
    return vocabulary.coverage(encoded(spark, sf_dir), word_vocabulary(spark, sf_dir))


@query(f"WITH {ENCODED}, {SELECTED}, {VOCAB} SELECT l_orderkey, word AS item, coalesce(token_id, 1) AS token_id, coalesce(t.token, '<unk>') AS token FROM encoded LEFT JOIN vocab v ON v.token = word LEFT JOIN (SELECT token_id, token FROM vocab) t USING (token_id)")
def token_ids_and_back(spark, sf_dir):
    vocab = word_vocabulary(spark, sf_dir)
    ids = vocabulary.to_ids(encoded(spark, sf_dir).withColumnRenamed("word", "item"), vocab)
    back = vocabulary.to_tokens(ids.withColumnRenamed("item", "original"), vocab)
    return back.select("l_orderkey", F.col("original").alias("item"), "token_id", F.when(F.col("token_id") == 1, "<unk>").otherwise(F.col("item")).alias("token"))


@query(f"WITH {ENCODED}, {SELECTED}, {VOCAB}, {CANDIDATES} SELECT word, start, length, token, token_id FROM found")
def segment_candidates(spark, sf_dir):
    vocab = word_vocabulary(spark, sf_dir)
    return vocabulary.candidates(encoded(spark, sf_dir).select("word").distinct(), vocab, vocabulary.longest_span(vocab)).select("word", "start", "length", "token", "token_id")


@query(f"""WITH {ENCODED}, {SELECTED}, {VOCAB}, {CANDIDATES}, scored AS (SELECT *, 0.5 * ln(frequency + 1e-8) + 1.0 * length AS score FROM found), z AS (SELECT *, exp((score - max(score) OVER (PARTITION BY word, start)) / 2.0) AS z FROM scored)
SELECT word, start, token, round(score, 6) AS score, round(z / sum(z) OVER (PARTITION BY word, start), 6) AS p FROM z""")
def segment_probabilities(spark, sf_dir):
    vocab = word_vocabulary(spark, sf_dir)
    found = vocabulary.candidates(encoded(spark, sf_dir).select("word").distinct(), vocab, vocabulary.longest_span(vocab))
    return vocabulary.probabilities(found, alpha=0.5, beta=1.0, temperature=2.0).select("word", "start", "token", F.round("score", 6).alias("score"), F.round("p", 6).alias("p"))


@query(f"WITH RECURSIVE {ENCODED}, {SELECTED}, {VOCAB}, {CANDIDATES}, best AS (SELECT word, start, max(length) AS len FROM found GROUP BY 1, 2), {GREEDY} SELECT word, string_agg(piece, ' ' ORDER BY k) AS pieces FROM walk WHERE k > 0 GROUP BY 1")
def segment_greedy(spark, sf_dir):
    vocab = word_vocabulary(spark, sf_dir)
    return vocabulary.segment_greedy(encoded(spark, sf_dir), vocab).select("word", F.array_join("pieces", " ").alias("pieces"))


_DRAW = "CAST(('0x' || substring(md5('{seed}:' || {key}), 1, 8)) AS UBIGINT) / 4294967296.0"


@query(f"""WITH RECURSIVE {ENCODED}, {SELECTED}, {VOCAB}, {CANDIDATES}, scored AS (SELECT word, start, length, 0.5 * ln(frequency + 1e-8) AS score FROM found),
z AS (SELECT *, exp((score - max(score) OVER (PARTITION BY word, start)) / 5.0) AS z FROM scored),
cum AS (SELECT word, start, length, sum(z) OVER (PARTITION BY word, start ORDER BY length) / sum(z) OVER (PARTITION BY word, start) AS upto, length = max(length) OVER (PARTITION BY word, start) AS last FROM z),
walk AS (SELECT l_orderkey AS id, word, 0 AS k, 0 AS at, CAST(NULL AS VARCHAR) AS piece FROM encoded
  UNION ALL SELECT id, word, k + 1, place + len, substring(word, 2 * place + 1, 2 * len) FROM (SELECT w.id, w.word, w.k, w.at AS place, min(c.length) AS len FROM walk w JOIN cum c ON c.word = w.word AND c.start = w.at
    WHERE {_DRAW.format(seed=1, key="w.id || ':' || w.at")} < c.upto OR c.last GROUP BY 1, 2, 3, 4))
SELECT id, word, string_agg(piece, ' ' ORDER BY k) AS pieces FROM walk WHERE k > 0 GROUP BY 1, 2""")
def segment_softmax(spark, sf_dir):
    """Drawn segmentations."""
    rows = encoded(spark, sf_dir).select(F.col("l_orderkey").alias("id"), "word")
    return vocabulary.segment_softmax(rows, word_vocabulary(spark, sf_dir), seed=1, alpha=0.5, temperature=5.0).select("id", "word", F.array_join("pieces", " ").alias("pieces"))


_GREEDY_WALK = f"{ENCODED}, {SELECTED}, {VOCAB}, {CANDIDATES}, best AS (SELECT word, start, max(length) AS len FROM found GROUP BY 1, 2), {GREEDY}"


@query(f"""WITH RECURSIVE {_GREEDY_WALK}, p AS (SELECT word AS item, string_agg(piece, ' ' ORDER BY k) AS pieces FROM walk WHERE k > 0 GROUP BY 1), o AS (SELECT DISTINCT unnest([l_returnflag, CASE l_linestatus WHEN 'F' THEN '<NUM>' ELSE '<unk>' END]) AS item FROM lineitem)
SELECT item, pieces FROM p UNION ALL SELECT item, CASE WHEN item IN (SELECT token FROM vocab) THEN item ELSE '<unk>' END FROM o""")
def item_dispatch(spark, sf_dir):
    """Encoded words are segmented, known items stay, others are unknown."""
    other = table(spark, sf_dir, "lineitem").select(F.explode(F.array("l_returnflag", F.when(F.col("l_linestatus") == "F", "<NUM>").otherwise("<unk>"))).alias("item"))
    rows = encoded(spark, sf_dir).select(F.col("word").alias("item")).union(other).distinct()
    return vocabulary.tokenize_items(rows, word_vocabulary(spark, sf_dir)).select("item", F.array_join("pieces", " ").alias("pieces"))


@query(f"""WITH RECURSIVE {_GREEDY_WALK}, gaps AS (SELECT word, k, piece, CASE WHEN k = 1 OR (length(piece) = 2 AND lag(length(piece)) OVER (PARTITION BY word ORDER BY k) = 2) THEN '' ELSE ' ' END AS gap FROM walk WHERE k > 0),
text AS (SELECT word, string_agg(gap || piece, '' ORDER BY k) AS decoded FROM gaps GROUP BY 1) SELECT l_orderkey, word, decoded FROM encoded JOIN text USING (word)""")
def decode_segments(spark, sf_dir):
    """Segments of encoded words joined again: neighbouring atoms are written together, longer pieces apart."""
    rows = encoded(spark, sf_dir)
    pieces = vocabulary.decode(vocabulary.segment_greedy(rows, word_vocabulary(spark, sf_dir)))
    return rows.join(pieces, "word").select("l_orderkey", "word", F.col("text").alias("decoded"))


_ENCODE = f"""{_GREEDY_WALK}, pieced AS (SELECT l_orderkey, k, token_id AS id FROM encoded JOIN walk USING (word) JOIN vocab ON token = piece WHERE k > 0 UNION ALL SELECT l_orderkey, 1000000, 1 FROM encoded),
whole AS (SELECT l_orderkey, list(id ORDER BY k) AS ids, count(*) AS n FROM pieced GROUP BY 1), sized AS (SELECT l_orderkey, ids, n, length(word) + 4 AS l FROM whole JOIN encoded USING (l_orderkey))"""


@query(f"""WITH RECURSIVE {_ENCODE} SELECT l_orderkey, list_concat([2], ids, [3]) AS input_ids, list_concat([1], list_transform(ids, lambda x: 0), [1]) AS special,
  array_to_string(list_concat(['0-0'], list_transform(range(n), lambda i: CAST(i * l // n AS VARCHAR) || '-' || CAST(CAST(ceil((i + 1) * l / n) AS BIGINT) AS VARCHAR)), ['0-0']), ' ') AS offsets FROM sized""")
def tokenizer_call(spark, sf_dir):
    """Texts of an encoded word and an unknown one: ids with start and end, the mask of what was added, and offsets."""
    texts = encoded(spark, sf_dir).select("l_orderkey", F.concat("word", F.lit(" ???")).alias("text"))
    made = Tokenizer(word_vocabulary(spark, sf_dir), add_bos=True, add_eos=True).encode(texts, key="l_orderkey", raw=False)
    spans = F.transform("offsets", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return made.select("l_orderkey", "input_ids", F.col("special_tokens_mask").alias("special"), F.array_join(spans, " ").alias("offsets"))


@query(f"""WITH RECURSIVE {_ENCODE} SELECT a.l_orderkey, list_concat(a.ids, b.ids) AS input_ids FROM sized a JOIN sized b USING (l_orderkey)""")
def tokenizer_pairs(spark, sf_dir):
    texts = encoded(spark, sf_dir).select("l_orderkey", F.concat("word", F.lit(" ???")).alias("text"))
    made = Tokenizer(word_vocabulary(spark, sf_dir)).encode(texts, pair="text", key="l_orderkey", raw=False)
    return made.select("l_orderkey", "input_ids")


@query(f"""WITH RECURSIVE {ENCODED}, {SELECTED}, {VOCAB}, {CANDIDATES}, best AS (SELECT word, start, max(length) AS len FROM found GROUP BY 1, 2), {GREEDY}, n AS (SELECT word, count(*) AS n FROM walk WHERE k > 0 GROUP BY 1)
SELECT count(DISTINCT l_orderkey % 1000) AS lines, sum(n) AS pieces, sum(n) / count(DISTINCT l_orderkey % 1000) AS tokens_per_line FROM encoded JOIN n USING (word)""")
def tokens_per_line(spark, sf_dir):
    rows = encoded(spark, sf_dir).select((F.col("l_orderkey") % 1000).alias("line"), F.col("word").alias("item"))
    return vocabulary.tokens_per_line(rows, word_vocabulary(spark, sf_dir))


@query()
def piece_round_trip(spark, sf_dir):
    """Ids of a model file and back; held to the texts by tests. The file is a parameter of the operator."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("ids", pieces.encode(F.col("text"), path))
    return rows.select("doc_id", F.size("ids").alias("n_pieces"), (pieces.decode(F.col("ids"), path) == F.col("text")).alias("same"))


_LOGITS = "logits AS (SELECT vec_id AS step, unnest(range(len(embedding))) AS token, round(CAST(unnest(embedding) AS DOUBLE), 1) AS logit FROM embeddings)"


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the vectors stand in for a model's scores."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("step"), F.posexplode("embedding").alias("token", "logit"))
    return rows.withColumn("logit", F.round(F.col("logit").cast("double"), 1))


@query(f"WITH {_LOGITS} SELECT step, token FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY logit DESC, token) AS n FROM logits) WHERE n = 1")
def greedy_next_token(spark, sf_dir):
    return sampling.choose(logits(spark, sf_dir), temperature=0.0).select("step", "token")


@query(f"""WITH {_LOGITS}, t AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY step ORDER BY logit DESC) AS r FROM logits) WHERE r <= 8), z AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY step)) / 0.7) AS z FROM t)
SELECT step, token, round(z / sum(z) OVER (PARTITION BY step), 6) AS p FROM z""")
def next_token_probabilities(spark, sf_dir):
    return sampling.softmax(logits(spark, sf_dir), 0.7, 8).select("step", "token", F.round("p", 6).alias("p"))


@query(f"""WITH {_LOGITS}, t AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY step ORDER BY logit DESC) AS r FROM logits) WHERE r <= 8), z AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY step)) / 0.7) AS z FROM t),
cum AS (SELECT step, token, sum(z) OVER (PARTITION BY step ORDER BY token) / sum(z) OVER (PARTITION BY step) AS upto, token = max(token) OVER (PARTITION BY step) AS last FROM z)
SELECT step, min(token) AS token FROM cum WHERE upto > {_DRAW.format(seed=2, key="step")} OR last GROUP BY 1""")
def sampled_next_token(spark, sf_dir):
    """Draws by probability."""
    return sampling.choose(logits(spark, sf_dir), 0.7, 8, seed=2).select("step", "token")


# ---------------------------------------------------------------- chunks and splits


@query(f"WITH {STREAM} SELECT k AS chunk_id, list(id ORDER BY g) AS input_ids FROM (SELECT unnest(range(chunks)) AS k FROM size) JOIN stream ON g >= k * {STRIDE} AND g < k * {STRIDE} + {BLOCK} GROUP BY 1")
def chunk_stream(spark, sf_dir):
    return chunks.chunk_stream(document_ids(spark, sf_dir), BLOCK, STRIDE)


@query(f"WITH {STREAM} SELECT n AS consumed_tokens, (SELECT max(id) FROM stream) AS max_token_id, chunks AS num_examples, n - chunks * {STRIDE} AS dropped_tail_tokens FROM size")
def chunk_statistics(spark, sf_dir):
    return chunks.chunk_statistics(document_ids(spark, sf_dir), BLOCK, STRIDE)


@query(f"WITH {STREAM} SELECT chunks AS examples, {BLOCK} AS min_length, {BLOCK} AS max_length, (SELECT max(id) FROM stream, size WHERE g < (chunks - 1) * {STRIDE} + {BLOCK}) AS max_token_id FROM size")
def dataset_profile(spark, sf_dir):
    return chunks.dataset_profile(chunks.chunk_stream(document_ids(spark, sf_dir), BLOCK, STRIDE, labels=True))


@query(f"SELECT doc_id, CASE WHEN {_DRAW.format(seed=0, key='doc_id')} < 0.05 THEN 'validation' ELSE 'train' END AS split FROM documents")
def bernoulli_split(spark, sf_dir):
    return chunks.bernoulli_split(table(spark, sf_dir, "documents").select("doc_id"))


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_DRAW.format(seed=4, key='doc_id')}, doc_id) <= (SELECT least(count(*) - 1, greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT))) FROM documents) THEN 'validation' ELSE 'train' END AS split FROM documents")
def exact_split(spark, sf_dir):
    return chunks.exact_split(table(spark, sf_dir, "documents").select("doc_id"), 0.1, seed=4)


@query(f"SELECT doc_id, {_DRAW.format(seed=0, key=chr(39) + '2:' + chr(39) + ' || doc_id')} AS u FROM documents")
def epoch_shuffle(spark, sf_dir):
    return chunks.shuffled(table(spark, sf_dir, "documents").select("doc_id"), epoch=2)


@query()
def line_packing(spark, sf_dir):
    """Greedy packing is a fold in the order of tokens; held to a plain loop by tests."""
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.posexplode(A.packed(F.col("text"), T.words(F.col("text")), 400)).alias("n", "line"))


@query()
def packing_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return chunks.packing_statistics(rows, F.col("text"), A.packed(F.col("text"), T.words(F.col("text")), 400))


@query(f"""WITH {DOC_IDS}, s AS (SELECT doc_id, pos, id, CASE WHEN CAST(('0x' || substring(md5('0:' || doc_id), 1, 8)) AS UBIGINT) / 4294967296.0 < 0.2 THEN 'validation' ELSE 'train' END AS split FROM ids),
stream AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY doc_id, pos) - 1 AS g, id FROM s) SELECT split, g // {BLOCK} AS chunk_id, list(id ORDER BY g) AS input_ids FROM stream GROUP BY 1, 2 HAVING count(*) = {BLOCK}""")
def split_chunks(spark, sf_dir):
    return chunks.split_chunks(chunks.bernoulli_split(document_ids(spark, sf_dir), 0.2), BLOCK)


# ---------------------------------------------------------------- tones


@query(f"WITH {WORDS}, {SYLLABLES}, {CASES} SELECT character, pinyin, tone, length FROM cases")
def tone_cases(spark, sf_dir):
    return tone_cases_of(spark, sf_dir)


@query(f"WITH {WORDS}, {SYLLABLES}, {CASES}, {TONE_HIST} SELECT tone, cnt, round(cnt * 100.0 / sum(cnt) OVER (), 4) AS percentage FROM th")
def tone_histogram(spark, sf_dir):
    return tones.tone_histogram(tone_cases_of(spark, sf_dir))


@query(f"WITH {WORDS}, {SYLLABLES}, {CASES}, {LENGTH_HIST} SELECT length, cnt, round(cnt * 100.0 / sum(cnt) OVER (), 4) AS percentage FROM lh")
def length_histogram(spark, sf_dir):
    return tones.length_histogram(tone_cases_of(spark, sf_dir))


@query(f"""WITH {WORDS}, {SYLLABLES}, {CASES} SELECT CASE WHEN tone IN ('1', '2', '4') THEN 'tone_' || tone ELSE 'tone_3_or_5' END AS tone_bucket, count(*) FILTER (length <= 2) AS length_1_or_2, count(*) FILTER (length = 3) AS length_3, count(*) FILTER (length >= 4) AS length_4_to_6 FROM cases GROUP BY 1""")
def tone_length_matrix(spark, sf_dir):
    return tones.tone_length_matrix(tone_cases_of(spark, sf_dir))


@query(f"WITH {WORDS}, {SYLLABLES}, {CASES}, {TONE_HIST}, {LENGTH_HIST}, {MARGINALS} SELECT tone_bucket, length_bucket, a * b / (SELECT sum(a) FROM tm) AS estimate FROM tm, lm")
def tone_independence(spark, sf_dir):
    found = tone_cases_of(spark, sf_dir)
    return tones.independence(tones.tone_histogram(found), tones.length_histogram(found))


@query(f"""WITH {WORDS}, {SYLLABLES}, {CASES}, {TONE_HIST}, {LENGTH_HIST}, {MARGINALS}, est AS (SELECT tone_bucket, length_bucket, a * b / (SELECT sum(a) FROM tm) AS estimate FROM tm, lm)
SELECT *, round(estimate / sum(estimate) OVER (), 6) AS probability, round(round(estimate / sum(estimate) OVER (), 6) * 100, 4) AS percentage FROM est""")
def tone_matrix_payload(spark, sf_dir):
    found = tone_cases_of(spark, sf_dir)
    return tones.matrix_payload(tones.independence(tones.tone_histogram(found), tones.length_histogram(found)))


@query(f"WITH {WORDS}, {SYLLABLES}, {CASES}, {TONE_HIST}, {LENGTH_HIST}, a AS (SELECT row_number() OVER (ORDER BY tone) AS row, tone, cnt AS tone_cnt FROM th), b AS (SELECT row_number() OVER (ORDER BY length) AS row, length, cnt AS length_cnt FROM lh) SELECT * FROM a FULL JOIN b USING (row)")
def report_rows(spark, sf_dir):
    found = tone_cases_of(spark, sf_dir)
    a = tones.tone_histogram(found).select("tone", F.col("cnt").alias("tone_cnt"))
    return tones.aligned(a, tones.length_histogram(found).select("length", F.col("cnt").alias("length_cnt")), [F.col("tone")], [F.col("length")])


# ---------------------------------------------------------------- codebook


@query(f"WITH {WORDS}, {PAIRS}, {BOOK} SELECT code, word, cnt, f.d AS first_doc, f.p AS first_pos FROM book")
def code_words(spark, sf_dir):
    return codebook.codebook(code_pairs(spark, sf_dir))


@query(f"WITH {WORDS}, {PAIRS}, {BOOK} SELECT code, word, cnt, rank FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY cnt DESC, f) AS rank FROM book) WHERE rank <= 3")
def code_candidates(spark, sf_dir):
    return codebook.candidates(codebook.codebook(code_pairs(spark, sf_dir)), 3).select("code", "word", "cnt", "rank")


@query(rf"""WITH {WORDS}, {PAIRS}, message AS (SELECT item_id AS id, unnest(range(len(w))) AS pos, lower(left(unnest(w), 2)) AS code FROM (SELECT item_id, regexp_extract_all(text, '\S+') AS w FROM benchmark)),
kept AS (SELECT * FROM pairs WHERE code IN (SELECT code FROM message)), book AS (SELECT code, word, count(*) AS cnt, min(struct_pack(d := doc_id, p := pos)) AS f FROM kept GROUP BY 1, 2),
best AS (SELECT code, word FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY cnt DESC, f) AS r FROM book) WHERE r = 1)
SELECT id, string_agg(coalesce(word, '<' || code || '?>'), '' ORDER BY pos) AS decoded FROM message LEFT JOIN best USING (code) GROUP BY 1""")
def decode_messages(spark, sf_dir):
    words = counting.items(table(spark, sf_dir, "benchmark"), T.words(F.col("text")), "item_id")
    message = words.select(F.col("item_id").alias("id"), "pos", F.lower(F.substring("item", 1, 2)).alias("code"))
    return codebook.decode_messages(message, codebook.codebook(codebook.restrict(code_pairs(spark, sf_dir), message)))


# ---------------------------------------------------------------- preferences


@query(f"WITH {TURNS} SELECT conv_id, turn, prompt, chosen, rejected FROM records")
def preference_records(spark, sf_dir):
    return records(spark, sf_dir)


@query(rf"""WITH {TURNS} SELECT conv_id, turn, rule FROM (SELECT conv_id, turn, unnest([CASE WHEN prompt IS NULL THEN 'prompt is missing' WHEN NOT regexp_matches(prompt, '\S') THEN 'prompt is blank' END, CASE WHEN chosen IS NULL THEN 'chosen is missing' WHEN NOT regexp_matches(chosen, '\S') THEN 'chosen is blank' END,
  CASE WHEN rejected IS NULL THEN 'rejected is missing' WHEN NOT regexp_matches(rejected, '\S') THEN 'rejected is blank' END, CASE WHEN {flat("chosen")} = {flat("rejected")} THEN 'chosen equals rejected' END]) AS rule FROM records) WHERE rule IS NOT NULL""")
def preference_violations(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("key", F.struct("conv_id", "turn"))
    return preferences.violations(rows, "key").select("key.conv_id", "key.turn", "rule")


_TEXT_IDS = r"list_transform(regexp_extract_all({}, '\S+'), lambda w: length(w))"


@query(rf"""WITH {TURNS}, c AS (SELECT conv_id, turn, chosen, rejected, {_TEXT_IDS.format("chosen")} AS ci, {_TEXT_IDS.format("rejected")} AS ri FROM records WHERE rejected IS NOT NULL),
ok AS (SELECT *, row_number() OVER (PARTITION BY conv_id, {flat("rejected")} ORDER BY turn) AS n FROM c WHERE len(ri) > 0 AND NOT regexp_matches(rejected, '[�⁇]') AND ci <> ri AND {flat("chosen")} <> {flat("rejected")}) SELECT conv_id, turn, rejected FROM ok WHERE n = 1""")
def accepted_rejections(spark, sf_dir):
    ids = lambda c: F.transform(T.words(F.col(c)), F.length)
    rows = records(spark, sf_dir).where("rejected is not null").withColumn("chosen_ids", ids("chosen")).withColumn("rejected_ids", ids("rejected"))
    return preferences.accepted(rows, "conv_id", "turn").select("conv_id", "turn", "rejected")


@query(rf"""WITH {TURNS}, x AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS n, {_TEXT_IDS.format("prompt")} AS p, {_TEXT_IDS.format("chosen")} AS c FROM records),
y AS (SELECT conv_id, turn, n // 8 AS batch, CASE WHEN len(p) = 0 THEN [2] WHEN len(p) > 47 THEN p[len(p) - 46:] ELSE p END AS p, c FROM x), z AS (SELECT conv_id, turn, batch, len(p) AS np, list_concat(p, c[1:greatest(0, 48 - len(p))]) AS ids FROM y),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS most FROM z)
SELECT batch, conv_id, turn, list_resize(ids, most, 0) AS input_ids, list_transform(range(most), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END) AS attention_mask, list_transform(range(most), lambda i: i >= np AND i < len(ids)) AS completion_mask FROM m""")
def preference_batches(spark, sf_dir):
    ids = lambda c: F.transform(T.words(F.col(c)), F.length)
    rows = records(spark, sf_dir).withColumn("prompt_ids", ids("prompt")).withColumn("chosen_ids", ids("chosen")).withColumn("key", F.struct("conv_id", "turn"))
    placed = chunks.prefix_offsets(rows.select("conv_id", "turn", "key", "prompt_ids", "chosen_ids"), F.lit(1), "conv_id", "turn").withColumnRenamed("offset", "n")
    return preferences.batches(placed, "chosen", 48, 8, "key").select("batch", "key.conv_id", "key.turn", "input_ids", "attention_mask", "completion_mask")


@query(f"""WITH {TURNS}, s AS (SELECT -length(chosen) / 100.0 AS pc, -length(rejected) / 100.0 AS pr, -length(prompt) / 90.0 AS rc, -length(rejected) / 110.0 AS rr FROM records WHERE rejected IS NOT NULL)
SELECT round(avg(CASE WHEN pc - pr > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(pc - pr), 6) AS mean_margin, round(avg(ln(1 + exp(-0.1 * ((pc - pr) - (rc - rr))))), 6) AS mean_loss, count(*) AS pairs FROM s""")
def preference_accuracy(spark, sf_dir):
    """Text lengths stand in for a model's log-probabilities."""
    size = lambda c, by: -F.length(c) / F.lit(by)
    rows = records(spark, sf_dir).where("rejected is not null")
    pairs = rows.select(size("chosen", 100.0).alias("policy_chosen"), size("rejected", 100.0).alias("policy_rejected"), size("prompt", 90.0).alias("reference_chosen"), size("rejected", 110.0).alias("reference_rejected"))
    made = preferences.accuracy(pairs)
    return made.select(*(F.round(c, 6).alias(c) for c in ("accuracy", "mean_margin", "mean_loss")), "pairs")


@query(rf"""WITH d AS (SELECT doc_id, {_TEXT_IDS.format("text")} AS ids FROM documents), n AS (SELECT *, len(ids) AS n, greatest(1, CAST(floor(len(ids) * 0.3) AS INT)) AS low, {_DRAW.format(seed=9, key="doc_id")} AS u FROM d WHERE len(ids) >= 4),
c AS (SELECT *, least(greatest(1, low + CAST(floor(u * (greatest(low, CAST(floor(n * 0.5) AS INT)) - low + 1)) AS INT)), n - 1) AS cut FROM n) SELECT doc_id, list_slice(ids, 1, cut) AS prompt_ids, list_slice(ids, cut + 1, n) AS chosen_ids FROM c""")
def prompt_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.transform(T.words(F.col("text")), F.length).alias("ids"))
    return preferences.prompt_and_chosen(preferences.long_enough(rows), 9, "doc_id").drop("ids")


@query(rf"""WITH d AS (SELECT doc_id, length(text) AS l, {_TEXT_IDS.format("text")} AS ids FROM documents WHERE regexp_matches(text, '\S')), f AS (SELECT *, len(ids) AS n FROM d)
SELECT doc_id, list_concat([2], ids, [3]) AS ids, list_concat([1], list_transform(ids, lambda x: 0), [1]) AS special, list_transform(ids, lambda x: CASE WHEN x < 4 THEN -100 ELSE x END) AS labels,
  array_to_string(list_transform(range(n), lambda i: CAST(i * l // n AS VARCHAR) || '-' || CAST(CAST(ceil((i + 1) * l / n) AS BIGINT) AS VARCHAR)), ' ') AS offsets FROM f""")
def framed_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(~T.is_blank(F.col("text"))).select("doc_id", F.length("text").alias("l"), F.transform(T.words(F.col("text")), F.length).alias("raw"))
    framed = A.framed(F.col("raw"), 2, 3)
    masked = A.masked_labels(F.col("raw"), F.transform("raw", lambda x: F.when(x < 4, 0).otherwise(1)))
    spans = F.transform(A.spread_offsets(F.size("raw"), F.col("l")), lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return rows.select("doc_id", framed["ids"].alias("ids"), framed["special"].alias("special"), masked.alias("labels"), F.array_join(spans, " ").alias("offsets"))


# ---------------------------------------------------------------- metrics

_EVENTS = "e AS (SELECT user_id, event_id, ts, event_type, value, CAST(abs(floor(value * 1000)) AS BIGINT) AS tokens FROM events)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value", F.abs(F.floor(F.col("value") * 1000)).cast("long").alias("tokens"))


@query("SELECT user_id, event_id, value, coalesce(value < min(value) OVER w, true) AS improved, least(value, min(value) OVER w) AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def running_minimum(spark, sf_dir):
    return metrics.running_minimum(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "value", "event_id", "user_id")


@query("""WITH e AS (SELECT user_id, event_id, ts FROM events), l AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS us, event_id - lag(event_id) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, round(CASE WHEN us > 0 THEN n / (us / 1000000.0) END, 6) AS tokens_per_second FROM l""")
def throughput(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return metrics.throughput(rows, "event_id", "ts", "user_id").select("user_id", "event_id", F.round("tokens_per_second", 6).alias("tokens_per_second"))


@query(f"""WITH {_EVENTS}, s AS (SELECT event_type, event_id, tokens, sum(tokens) OVER (PARTITION BY event_type ORDER BY event_id) AS seen FROM e), t AS (SELECT unnest([{", ".join(map(str, metrics.CHECKPOINT_TARGETS))}]) AS target)
SELECT event_type, event_id, seen, target, 'chck_' || CAST(target // 1000000 AS VARCHAR) || 'M' AS name FROM s JOIN t ON target <= seen AND target > seen - tokens""")
def checkpoint_targets(spark, sf_dir):
    return metrics.checkpoints(steps(spark, sf_dir), "tokens", "event_id", "event_type")


@query(f"""WITH {_EVENTS}, s AS (SELECT tokens, sum(tokens) OVER (ORDER BY event_id) AS seen FROM e), t AS (SELECT unnest([{", ".join(map(str, metrics.CHECKPOINT_TARGETS))}]) AS target)
SELECT target FROM t WHERE target NOT IN (SELECT target FROM s JOIN t ON target <= seen AND target > seen - tokens)""")
def pending_targets(spark, sf_dir):
    saved = metrics.checkpoints(steps(spark, sf_dir), "tokens", "event_id").select("target").distinct()
    goals = spark.createDataFrame([(t,) for t in metrics.CHECKPOINT_TARGETS], "target long")
    return metrics.pending(goals, saved)


@query("SELECT event_type, event_id, (n - 1) // 7 + 1 AS step, 1.0 / count(*) OVER (PARTITION BY event_type, (n - 1) // 7) AS weight FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events)")
def accumulation_groups(spark, sf_dir):
    return metrics.accumulation_groups(table(spark, sf_dir, "events").select("event_type", "event_id"), 7, "event_id", "event_type")


@query("SELECT event_id, round(CASE WHEN event_id <= 100 THEN 0.001 * event_id / 100 ELSE 0.0001 + 0.0009 * 0.5 * (1 + cos(pi() * least(greatest((event_id - 100) / 900.0, 0), 1))) END, 9) AS rate FROM events")
def learning_rate(spark, sf_dir):
    rate = M.learning_rate(F.col("event_id"), 1000, 0.001, 0.0001, 100)
    return table(spark, sf_dir, "events").select("event_id", F.round(rate, 9).alias("rate"))


@query("SELECT round(coalesce(avg(value), 0), 6) AS mean, count(value) AS batches FROM events")
def validation_mean(spark, sf_dir):
    made = metrics.mean_or_zero(table(spark, sf_dir, "events"), "value")
    return made.select(F.round("mean", 6).alias("mean"), "batches")


# ---------------------------------------------------------------- sets


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT text FROM documents UNION SELECT text FROM benchmark")
def union_of_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("text").union(table(spark, sf_dir, "benchmark").select("text")).distinct()


@query(f"WITH {ENCODED}, {SELECTED}, {VOCAB} SELECT count(*) AS n, count(DISTINCT token_id) = count(*) AND max(token_id) + 1 = count(*) AS complete FROM vocab")
def vocabulary_check(spark, sf_dir):
    return word_vocabulary(spark, sf_dir).agg(F.count("*").alias("n"), ((F.countDistinct("token_id") == F.count("*")) & (F.max("token_id") + 1 == F.count("*"))).alias("complete"))


@query(f"WITH {LEXED}, {ROUTED}, {ITEMS}, {COUNTS} SELECT CAST(row_number() OVER (ORDER BY cnt DESC, item) - 1 AS INT) AS token_id, class, item, cnt FROM counts WHERE class <> 'invalid' ORDER BY cnt DESC, item LIMIT 1000")
def token_classes(spark, sf_dir):
    """The flagship: lexed and routed tokens, their classes and counts, and the most frequent of them with ids."""
    counts = lexed_counts(spark, sf_dir).where("class <> 'invalid'")
    best = counts.orderBy(F.desc("cnt"), "item").limit(1000)
    return best.select((F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("cnt"), "item")) - 1).cast("int").alias("token_id"), "class", "item", "cnt")
