"""The tokenizer's calls, Hanzi by readings, directories and steps that are taken up again."""

import json
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunks, counting, hanzi, metrics, tones
from corpusloom.operators.pieces import PieceTokenizer
from corpusloom.operators.tokenizer import Tokenizer
from corpusloom.operators.vocabulary import FIXED_TOKENS, build_vocabulary
from corpusloom.plans import staging
from corpusloom.plans.pipeline import Pipeline, mode_of
from corpusloom.sources import readers, writers

READINGS = [("我", "wo3"), ("们", "men5"), ("爱", "ai4"), ("中", "zhong1"), ("国", "guo2")]


@pytest.fixture(scope="module")
def readings(spark):
    return spark.createDataFrame(READINGS, "character string, syllable string")


@pytest.fixture(scope="module")
def tokenizer(spark, readings):
    counts = spark.createDataFrame([("encoded", "W6M7", 4), ("encoded", "W6M7a6", 2), ("preserved", "。", 3), ("preserved", "hello", 2)], "class string, item string, cnt long")
    return Tokenizer(build_vocabulary(spark, counts, 600, 1), readings)


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def tokens(t, df, **options):
    return [r.tokens for r in t.tokens(df, **options).orderBy("doc_id").collect()]


def test_hanzi_codes(spark, readings):
    df = texts(spark, "我们爱中国。Hello 3", "谁", None, "")
    got = {m: {r.doc_id: [x.item for x in rows] for r, rows in ((rows[0], rows) for rows in grouped(hanzi.encode(df, readings, mode=m)))} for m in ("pinyin-code", "pinyin-initial", "hanzi")}
    assert got["pinyin-code"] == {0: ["W6", "M7", "a6", "Z4", "g2", "。", "hello", "<NUM>"]}
    assert got["pinyin-initial"] == {0: ["w", "m", "a", "z", "g", "。", "hello", "<NUM>"]}
    assert got["hanzi"] == {0: ["我", "们", "爱", "中", "国", "。", "hello", "<NUM>"], 1: ["谁"]}
    with pytest.raises(ValueError, match="mode"):
        hanzi.encode(df, readings, mode="x")
    shown = {r.run: r.codes for r in hanzi.run_codes(spark.createDataFrame([("我们爱中国",)], "run string"), readings, "tone-marks").collect()}
    import unicodedata

    assert [unicodedata.normalize("NFC", x) for x in shown["我们爱中国"]] == ["wǒ", "men", "ài", "zhōng", "guó"]
    cases = {(r.character, r.pinyin, r.tone, r.length) for r in tones.cases(hanzi.syllable_cases(df, readings)).collect()}
    assert cases == {("我", "wo3", "3", 2), ("们", "men5", "blank", 4), ("爱", "ai4", "4", 2), ("中", "zhong1", "1", 5), ("国", "guo2", "2", 3)}


@pytest.mark.parametrize("mode", hanzi.MODES)
def test_hanzi_need_no_shuffle_of_tokens(spark, readings, mode):
    plan = hanzi.encode(texts(spark, "我们"), readings, mode=mode)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((doc_id|item|run)|SortMergeJoin \[(doc_id|item)", plan)


def test_odd_hanzi(spark):
    readings = spark.createDataFrame([("一", "yi1"), ("一", "er4"), ("国", None), ("四", ""), ("鿿", "ba1"), ("x", "xi1"), ("二三", "er4")], "character string, syllable string")
    df = texts(spark, "一国x鿿�a\u0301二三b四<A�B>É E 一\x00一", "国", None)
    got = {r.pos: r.item for r in hanzi.encode(df, readings, normal=False).collect() if r.doc_id == 0}
    assert [got[k] for k in range(len(got))] == ["e6", "x", "B1", "A", "B", "<", "A", "B", ">", "é", "e", "e6", "e6"]
    assert hanzi.encode(df, readings, normal=False).where("doc_id > 0").count() == 0


def test_characters_alone(spark):
    every = spark.createDataFrame([(chr(c),) for c in range(0x110000) if not 0xD800 <= c < 0xE000], "c string")
    c, token = F.col("c"), F.element_at(T.lex(F.col("c"), single=True), 1)
    rows = every.where(F.size(T.lex(c)) > 0).select("c", T.route(c).alias("whole"), T.blank_dropped(c).alias("kept"), T.route_lexed(token).alias("fast"))
    assert rows.where("(whole is null) <> (kept = ' ') or kept not in (c, ' ') or whole <> fast").count() == 0
    assert every.where(F.size(T.lex(c)) == 0).where(T.blank_dropped(c) != c).count() == 0



def grouped(rows):
    out = {}
    for r in rows.orderBy("doc_id", "pos").collect():
        out.setdefault(r.doc_id, []).append(r)
    assert all([x.pos for x in rs] == list(range(len(rs))) for rs in out.values())
    return list(out.values())


def test_raw_and_encoded_texts_agree(spark, tokenizer):
    raw, encoded = texts(spark, "我们爱。", "我们", "hello"), texts(spark, "W6 M7 a6 。", "W6 M7", "hello")
    assert tokens(tokenizer, raw) == tokens(tokenizer, encoded) == [["W6", "M7", "a6", "。"], ["W6", "M7"], ["hello"]]
    assert tokens(tokenizer, texts(spark, "W6M7a6 zzz", None, " "), raw=False) == [["W6M7a6", "<unk>"], [], []]
    strict = tokenizer.using(strict=True)
    with pytest.raises(Exception, match="unknown item zzz"):
        strict.tokens(texts(spark, "zzz"), raw=False).collect()


def test_modes_are_settings(spark, tokenizer):
    many = texts(spark, *["W6M7a6"] * 200)
    soft = tokenizer.using(mode=" Softmax ", temperature=5.0, seed=17)
    a, b, c = (tokens(x, many, raw=False) for x in (soft, soft, soft.using(seed=18)))
    assert a == b != c and len({tuple(x) for x in a}) > 1 and all("".join(x) == "W6M7a6" for x in a)
    assert tokenizer.mode == "greedy" and set(map(tuple, tokens(tokenizer, many, raw=False))) == {("W6M7a6",)}
    with pytest.raises(ValueError):
        tokenizer.using(mode="beam")


def test_calls(spark, tokenizer):
    t = tokenizer.using(add_bos=True, add_eos=True)
    df = spark.createDataFrame([(1, "W6M7 hello", "W6M7a6"), (2, None, "zzz")], "doc_id long, text string, pair string")
    known = {r.token: r.token_id for r in t.vocabulary.collect()}
    one, two = t.encode(df, raw=False).orderBy("doc_id").collect()
    assert one.input_ids == [2, known["W6M7"], known["hello"], 3] and one.special_tokens_mask == [1, 0, 0, 1] and one.token_type_ids == [0] * 4
    assert [tuple(o) for o in one.offsets] == [(0, 0), (0, 5), (5, 10), (0, 0)] and two.input_ids == [2, 3]
    pair = t.encode(df, pair="pair", raw=False).orderBy("doc_id").first()
    assert pair.input_ids == [2, known["W6M7"], known["hello"], 3, 2, known["W6M7a6"], 3] and len(pair.offsets) == len(pair.attention_mask) == 7
    assert t.encode(df, raw=False, special=False, most=1).orderBy("doc_id").first().input_ids == [known["W6M7"]]
    back = t.decode(t.encode(df, raw=False), "input_ids").orderBy("doc_id").collect()
    assert [r.text for r in back] == ["W6M7 hello", ""]
    stored = df.withColumn("ids", F.when(F.col("doc_id") == 2, F.array(F.lit(7))))
    assert [r.ids for r in t.ids(stored, raw=False, stored="ids").orderBy("doc_id").collect()] == [[known["W6M7"], known["hello"]], [7]]


def test_readable_decoding(spark, tokenizer):
    ids = {r.token: r.token_id for r in tokenizer.vocabulary.collect()}
    rows = spark.createDataFrame([(1, [ids["W6"], ids["M7"], ids["W6M7"], ids["。"]])], "doc_id long, ids array<int>")
    assert tokenizer.decode(rows).first().text == "W6M7 W6M7 。"
    assert tokenizer.using(readable=True).decode(rows).first().text == "W6 M7 W6M7 。"


def test_directories(spark, tokenizer, tmp_path):
    folder = f"file://{tmp_path}/t"
    writers.write_tokenizer(tokenizer.using(temperature=2.0), folder, least=1)
    again = readers.read_tokenizer(spark, f"{folder}/vocab.json", mode="softmax")
    assert (again.mode, again.temperature) == ("softmax", 2.0)
    key = lambda t: sorted((r.token_id, r.token, r.score) for r in t.vocabulary.collect())
    assert key(again) == key(tokenizer) and again.readings.count() == len(READINGS)
    assert json.loads((tmp_path / "t/special_tokens_map.json").read_text())["mask_token"] == FIXED_TOKENS[4]
    assert readers.vocabulary_size(spark, folder, 9) == tokenizer.size() and readers.vocabulary_size(spark, f"file://{tmp_path}", 9) == 9
    import public_tokenizers

    pieces = readers.read_tokenizer(spark, public_tokenizers.path("piece_bpe_32k.model"), mode="softmax")
    assert isinstance(pieces, PieceTokenizer)
    df = texts(spark, "a text of words", None)
    assert [r.text for r in pieces.using(mode="greedy").decode(pieces.ids(df)).orderBy("doc_id").collect()] == ["a text of words", ""]


def test_steps_are_taken_up_again(spark, tmp_path):
    ran = []

    def step(name):
        return lambda df: (ran.append(name), spark.range(3) if df is None else df.where("id > 0"))[1]

    steps = [(n, "k", step(n)) for n in ("a", "b")]
    assert Pipeline(steps, folder=f"file://{tmp_path}/out").run().count() == 2
    assert Pipeline(steps, folder=f"file://{tmp_path}/out").run().count() == 2 and ran == ["a", "b"]
    assert mode_of("codes") == "pinyin-code" and mode_of(" Initials") == "pinyin-initial"


def test_samples_and_limits(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"text": " ", "n": 5, "zeta": " z ", "alpha": "a"}\n\n{"prompt": "p", "x": "first"}\n{"n": 1, "y": null}\n')
    assert sorted(r.text for r in readers.read_samples(spark, f"file://{tmp_path}/s.jsonl").collect()) == ["p", "z"]
    kept, counts = counting.first_kept(spark.range(10), 4, F.col("id") % 2 == 0, "id")
    assert [r.id for r in kept.collect()] == [0, 2] and tuple(counts.first()) == (4, 2, 2)
    for n in ("b.txt", "a.txt", "c.md"):
        (tmp_path / n).write_text("x")
    assert [r.path.rpartition("/")[2] for r in readers.list_folder(spark, f"file://{tmp_path}").collect()] == ["a.txt", "b.txt"]
    both = readers.union_in_order([spark.range(2), spark.range(1)])
    assert sorted(map(tuple, both.select("part", "id").collect())) == [(0, 0), (0, 1), (1, 0)]


def test_head_and_tail(spark):
    rows = counting.head_and_tail(spark.range(10), 2, ("id", True)).collect()
    assert sorted((r.end, r.id) for r in rows) == [("head", 0), ("head", 1), ("tail", 8), ("tail", 9)]


def test_counts_of_raw_tokens_equal_counts_of_routed_ones(spark):
    from corpusloom.functions import text as T

    df = texts(spark, "The the ² 日本 x​​ A b <URL> THE ٣ ́ y", "​ q the")
    routed = counting.items(df, F.filter(F.transform(T.lex(F.col("text")), lambda t: T.route(t)), lambda x: x.isNotNull()))
    raw = counting.items(df, T.lex(F.col("text")))
    got = counting.kept_positions(counting.routed_counts(raw), raw)
    key = lambda d: sorted((r["class"], r["item"], r.cnt, r.first_doc, r.first_pos) for r in d.collect())
    assert key(got) == key(counting.classified_counts(routed))
    assert {r["item"]: r.cnt for r in got.collect()}["<NUM>"] == 2 and len(T.OTHER_DIGITS) > 50


def test_matrix_payload_is_exact_where_there_are_cases(spark):
    rows = spark.createDataFrame([("a", "1", 2), ("b", "blank", 3), ("c", "4", 6), ("d", "1", 1)], "pinyin string, tone string, length int")
    t, n = tones.tone_histogram(rows), tones.length_histogram(rows)
    exact = {(r.tone_bucket, r.length_bucket): (r.value, r.probability) for r in tones.payload(t, n, rows).collect()}
    assert exact["tone_1", "length_1_or_2"] == (2, 0.5) and sum(v for v, _ in exact.values()) == 4
    guess = {(r.tone_bucket, r.length_bucket): r.value for r in tones.payload(t, n).collect()}
    assert guess["tone_1", "length_1_or_2"] == pytest.approx(1.0)
    assert tones.printed(tones.tone_length_matrix(rows)).splitlines()[0].split() == ["tone", *tones.LENGTH_BUCKETS]
    assert metrics.parameter_count([(2, 3), (4,), ()]) == 11


def test_case_lines_are_sorted(spark, tmp_path):
    rows = spark.createDataFrame([("b", "y1", "1", 1), ("a", "z2", "2", 1), ("a", "y1", "1", 1)], "character string, pinyin string, tone string, length int")
    writers.write_cases(rows, f"file://{tmp_path}/c")
    lines = [json.loads(x) for p in sorted((tmp_path / "c").glob("part-*")) for x in p.read_text().splitlines()]
    assert [(x["character"], x["pinyin"]) for x in lines] == [("a", "y1"), ("a", "z2"), ("b", "y1")]


def test_negative_ids_are_refused(spark, tmp_path):
    made = chunks.chunk_stream(spark.createDataFrame([(1, [1, -2])], "doc_id long, ids array<int>"), 2)
    with pytest.raises(Exception, match="out of the range"):
        writers.write_binary_chunks(made, f"file://{tmp_path}/n", 2, 2)


def test_staged_tables(spark):
    import os

    @staging.scoped
    def made(df):
        first = staging.stage(df, "first")
        return staging.stage(first.where("id > 1"), "second").select("id")

    out = made(spark.range(5))
    folder = staging.shared_dir(spark).removeprefix("file:") + f"/corpusloom/{spark.sparkContext.applicationId}"
    names = [n for n in os.listdir(folder) if n.startswith(("first-", "second-"))]
    assert len([n for n in names if n.startswith("second-")]) == 1 and not [n for n in names if n.startswith("first-")]
    assert out.count() == 3
    assert staging.arrow_uri(spark, f"{folder}/plain").startswith("file:///") and os.path.isdir(f"{folder}/plain")


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session())


def test_splits_of_a_folder(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/train-0.jsonl").write_text('{"doc-id": "1", "text": "x"}\n')
    spark.createDataFrame([("2", "y")], "`doc-id` string, text string").write.parquet(f"file://{tmp_path}/d/test")
    got = [[(r["doc-id"], r.text) for r in readers.read_split(spark, f"file://{tmp_path}/d", s).collect()] for s in ("train", "test")]
    assert got == [[("1", "x")], [("2", "y")]]
    with pytest.raises(ValueError, match="split"):
        readers.read_split(spark, f"file://{tmp_path}/d", "dev")


def test_packed_lines_and_dry_runs(spark, tmp_path):
    from corpusloom.functions import arrays as A
    from corpusloom.functions import text as T

    df = texts(spark, "aa bb cc", "d", " ")
    packed = A.packed(F.col("text"), T.words(F.col("text")), 5)
    dry = writers.write_packed(df, f"file://{tmp_path}/p", F.col("text"), packed, "doc_id", dry_run=True)
    assert not (tmp_path / "p").exists() and dry["output_lines"] == 3 and dry["split_lines"] == 1
    assert writers.write_packed(df, f"file://{tmp_path}/p", F.col("text"), packed, "doc_id") == dry
    assert [x for p in sorted((tmp_path / "p").glob("part-*")) for x in p.read_text().splitlines()] == ["aa bb", "cc", "d"]


def test_chunk_kinds_and_detection(spark, tmp_path):
    made = chunks.chunk_stream(spark.createDataFrame([(1, [1, 2, 3, 4])], "doc_id long, ids array<int>"), 2)
    for kind in ("jsonl", "bin"):
        writers.write_chunks(made, f"file://{tmp_path}/{kind}", 2, 2, kind)
        assert sorted(r.input_ids for r in readers.read_token_dataset(spark, f"file://{tmp_path}/{kind}").collect()) == [[1, 2], [3, 4]]
    with pytest.raises(ValueError):
        writers.write_chunks(made, "x", 2, 2, "csv")


def test_inspection(spark, tokenizer):
    rows = tokenizer.inspect(texts(spark, "W6M7 hello", "zzz", "b"), 2, raw=False).collect()
    assert [r.tokens for r in rows] == [["W6M7", "hello"], ["<unk>"]] and rows[1].ids == [1]


def test_offsets_of_long_texts_do_not_overflow(spark):
    from corpusloom.functions import arrays as A

    spans = spark.range(1).select(A.spread_offsets(F.lit(30_000), F.lit(200_000)).alias("s")).first().s
    assert tuple(spans[-1]) == (199_993, 200_000)


def test_invalid_items_are_named(spark):
    from corpusloom.operators.vocabulary import require_valid

    rows = spark.createDataFrame([("valid", "a", 1, 1, 0), ("invalid", "\x01", 2, 3, 4)], "class string, item string, cnt long, first_doc long, first_pos int")
    require_valid(rows.where("class = 'valid'"))
    with pytest.raises(ValueError, match="document 3, position 4"):
        require_valid(rows)


def test_running_sums_of_a_hot_key(spark):
    rows = spark.range(2_000).selectExpr("id as step", "if(id % 10 = 0, null, 'hot') as run", "id % 7 as tokens").repartition(5)
    got = {(r.run, r.step): r.offset for r in chunks.prefix_offsets(rows, F.col("tokens"), "step", by=("run",)).collect()}
    seen = {}
    for i in range(2_000):
        run = None if i % 10 == 0 else "hot"
        assert got[run, i] == seen.get(run, 0)
        seen[run] = seen.get(run, 0) + i % 7
    groups = metrics.accumulation_groups(rows, 7, "step", "run").where("run = 'hot'").groupBy("step").count()
    assert groups.agg(F.max("count")).first()[0] == 7


def test_vocabulary_joins_leave_broadcasts_to_measured_sizes(spark, tokenizer):
    from corpusloom.operators import vocabulary

    rows = spark.createDataFrame([("W6M7",), ("zzz",)], "item string")
    assert "ResolvedHint" not in vocabulary.to_ids(rows, tokenizer.vocabulary)._jdf.queryExecution().analyzed().toString()
