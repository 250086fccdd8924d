import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunks, counting, metrics, preferences, tones, vocabulary
from corpusloom.plans.pipeline import Pipeline, mode_of, run_matrix


def vocab(spark, scores):
    return spark.createDataFrame([(t, i, float(s)) for i, (t, s) in enumerate(scores.items())], "token string, token_id int, score double")


def words(spark, *items):
    return spark.createDataFrame([(w,) for w in items], "word string")


def test_greedy(spark):
    base = dict.fromkeys(("H7", "W7", "L6", "H7W7", "W7L6"), 0)
    cut = lambda v, w: vocabulary.segment_greedy(words(spark, w), vocab(spark, v)).first().pieces
    assert cut(base, "H7W7L6") == ["H7W7", "L6"]
    assert cut(base | {"H7W7L6": 0}, "H7W7L6") == ["H7W7L6"]
    assert cut(base, "X1H7") == ["X1", "H7"]


def test_strict_mode_names_the_place(spark):
    with pytest.raises(Exception, match="C3.*atom 0.*greedy"):
        vocabulary.segment_greedy(words(spark, "C3"), vocab(spark, {"A1": 0, "B2": 0}), strict=True).collect()


def test_softmax_covers_the_word_and_follows_temperature(spark):
    rows = spark.createDataFrame([(i, "A1B2") for i in range(400)], "id long, word string")
    v = vocab(spark, {"A1": 0, "B2": 0, "A1B2": 0})
    share = {}
    for tau in (0.2, 5.0):
        got = [r.pieces for r in vocabulary.segment_softmax(rows, v, 3, alpha=0.0, beta=1.0, temperature=tau).collect()]
        assert all("".join(p) == "A1B2" for p in got)
        share[tau] = sum(len(p) == 1 for p in got) / len(got)
    assert share[0.2] > 0.9 and share[0.2] - share[5.0] > 0.15


@pytest.mark.parametrize("bad", [{"mode": "beam"}, {"temperature": 0}, {"temperature": -1}, {"alpha": float("nan")}, {"beta": float("inf")}])
def test_parameters(bad):
    with pytest.raises(ValueError):
        vocabulary.check_parameters(**bad)
    assert vocabulary.check_parameters(" SOFTMAX ") == "softmax"


def test_vocabulary_order_and_limits(spark):
    counts = spark.createDataFrame([("encoded", "Y0J7", 2), ("encoded", "H2", 1), ("preserved", "b", 1), ("preserved", "a", 9)], "class string, item string, cnt long")
    found = {r.token: r.token_id for r in vocabulary.build_vocabulary(spark, counts, 600, 2).collect()}
    assert [found[t] for t in vocabulary.FIXED_TOKENS] == [0, 1, 2, 3, 4]
    assert (found["a"], found["b"], found["A0"], found["Y0J7"]) == (15, 16, 17, 537)
    with pytest.raises(ValueError, match="exceeds"):
        vocabulary.build_vocabulary(spark, counts, 100)
    assert vocabulary.infer_merges(["a", "b", "ab", "abb"]) == [("a", "b"), ("ab", "b")]


@pytest.mark.parametrize(("block", "stride"), [(4, 4), (4, 3), (5, 1), (3, 2)])
def test_chunks_equal_a_buffer(spark, block, stride):
    docs = [(i, list(range(i * 10, i * 10 + i % 7))) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, ids array<int>").repartition(5)
    buffer, want = [], []
    for _, ids in docs:
        for x in ids:
            buffer.append(x)
            if len(buffer) == block:
                want.append(list(buffer))
                del buffer[:stride]
    got = [r.input_ids for r in chunks.chunk_stream(frame, block, stride).orderBy("chunk_id").collect()]
    assert got == want
    s = chunks.chunk_statistics(frame, block, stride).first()
    assert (s.num_examples, s.dropped_tail_tokens) == (len(want), len(buffer))


def test_chunk_arguments():
    with pytest.raises(ValueError, match="stride must"):
        chunks.check_chunk_arguments(2, 3)


def test_compatibility(spark):
    frame = spark.createDataFrame([([0, 1, 4],)], "input_ids array<int>")
    with pytest.raises(ValueError, match="vocab_size"):
        chunks.check_compatible(frame, 4, 8)
    with pytest.raises(ValueError, match="block_size"):
        chunks.check_compatible(frame, 5, 2)


def test_splits(spark):
    one = spark.createDataFrame([(1,)], "doc_id long")
    with pytest.raises(ValueError, match="At least two"):
        chunks.exact_split(one, 0.5)
    assert chunks.exact_split(one, 0.5, zero=True).count() == 2
    many = spark.range(100).withColumnRenamed("id", "doc_id")
    assert chunks.exact_split(many, 0.25).where("split = 'validation'").count() == 25
    with pytest.raises(ValueError):
        chunks.bernoulli_split(many, 1.0)


def test_tone_report(spark):
    rows = spark.createDataFrame([("a", "1", 2), ("b", "blank", 3), ("c", "4", 6)], "pinyin string, tone string, length int")
    t, n = tones.tone_histogram(rows), tones.length_histogram(rows)
    text = tones.latex_table(t, n, 3)
    assert "1 & 1 & 33.33 & 2 & 1 & 33.33" in text and "blank & 1 & 33.33 &  &  & " in text
    with pytest.raises(ValueError, match="totals"):
        tones.latex_table(t, n, 4)
    assert tones.tone_histogram(rows.limit(0)).agg(F.sum("percentage")).first()[0] == 0


def test_preferences(spark):
    good = spark.createDataFrame([(1, "p", "c", "r", [1]), (2, " ", "c", "c", [-1])], "k long, prompt string, chosen string, rejected string, prompt_ids array<int>")
    assert {(r.k, r.rule) for r in preferences.violations(good, "k").collect()} == {(2, "prompt is blank"), (2, "chosen equals rejected"), (2, "prompt_ids has bad ids")}
    with pytest.raises(ValueError, match="bad preference"):
        preferences.require_valid(good, "k")
    pairs = spark.createDataFrame([(-3.0, -5.0, -4.0, -4.0)], "policy_chosen double, policy_rejected double, reference_chosen double, reference_rejected double")
    worse = spark.createDataFrame([(-5.0, -4.0, -4.0, -4.0)], pairs.schema)
    a, b = preferences.accuracy(pairs).first(), preferences.accuracy(worse).first()
    assert a.accuracy == 1.0 and b.accuracy == 0.0 and a.mean_loss < b.mean_loss


def test_checkpoints(spark):
    steps = spark.createDataFrame([(1, 600_000), (2, 1_900_000)], "step long, tokens long").withColumn("run", F.lit("x"))
    got = metrics.checkpoints(steps, "tokens", "step", "run").orderBy("target").collect()
    assert [(r.step, r.target, r.name) for r in got] == [(2, 1_000_000, "chck_1M"), (2, 2_000_000, "chck_2M")]
    saved = spark.createDataFrame([(1_000_000,)], "target long")
    assert [r.target for r in metrics.pending(got and spark.createDataFrame([(r.target,) for r in got], "target long"), saved).collect()] == [2_000_000]
    assert metrics.CHECKPOINT_TARGETS[-1] == 100_000_000 and len(metrics.CHECKPOINT_TARGETS) == 19


def test_pipeline_steps(spark, capsys):
    ran = []
    step = lambda n: lambda df: (ran.append(n), df)[1] if df is not None else (ran.append(n), spark.range(1))[1]
    p = Pipeline([(n, "k", step(n)) for n in ("a", "b", "c")])
    p.run(start_at="b", stop_after="c")
    p.run(start_at="b", stop_after="b")
    assert ran == ["b", "c"]
    p.run(dry_run=True)
    assert capsys.readouterr().out == "a (k)\nb (k)\nc (k)\n"
    with pytest.raises(ValueError):
        p.selected("c", "a")
    assert run_matrix(["x", "y"], ["g"], "m") == [("x", "g", "m-x-g"), ("y", "g", "m-y-g")]
    assert mode_of(" Initial ") == "pinyin-initial"


def test_next_tokens(spark):
    from corpusloom.operators import sampling

    rows = spark.range(600).withColumnRenamed("id", "step").crossJoin(spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 1.0), (3, -9.0)], "token int, logit double"))
    share = {r.token: r["count"] / 600 for r in sampling.choose(rows, 1.0, 1, seed=1).groupBy("token").count().collect()}
    assert set(share) == {1, 2} and abs(share[1] - 0.5) < 0.08
    assert {r.token for r in sampling.choose(rows, 0.0).collect()} == {1}


def test_zip_and_atoms(spark):
    from corpusloom.functions import arrays as A

    rows = spark.createDataFrame([(["a", "b", "c"], ["x1", "y2"])], "characters array<string>, syllables array<string>")
    assert [tuple(r) for r in tones.zipped_cases(rows).collect()] == [("a", "x1"), ("b", "y2")]
    assert rows.select(A.expand_atoms(F.array(F.lit("A1B2"), F.lit("ok"))).alias("x")).first().x == ["A1", "B2", "ok"]


def test_piece_round_trip(spark, sf_dir):
    from corpusloom.plans import queries

    assert queries.QUERIES["piece_round_trip"](spark, sf_dir).where("not same").count() == 0


@pytest.mark.parametrize("kept", ["class <> 'invalid'", "class = 'preserved'"])
def test_filters_on_classes_stay_above_the_count(spark, kept):
    docs = spark.createDataFrame([(1, "A b <URL> 3")], "doc_id long, text string")
    counts = counting.routed_counts(counting.items(docs, T.lex(F.col("text")))).where(kept).select("item", "cnt", "first_pos")
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and "RLIKE" not in plan[plan.rindex("Aggregate [item") :]
    assert {(r.item, r.cnt, r.first_pos) for r in counts.collect()} == {("A", 1, 0), ("B", 1, 1)} | ({("<URL>", 1, 2), ("<NUM>", 1, 3)} if "invalid" in kept else set())


def test_first_places_of_any_order(spark):
    docs = [(2**62, "a"), (-5, "x b a"), (-5, "b x"), (2**31, "c d"), (2**31 - 1, "x d"), (-(2**31), "f"), (-(2**31) - 1, "x f"), (-(2**63), "g"), (0, "h"), (None, "g i")]
    rows = counting.items(spark.createDataFrame(docs, "doc_id long, text string"), T.words(F.col("text")))
    got = {r.item: (r.cnt, r.first_doc, r.first_pos) for r in counting.classified_counts(rows).collect()}
    want = {}
    for d, text in docs:
        for k, w in enumerate(text.split()):
            cnt, at = want.get(w, (0, None))
            want[w] = (cnt + 1, at if d is None else min(at or (d, k), (d, k)))
    assert got == {w: (cnt, *(at or (None, None))) for w, (cnt, at) in want.items()}
    assert [r.item for r in counting.most_common(counting.classified_counts(rows.where("item in ('f', 'g', 'h')")), 3).collect()] == ["g", "f", "h"]
