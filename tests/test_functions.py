import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import maths as M
from corpusloom.functions import text as T


def value(spark, expression, **columns):
    return spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in columns.items())).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("题干：A. yes 3", "<QUESTION> A . <YES> <NUM>"),
        (
            "hello iPhone12 5G SM-T29 Café mā ɡe 《》~ ^_^ 1280*800 http://example.com ​",
            "hello iphone12 5g sm-t29 café mā ɡe 《 》 ~ ^ _ ^ <NUM> * <NUM> <URL>",
        ),
        ("$$x\ny$$ （ ） no.", "<MATH> <BLANK> <NO> ."),
        ("", ""),
    ],
)
def test_process(spark, text, tokens):
    assert value(spark, F.array_join(T.process(F.col("t")), " "), t=text) == tokens


@pytest.mark.parametrize(("text", "out"), [("A. yes 3", "A . <YES> <NUM>"), ("W6M7 Y6", "W6M7 Y6")])
def test_preprocess_once(spark, text, out):
    once = T.preprocess_once(F.col("t"))
    assert value(spark, once, t=text) == out
    assert value(spark, once, t=out) == out


@pytest.mark.parametrize(("syllable", "atom"), [("yi3", "Y6"), ("jing1", "J3"), ("hen3", "H7"), ("wan3", "W7"), ("le", "L6"), ("wo3", "W6"), ("men", "M7"), ("zhong1", "Z4"), ("guo2", "g2"), ("X!", "X6")])
def test_syllable_atoms(spark, syllable, atom):
    assert value(spark, T.syllable_atom(F.col("s")), s=syllable) == atom


def test_word_codes(spark):
    assert value(spark, T.word_code(F.col("s")), s=["zhong1", "guo2"]) == "Z4g2"
    assert value(spark, T.word_code(F.col("s"), "pinyin-initial"), s=["zhong1", "guo2"]) == "zg"


def test_hanzi(spark):
    assert value(spark, T.hanzi_spans(F.col("t")), t="abc我们 x 好") == ["我们", "好"]
    assert value(spark, T.has_hanzi(F.col("t")), t="abc") is False


def test_packing(spark):
    lines = lambda t, n: value(spark, A.packed(F.col("t"), T.words(F.col("t")), n), t=t)
    assert lines("aa bb cc dd ee ff", 10) == ["aa bb cc", "dd ee ff"]
    assert lines("  short ", 10) == ["short"]
    assert lines("   ", 10) == []
    with pytest.raises(Exception, match="longer than the limit"):
        lines("abcdefghijklm no", 10)


def test_packing_equals_a_loop(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", A.packed(F.col("text"), T.words(F.col("text")), 80).alias("p")).collect()
    for r in rows:
        out, words = [], r.text.split()
        if len(r.text.strip()) <= 80:
            assert r.p == ([r.text.strip()] if r.text.strip() else [])
            continue
        for w in words:
            if out and len(out[-1]) + 1 + len(w) <= 80:
                out[-1] += " " + w
            else:
                out.append(w)
        assert r.p == out


def test_prompt_and_completion(spark):
    x = value(spark, A.prompt_and_completion(F.col("p"), F.col("c"), 8), p=[1, 2], c=[3, 4])
    assert (x.ids, x["mask"]) == ([1, 2, 3, 4], [False, False, True, True])
    x = value(spark, A.prompt_and_completion(F.col("p"), F.col("c"), 4), p=[1, 2, 3, 4, 5], c=[6, 7])
    assert (x.ids, x["mask"]) == ([3, 4, 5, 6], [False, False, False, True])


def test_masks_and_frames(spark):
    assert value(spark, A.masked_labels(F.col("l"), F.col("m")), l=[1, 2, 3], m=[1, 1, 0]) == [1, 2, -100]
    x = value(spark, A.framed(F.col("a"), 2, 3, F.col("b")), a=[7], b=[8, 9])
    assert (x.ids, x.special) == ([2, 7, 3, 2, 8, 9, 3], [1, 0, 1, 1, 0, 0, 1])
    assert value(spark, A.joined(F.col("t")), t=["Y0J7", "X4", "Q3", "ok"]) == "Y0J7 X4Q3 ok"
    assert value(spark, A.joined(F.col("t"), True), t=["Y0J7", "X4", "Q3"]) == "Y0J7 X4 Q3"
    assert value(spark, A.atoms(F.col("w")), w="Y0J7X4") == ["Y0", "J7", "X4"]


def test_learning_rate(spark):
    rate = M.learning_rate(F.col("s"), 6, 1.0, 0.1, 2)
    assert [round(value(spark, rate, s=s), 6) for s in (1, 2, 6)] == [0.5, 1.0, 0.1]
    assert value(spark, M.learning_rate(F.col("s"), 6, 1.0, 0.1, 2, "constant"), s=5) == 1.0


def test_preference_loss_is_stable(spark):
    loss = lambda x: value(spark, M.preference_loss(F.col("p"), F.lit(0.0), 1.0), p=x)
    assert loss(0.0) == pytest.approx(math.log(2))
    assert loss(-1000.0) == pytest.approx(1000.0)
    assert loss(1000.0) == pytest.approx(0.0)
    assert value(spark, M.masked_sum(F.col("v"), F.col("m")), v=[-1.0, -2.0, -4.0], m=[False, True, True]) == -6.0
    with pytest.raises(Exception, match="no tokens"):
        value(spark, M.masked_sum(F.col("v"), F.col("m")), v=[-1.0], m=[False])


def test_clip_and_latex(spark):
    assert value(spark, T.clip(F.col("t")), t="a " * 200) == ("a " * 200).strip()[:177] + "..."
    assert value(spark, T.latex(F.col("t")), t="50% {a_b}\\") == r"50\% \{a\_b\}\textbackslash{}"


def test_buckets_refuse_what_they_do_not_know(spark):
    assert value(spark, T.length_bucket(F.col("n")), n=5) == "length_4_to_6"
    with pytest.raises(Exception, match="unsupported length"):
        value(spark, T.length_bucket(F.col("n")), n=7)
