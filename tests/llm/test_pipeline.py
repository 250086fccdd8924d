"""The pipeline's stages against brute-force versions of what each has to do with its own input."""

from collections import Counter

import numpy as np
from test_llm_operators import brute_groups, brute_lines, brute_quality, words

import corpus_pipeline
from corpusloom.llm._pretokens import tokenizer_path
from corpusloom.llm.sentencepiece_codec import Codec


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    schema, held = docs.schema, [[(r.doc_id, r.text, r.source) for r in docs.collect()]]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in schema]
            held.append([(r.doc_id, r.text, r.source) for r in docs.collect()])
    raw, good, lined, single, mixed = held

    assert set(good) <= set(raw) and len(good) > 0.7 * len(raw)
    assert all(n >= 20 and 100 * r <= 30 * n for n, _, _, _, r in (brute_quality(t) for _, t, _ in good))

    drops, want = brute_lines([(d, t) for d, t, _ in good]), set()
    for i, (d, t, s) in enumerate(good):
        lines = t.split("\n")
        text = "\n".join(x for n, x in enumerate(lines) if n not in drops[i])
        if words(text):
            want.add((d, text, s))
    assert set(lined) == want

    groups = brute_groups([(d, t) for d, t, _ in lined], 5)
    assert {d for d, *_ in single} == {d for d, _, c in groups if d == c}

    times = Counter(mixed)
    assert set(times) <= set(single) and max(times.values()) <= 2

    codec = Codec(tokenizer_path("piece_bpe_32k.model"))
    rows = docs.collect()
    assert len(rows) == len(mixed)
    assert Counter((r.doc_id, codec.decode(np.array(r.ids, np.uint16))) for r in rows) == Counter((d, t) for d, t, _ in mixed)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(rows)


def test_stages_with_hostile_rows_and_none(spark, sf_dir):
    """Nulls, blank and repeated rows and a very long text go through every stage; an empty table gives no rows in any."""
    long = " ".join(f"w{i % 997} x{i}" for i in range(20_000))
    rows = [
        (1, "one two three four five six " * 6, "en", "b", 5), (1, "one two three four five six " * 6, "en", "b", 5), (2, None, "en", "a", None), (3, "", "en", None, 0), (4, " \n\t ", None, "c", 4),
        (None, "a row without an id that has several words in it", "en", "c", 48), (None, None, None, None, None), (5, long, "en", "a", len(long)), (6, "Ünïcödé — 日本 ▁ tab\tline\r\nend " * 9, "xx", "\U0001f600", 9),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    given, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert labels.count()
    ids = {r[0] for r in rows}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out, nothing = stage(spark, given, sf_dir), stage(spark, none, sf_dir)
        assert nothing.count() == 0, name
        got = out.collect()
        assert {r.doc_id for r in got} <= ids, name
        if n < 4:
            assert out.columns == given.columns, name
        if name == "quality rules":
            assert all(r.text and len(words(r.text)) >= 20 for r in got)
        if name == "line dedup":
            assert {2, 3} <= {r.doc_id for r in got} and (1, rows[0][1]) in {(r.doc_id, r.text) for r in got}
        if name == "near dedup":
            assert sorted(str(r.doc_id) for r in got) == sorted(["1", "2", "3", "4", "5", "6", "None", "None"])
        if name == "piece encoding":
            codec = Codec(tokenizer_path("piece_bpe_32k.model"))
            assert Counter((r.doc_id, codec.decode(np.array(r.ids, np.uint16))) for r in got) == Counter((d, t or "") for d, t, *_ in rows)
