import json

import numpy as np
import pytest

from corpusloom.operators import chunks
from corpusloom.sources import readers, writers


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('﻿{"doc-id": "1", "text": "x", "extra": 3}\n\n{"doc-id": "2", "text": null}\n', encoding="utf-8")
    rows = readers.read_jsonl(spark, str(path))
    assert [(r["doc-id"], r.text) for r in readers.null_text(rows).orderBy("doc-id").collect()] == [("1", "x"), ("2", "None")]
    path.write_text('{"doc-id": "1"}\n{bad\n')
    with pytest.raises(Exception):  # noqa: B017
        readers.read_jsonl(spark, str(path)).collect()


def test_lines_and_items(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿one two\n\n  three　four \n", encoding="utf-8")
    (tmp_path / "b.md").write_text("no")
    rows = readers.read_lines(spark, str(tmp_path / "a.txt")).orderBy("line_number").collect()
    assert [(r.line_number, r.value) for r in rows] == [(1, "one two"), (2, ""), (3, "  three　four ")]
    items = readers.read_items(spark, str(tmp_path / "a.txt")).orderBy("line_number", "pos").collect()
    assert [(r.line_number, r.item) for r in items] == [(1, "one"), (1, "two"), (3, "three"), (3, "four")]
    assert readers.read_documents(spark, str(tmp_path / "a.txt")).count() == 2
    assert readers.read_folder(spark, str(tmp_path)).count() == 3


def test_samples(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"text": " ", "hanzi": "h"}\n{"prompt": "p"}\n')
    assert sorted(r.text for r in readers.read_samples(spark, str(tmp_path / "s.jsonl")).collect()) == ["h", "p"]


def test_binary_chunks_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, [1, 2, 3, 4, 0]), (2, [5, 6, 7, 8, 0])], "doc_id long, ids array<int>")
    made = chunks.chunk_stream(docs, 4, 4)
    path = f"file://{tmp_path}/bin"
    meta = writers.write_binary_chunks(made, path, 4, 4)
    assert meta["num_examples"] == 2 and meta["max_token_id"] == 7
    got = readers.read_binary_chunks(spark, path).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.input_ids) for r in got] == [(0, [1, 2, 3, 4]), (1, [0, 5, 6, 7])]
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "bin").glob("*.bin"), key=lambda p: int(p.stem[5:])))
    assert np.frombuffer(raw, "<i4").tolist() == [1, 2, 3, 4, 0, 5, 6, 7]


def test_chunk_files_are_checked(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"input_ids": [1, -2]}\n')
    with pytest.raises(ValueError, match="not valid"):
        readers.read_chunks(spark, str(tmp_path / "c.jsonl"))


def test_vocabulary_files(spark, tmp_path):
    v = spark.createDataFrame([("<pad>", 0, None), ("A1", 1, 2.0)], "token string, token_id int, score double")
    writers.write_vocabulary(v, f"file://{tmp_path}/v")
    assert json.loads((tmp_path / "v/token_scores.json").read_text()) == {"A1": 2.0}
    assert readers.read_vocabulary(spark, f"file://{tmp_path}/v/vocab.json").count() == 2
    (tmp_path / "bad.json").write_text('{"a": 0, "b": 2}')
    with pytest.raises(ValueError, match="gaps"):
        readers.read_vocabulary(spark, f"file://{tmp_path}/bad.json")
    assert readers.resolve_scores(None, None, [{"token": "A1", "frequency": 3}]) == {"A1": 3.0}


def test_ordered_lines(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "cast(99 - id as string) as v").repartition(7)
    writers.write_lines(rows, f"file://{tmp_path}/lines", "v", "id")
    parts = sorted((tmp_path / "lines").glob("part-*"))
    assert [x for p in parts for x in p.read_text().split()] == [str(99 - i) for i in range(100)]


def test_preferences_are_checked(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"prompt": "a", "chosen": "b", "rejected": "c"}\n')
    assert readers.read_preferences(spark, str(tmp_path / "p.jsonl")).count() == 1
    (tmp_path / "p.jsonl").write_text('{"prompt": "a", "chosen": "b", "rejected": " b "}\n')
    with pytest.raises(ValueError, match="equals"):
        readers.read_preferences(spark, str(tmp_path / "p.jsonl"))


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    for n, name in ((5_000, "big.txt"), (3, "small.txt"), (0, "empty.txt")):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" + ("\n" if i % 7 == 0 else "") for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.read_lines(spark, f"file://{tmp_path}/*.txt").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name in ("big.txt", "small.txt", "empty.txt"):
        got = [r.value for r in sorted((r for r in rows if r.path.endswith(name)), key=lambda r: r.line_number)]
        assert got == (tmp_path / name).read_text().split("\n")[:-1] and {r.line_number for r in rows if r.path.endswith(name)} == set(range(1, len(got) + 1))
