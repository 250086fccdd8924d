"""Each operator against a brute-force version, on hostile rows and on a small table."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ann, line_dedup, lm_scoring, minhash, mixing, quality, queries, sentencepiece_codec, token_counts, token_output, toxicity
from corpusloom.llm._pretokens import encoder, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LONG = " ".join(f"w{i % 997} x{i}" for i in range(20_000))
HOSTILE = [
    (1, "one two three four five six seven eight nine ten", "en", "b"), (1, "one two three four five six seven eight nine ten", "en", "b"),
    (1, "another text under the same id, longer than twenty characters", "en", "a"), (2, None, "en", "a"), (3, "", "en", None), (4, " \n\t ", None, "c"),
    (None, "a row without an id that has several words in it", "en", "c"), (None, None, None, None), (5, LONG, "en", "a"),
    (6, "Ünïcödé — 日本 ▁ \x1c tab\tline\r\nend \U0001f600 <|endoftext|>", "xx", "\U0001f600"), (7, "one two three four five six seven eight nine ten", "en", "b"),
]
#: Texts with the added token of the byte-level tokenizer: alone, doubled, beside spaces and inside words.
SPECIAL = ["<|endoftext|>", "<|endoftext|><|endoftext|>", "a <|endoftext|> b", " <|endoftext|>\n\n <|endoftext|>", "x<|endoftext|>y  z<|endoftext", "é <|endoftext|>\t日本  <|endoftext|>", "<|endoftext<|endoftext|>|>"]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def hostile(spark):
    rows = spark.createDataFrame(HOSTILE, SCHEMA)
    return rows.select("*", *(F.lit(1).alias(c) for c in ("key", "hash", "id", "size", "n", "row", "ids", "did", "drop", "n_dropped", "_hash", "_size", "units", "y", "block", "v", "w")))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text):
    return WORD.findall(text or "")


# ---------------------------------------------------------------- mixing


def check_mix(rows, tolerance):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        whole = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / whole > 2 * sizes[s]]
        if not over:
            target |= {s: rest * weight[s] / whole for s in free}
            break
        for s in over:
            target[s] = 2 * sizes[s]
            rest -= target[s]
            free.discard(s)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= tolerance(s, [r.size for r in rows if r.source == s])


def test_mix(spark, sf_dir):
    rows = queries.QUERIES["op1_mix_sources"](spark, sf_dir).collect()
    check_mix(rows, lambda s, sizes: max(sizes) / 2)
    again = queries.QUERIES["op1_mix_sources"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in again)


def test_mix_over_several_levels(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source", "cast(pmod(xxhash64(id), 50) as long) as size")
    for limit in (2000, 0):
        mixing.BROADCAST_SOURCES, kept = limit, mixing.BROADCAST_SOURCES
        plan = mixing.plan_copies(rows, block=8).withColumn("taken", F.col("copies") * F.col("size")).collect()
        mixing.BROADCAST_SOURCES = kept
        check_mix(plan, lambda s, sizes: 50)


def test_small_sources_are_settled_in_their_own_last_block(spark):
    draw = random.Random(3)
    rows = [(i, "small", int(draw.lognormvariate(5, 1)) + 1) for i in range(100)] + [(100, "small", 20_000)]
    rows += [(1000 + i, "large", draw.randint(1, 200)) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long")
    for seed in range(4):
        plan = mixing.plan_copies(frame, seed=seed).withColumn("taken", F.col("copies") * F.col("size")).collect()
        check_mix(plan, lambda s, sizes: 50)


def test_pivotal_rounding_is_unbiased(spark):
    rows = spark.range(40).selectExpr("id as doc_id", "if(id < 20, 'a', 'b') as source", "id % 5 + 1 as size")
    taken, ratio = Counter(), {}
    for seed in range(12):
        for r in mixing.plan_copies(rows, seed=seed).collect():
            taken[r.source, r.size] += r.copies
            ratio[r.source] = r.target / r.source_size
    for (source, _), n in taken.items():
        assert n / (12 * 4) == pytest.approx(ratio[source], abs=0.35)


def test_mixed_rows(hostile, empty):
    out = mixing.mix_sources(hostile)
    assert out.columns == hostile.columns
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    assert all(n <= 2 * sum((d, t) == k for d, t, *_ in HOSTILE) for k, n in kept.items())
    assert mixing.mix_sources(empty).count() == 0


# ---------------------------------------------------------------- neighbours


def test_neighbours(spark, sf_dir):
    rows = queries.QUERIES["op2_nearest_neighbours"](spark, sf_dir).collect()
    given = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    ids, vectors = np.array([g[0] for g in given]), np.stack([g[1] for g in given])
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(1))
        best = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(s == pytest.approx(d[ids == v][0], rel=1e-12) for _, v, s in mine)
        hits, total = hits + len({m[1] for m in mine} & set(best)), total + 10
    assert hits / total >= 0.9


def test_neighbours_in_many_blocks(spark):
    draw = np.random.default_rng(0)
    vectors = draw.normal(size=(600, 6))
    vectors[300:450] = vectors[0]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>")
    got = defaultdict(list)
    for r in ann.nearest(frame, frame.where("id % 50 = 0"), k=5, block=32).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    hits = 0
    for q in range(0, 600, 50):
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        best = [int(i) for i in np.lexsort((np.arange(600), d)) if i != q][:5]
        hits += len(set(best) & {v for _, v in got[q]})
    assert hits >= 0.9 * 60


def test_recall_on_a_larger_table(spark):
    path = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op2_nearest_neighbours"](spark, path).collect()
    given = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    ids, vectors = np.array([g[0] for g in given]), np.stack([g[1] for g in given])
    mine, hits, total = defaultdict(set), 0, 0
    for r in rows:
        mine[r.query_id].add(r.vec_id)
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(1))
        best = {int(ids[i]) for i in np.lexsort((ids, d))[:11] if ids[i] != q}
        hits, total = hits + len(mine[q] & best), total + 10
    assert hits / total >= 0.9


def test_little_is_written_twice(spark, monkeypatch):
    """Crowded cells are dealt and much met ones written again, and the rest of the vectors stays as it is."""
    draw = np.random.default_rng(2)
    vectors = np.concatenate([draw.normal(size=(900, 6)), 0.01 * draw.normal(size=(300, 6))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>")
    monkeypatch.setattr(ann, "ROWS", 100)
    monkeypatch.setattr(ann, "QUERIES", 30)
    written, real = [], ann._dealt

    def dealt(*sides):
        out = real(*sides)
        written.append((out[0].count(), out[1].count()))
        return out

    monkeypatch.setattr(ann, "_dealt", dealt)
    got = defaultdict(set)
    for r in ann.nearest(frame, frame.where("id % 20 = 0"), k=5, block=32).collect():
        got[r.query_id].add(r.vec_id)
    assert all(a <= 3 * 1200 and b <= 60 * 64 for a, b in written), written
    hits = 0
    for q in range(0, 1200, 20):
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        hits += len({int(i) for i in np.lexsort((np.arange(1200), d))[:6] if i != q} & got[q])
    assert hits >= 0.9 * 300


def test_clashing_columns_of_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i + 1), 1.0], 0, 0, 0, 0, 0, 0) for i in range(30)], "vec_id long, embedding array<double>, id int, v int, cell int, block int, h1 int, rank int")
    usable = ann.usable(rows, "vec_id", "embedding")
    assert [(r.rank, r.vec_id) for r in ann.nearest(usable, usable.where("id = 0"), k=2).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [2.0, 0.0]), (8, [2.0, 0.0]), (100, [1.0, 0.0])]
    usable = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(usable, usable.where("id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100, 0.0), (0, 2, 7, 1.0), (0, 3, 8, 1.0), (100, 1, 0, 0.0), (100, 2, 7, 1.0), (100, 3, 8, 1.0)]
    assert ann.nearest(usable.limit(0), usable.limit(0)).count() == 0


def test_chi_square():
    assert ann.chi2_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)


# ---------------------------------------------------------------- token counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, hostile, rule):
    path = tokenizer_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    cuts = lambda text: np.array(sorted({0, *range(3, len(text), 7)}))
    given = [(t or "")[:4000] for _, t, *_ in HOSTILE] + SPECIAL
    rows = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {(r.doc_id, r.section): r for r in token_counts.count_tokens(rows, path, rule, cuts).collect()}
    for i, text in enumerate(given):
        starts = cuts(text).tolist()
        want, crossing = Counter(), Counter()
        section = lambda x, s=starts: max(k for k, a in enumerate(s) if a <= x)
        for a, b in plain.encode(text, add_special_tokens=False).offsets:
            share = Counter(section(x) for x in range(a, max(b, a + 1)))
            owner = {"start": min(share), "end": max(share), "most": min(share, key=lambda k: (-share[k], k))}[rule]
            want[owner] += 1
            crossing[owner] += len(share) > 1
        for k, a in enumerate(starts):
            r = got.pop((i, k))
            assert (r.start, r.n_tokens, r.n_crossing) == (a, want[k], crossing[k])
    assert not got
    assert token_counts.count_tokens(hostile, path).groupBy("doc_id").count().count() == 8


def test_token_counts_of_nothing(empty):
    assert token_counts.count_tokens(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(empty, tokenizer_path("byte_bpe_50k.json"), "half")


# ---------------------------------------------------------------- line dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_edit_distance(spark, most):
    draw = random.Random(most)
    pairs = [("", ""), ("", "a"), ("é", "e"), ("\U0001f600a", "\U0001f601a")]
    for _ in range(300):
        a = [draw.choice("abcé") for _ in range(draw.randint(0, 12))]
        b = list(a)
        for _ in range(draw.randint(0, 4)):
            at = draw.randint(0, len(b))
            b[at : at + draw.randint(0, 1)] = [draw.choice("abcé")] * draw.randint(0, 1)
        pairs.append(("".join(a), "".join(b)))
    for r in spark.createDataFrame(pairs, "a string, b string").withColumn("d", line_dedup.edit_distance("a", "b", most)).collect():
        d = edits(r.a, r.b)
        assert r.d == (d if d <= most else None), r


def brute_lines(rows):
    places = sorted(((d is not None, d or 0, t), i) for i, (d, t) in enumerate(rows))
    first, seen, dropped = {}, {}, {}
    for n, (_, i) in enumerate(places):
        for pos, line in enumerate((rows[i][1] or "").split("\n")):
            if words(line):
                first.setdefault(line, (n, pos))
    late = {b for a, b in itertools.permutations(first, 2) if first[a] < first[b] and len(a) >= 20 <= len(b) and abs(len(a) - len(b)) < 2 and edits(a, b) <= 1}
    for n, (_, i) in enumerate(places):
        dropped[i] = {pos for pos, line in enumerate((rows[i][1] or "").split("\n")) if words(line) and (line in late or first[line] != (n, pos))}
    return dropped


@pytest.mark.parametrize(("crowd", "limit"), [(24, None), (1, 0), (2, None)])
def test_line_dedup(spark, crowd, limit):
    draw = random.Random(5)
    base = ["".join(draw.choice("abcdefgh ") for _ in range(n)) for n in (20, 21, 25, 60, 61, 5, 130)]
    rows = []
    for i in range(30):
        lines = []
        for _ in range(draw.randint(0, 6)):
            x = draw.choice(base)
            at = draw.randint(0, len(x))
            lines.append(draw.choice([x, x, x[:at] + "z" + x[at:], x[:at] + x[at + 1 :], x[:at] + "y" + x[at + 1 :], "", "  "]))
        rows.append((i or None, f"unique {i} " * 4 + "\n" + "\n".join(lines)))
    want = brute_lines(rows)
    frame = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, place long")
    for r in line_dedup.dedup_lines(frame, crowd, limit).collect():
        lines = rows[r.place][1].split("\n")
        assert r.text == "\n".join(x for k, x in enumerate(lines) if k not in want[r.place])
        assert r[line_dedup.DROPPED] == len(want[r.place]) and r[line_dedup.LINES] == sum(bool(words(x)) for x in lines)


def test_line_dedup_of_hostile_rows(hostile, empty):
    out = line_dedup.dedup_lines(hostile).drop(line_dedup.LINES, line_dedup.DROPPED)
    assert out.columns == hostile.columns and out.count() == len(HOSTILE)
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert {(2, None), (3, ""), (4, " \n\t "), (5, LONG), (7, "")} <= got
    assert line_dedup.dedup_lines(empty).count() == 0


# ---------------------------------------------------------------- LM scores


def brute_base(rows):
    tokens = [[*(w for w in words((t or "").translate(LOWER))), "\n"] for _, t, *_ in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, *_ in rows]
    c = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for (d, *_), ws, h in zip(rows, tokens, held, strict=True)]


@pytest.mark.parametrize("head", [3, 150_000])
def test_base_scores(hostile, head):
    got = lm_scoring.score_documents(hostile, head=head, rounds=1).collect()
    key = lambda x: (str(x[0]), x[2], round(x[5], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute_base(HOSTILE), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and math.isfinite(a[6]) and a[6] < 1e-6


def plain_score(v, layout, m, text, counts):
    """A text's score by a plain softmax over all classes and then over all members of the class, token by token."""
    ids, total, before = {t: i for i, t in enumerate(v.tokens[: v.own])}, 0.0, []
    soft = lambda rows, q: (lambda s: s - np.log(np.exp(s - s.max()).sum()) - s.max())(rows[:, :-1].astype(float) @ q + rows[:, -1])
    first, second, mean = m.matrices().astype(float)
    for w in [*(text.translate(LOWER).encode().split()), b"\n"]:
        code = ids.get(w, v.own + lm_scoring.spelled(w, layout.groups))
        back = lambda k, before=before: m.context[before[-k] if len(before) >= k else layout.begin].astype(float)
        window = [m.context[c].astype(float) for c in before[-lm_scoring.WINDOW :]]
        q = back(1) @ first + back(2) @ second + (np.mean(window, 0) @ mean if window else 0)
        total += soft(m.target, q)[layout.class_of[code]]
        if layout.member_of[code] >= 0:
            group = layout.class_of[code] - layout.single
            a, b = layout.first[group], layout.first[group + 1]
            total += soft(m.member[a:b], q)[layout.member_of[code] - a]
            if w not in ids:
                total += math.log((counts.get(w, 0) + 0.5) / v.rest[group])
        before.append(code)
    return total / math.log(10)


@pytest.fixture(scope="module")
def trained(spark, docs):
    counts = lm_scoring.token_counts(docs.select("doc_id", "text"))
    v = lm_scoring.fit_vocabulary(counts, 3_000)
    vocabulary = spark.sparkContext.broadcast(v)
    model = lm_scoring.fit_model(lm_scoring.encoded(docs, vocabulary), vocabulary)
    return v, lm_scoring.Layout(v), model, {bytes(r.token): r.c for r in counts.collect()}


def test_trained_model_is_normalised(trained):
    v, layout, m, counts = trained
    assert 0 < v.own <= 3_000 and layout.members > layout.groups
    stream, starts = lm_scoring.stream_of([np.array([5, layout.single + 3, layout.begin - 1, 0, 7]), np.array([], np.uint32), np.array([1])], layout.begin)
    assert (starts - lm_scoring.WINDOW).tolist() == [0, 5 + lm_scoring.WINDOW, 5 + 2 * lm_scoring.WINDOW]
    at, q, _, many = m.predicted(stream, layout.begin)
    assert stream[at].tolist() == [5, layout.single + 3, layout.begin - 1, 0, 7, 1] and many[:, 0].tolist() == [1, 1, 2, 3, 4, 1]
    soft = lambda s: np.exp(s - s.max(1, keepdims=True)) / np.exp(s - s.max(1, keepdims=True)).sum(1, keepdims=True)
    classes = soft(q @ m.target[:, :-1].T + m.target[:, -1])
    assert classes.sum(1) == pytest.approx(1, abs=1e-4)
    share = Counter({k: 0.5 / v.rest[k] for k in range(layout.groups)})  # the unknown slots
    for t, c in counts.items():
        if t not in set(v.tokens[: v.own]):
            k = lm_scoring.spelled(t, layout.groups)
            share[k] += (c + 0.5) / v.rest[k]
    assert all(x == pytest.approx(1) for x in share.values())
    # what the scorer gives each code after the same context adds up to one over all codes, also where logits leave the range of 32 bits
    assert lm_scoring._normalised(np.array([[200.0, 199.0], [-200.0, -201.0]], np.float32), np.array([0, 1])) == pytest.approx([-0.3133, -1.3133], abs=1e-3)
    each = lm_scoring.stream_of(list(np.arange(layout.begin)[:, None]), layout.begin)[0]  # each token a document of its own
    logs = m.log_probabilities(each, layout)
    assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_scores_equal_a_plain_softmax(spark, docs, trained):
    v, layout, m, counts = trained
    texts = [r.text or "" for r in docs.orderBy("doc_id").limit(12).collect()]
    got = lm_scoring.score_documents(docs, head=3_000).orderBy("doc_id").limit(12).collect()
    for r, t in zip(got, texts, strict=True):
        if len(t) < 20_000:
            assert r.score == pytest.approx(plain_score(v, layout, m, t, counts), rel=1e-4)


def test_scores_do_not_hang_on_partitions(docs):
    one, seven = ({(r.doc_id, r.n_tokens): r.score for r in lm_scoring.score_documents(docs.repartition(n)).collect()} for n in (1, 7))
    assert one.keys() == seven.keys() and all(one[k] == pytest.approx(seven[k], rel=1e-5) for k in one)


def test_held_out_gain_over_the_base(spark):
    r = lm_scoring.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (r.s - r.b) / r.n > 0.3


def test_shards_are_averaged_in_a_tree(docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD", 1)
    monkeypatch.setattr(lm_scoring, "FAN", 2)
    r = lm_scoring.score_documents(docs, head=2_000).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_scores_of_nothing(empty):
    assert lm_scoring.score_documents(empty).count() == 0


# ---------------------------------------------------------------- pieces


def test_codec_without_dropout_is_the_model(docs):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path, 0.0)
    texts = [r.text for r in docs.limit(60).collect()] + ["", " ", "  a  b\n\tc ", "日本 é \U0001f600", "x"]
    for t in texts:
        assert codec.encode(t).tolist() == model.encode(t)


def test_codec_is_lossless_seeded_and_varied():
    path = tokenizer_path("piece_bpe_32k.model")
    codec, other = sentencepiece_codec.Codec(path), sentencepiece_codec.Codec(path, seed=12)
    text = "internationalisation of tokenizers " * 40
    for t in [x[1] or "" for x in HOSTILE] + [text, "▁", "▁▁a ▁ b▁", "\x00"]:
        ids = codec.encode(t, 3)
        assert codec.decode(ids) == t and ids.tolist() == sentencepiece_codec.Codec(path).encode(t, 3).tolist()
    plain = len(sentencepiece_codec.Codec(path, 0.0).encode(text, 3))
    assert codec.encode(text, 3).tolist() != codec.encode(text, 4).tolist() != other.encode(text, 4).tolist()
    assert plain < len(codec.encode(text, 3)) < 2 * plain


def naive_merges(codec, word, skips):
    """Ids of a word whose merges are skipped by their number among those taken, and how many are taken."""
    parts, out, struck, n = list(word), [], set(), 0
    while True:
        spans = list(itertools.accumulate(map(len, parts), initial=0))
        best = min(((*codec.rank[a + b], s, k) for k, (a, b, s) in enumerate(zip(parts, parts[1:], spans)) if a + b in codec.rank and (s, a, b) not in struck), default=None)
        if best is None:
            break
        k, n = best[3], n + 1
        if n - 1 in skips:
            struck.add((spans[k], parts[k], parts[k + 1]))
        else:
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
    for p in parts:
        out += [codec.rank[p][1]] if p in codec.rank else [codec.byte_ids[b] for b in p.encode()]
    return out, n


def test_each_occurrence_has_skips_of_its_own():
    codec = sentencepiece_codec.Codec(tokenizer_path("piece_bpe_32k.model"))
    text = " ".join(["the internationalisation é日本"] * 20_000)
    codec.encode(text, 3)
    for word in ("▁the", "▁internationalisation", "▁é日本"):
        for node in nodes_of(codec, word):
            assert (np.frombuffer(codec.trees.ids[node], np.uint16).tolist(), codec.trees.taken[node]) == naive_merges(codec, word, codec.trees.skips[node])
    one = sentencepiece_codec.Codec(tokenizer_path("piece_bpe_32k.model"))
    whole, n = naive_merges(one, "▁the", ())
    ids, many = one.encode("the " * 20_000, 5).tolist(), one.encode("internationalisation " * 20_000, 5).tolist()
    assert len(whole) == 1 and ids.count(whole[0]) / 20_000 == pytest.approx(sum(p for p, x in ways(one, "▁the") if x == whole), abs=0.015)
    start = one.rank["▁"][1]
    assert start in ids and len(nodes_of(one, "▁internationalisation")) > 100 and len(many) > 20_000


def test_long_words_run_once_and_equal_their_trees(monkeypatch):
    path = tokenizer_path("piece_bpe_32k.model")
    text = " ".join(["internationalisation" * 5, "the", "x" * 60] * 5)
    by_run = sentencepiece_codec.Codec(path).encode(text, 3).tolist()
    monkeypatch.setattr(sentencepiece_codec, "LONG", 10_000)
    assert by_run == sentencepiece_codec.Codec(path).encode(text, 3).tolist()
    monkeypatch.undo()
    codec, long = sentencepiece_codec.Codec(path), "internationalisation" * 1_000
    assert codec.decode(codec.encode(long, 3)) == long and len(codec.trees.words) == 1


def nodes_of(codec, word):
    return [k for k, w in enumerate(codec.trees.words) if w == word]


def ways(codec, word, skips=(), start=0, p=1.0):
    """What a word can become, with the chances that independent skips at rate 0.1 give."""
    ids, n = naive_merges(codec, word, skips)
    yield p * 0.9 ** (n - start), ids
    for t in range(start, n):
        yield from ways(codec, word, (*skips, t), t + 1, p * 0.9 ** (t - start) * 0.1)


def test_variety_grows_with_occurrences():
    """One word over more and more documents: the different segmentations grow as those of independent draws do."""
    codec, word = sentencepiece_codec.Codec(tokenizer_path("piece_bpe_32k.model")), "internationalisation"
    found = {n: len({x.tobytes() for x in codec.encode_many([word] * n, list(range(n)))}) for n in (8, 200, 2_000)}
    draw, free, seen = random.Random(4), {}, set()
    for k in range(1, 2_001):
        seen.add(tuple(naive_merges(codec, "▁" + word, {t for t in range(60) if draw.random() < 0.1})[0]))
        free[k] = len(seen)
    assert found[8] < found[200] < found[2_000]
    assert all(abs(found[n] - free[n]) <= max(4, 0.25 * free[n]) for n in found), (found, free)


def test_batches_equal_single_words():
    """Many words merged together give what each word's own agenda gives, with and without skips."""
    codec, draw = sentencepiece_codec.Codec(tokenizer_path("piece_bpe_32k.model")), random.Random(1)
    text = " ".join("".join(draw.choice("etaoinshrdlcuméß") for _ in range(draw.randint(1, 14))) for _ in range(3_000))
    ids = codec.encode(text, 7)
    assert codec.decode(ids) == text
    for node in draw.sample(range(len(codec.trees.words)), 500):
        word, skips = codec.trees.words[node], codec.trees.skips[node]
        assert (codec.trees.ids[node], codec.trees.taken[node]) == codec._merge(word, skips)
        assert (np.frombuffer(codec.trees.ids[node], np.uint16).tolist(), codec.trees.taken[node]) == naive_merges(codec, word, skips)


def test_rows_are_summed_by_place_as_one_by_one():
    """Places beyond 16 bits, mostly alone and mostly repeated: the order is stable and the sums are those of numpy's, bit by bit."""
    draw = np.random.default_rng(3)
    for at in (draw.integers(0, 2**34, 500), draw.integers(0, 70_000, 5_000), draw.integers(65_530, 65_540, 300), np.arange(9)[::-1], np.array([7])):
        rows = draw.normal(size=(len(at), 5)).astype(np.float32)
        order = np.argsort(at, kind="stable")
        assert lm_scoring._order(at).tolist() == order.tolist()
        places, first = np.unique(at[order], return_index=True)
        got = lm_scoring._scatter(at, rows)
        assert got[0].tolist() == places.tolist() and np.array_equal(got[1], np.add.reduceat(rows[order], first))


def test_trees_are_freed_when_full():
    """The trees of a worker are bounded: cleared ones don't wait for a collection of cycles, and what they hold changes no result."""
    import gc

    path, texts = tokenizer_path("piece_bpe_32k.model"), [" ".join(f"word{i * k} some{k}" for i in range(40)) for k in range(1, 30)]
    small, large = sentencepiece_codec.Codec(path, limit=50), sentencepiece_codec.Codec(path)
    gc.collect()
    gc.disable()
    try:
        got = [small.encode(t, k).tolist() for k, t in enumerate(texts)]
        held = sum(len(x) for x in gc.get_objects() if isinstance(x, sentencepiece_codec.Roots) and x is not large.trees.roots)
    finally:
        gc.enable()
    assert held <= 50 + 2 * 80
    assert got == [large.encode(t, k).tolist() for k, t in enumerate(texts)]
    assert sum(x[-1].nbytes + x[-2].nbytes for x in large.pairs) <= 13 * 2**20


def test_copies_have_skips_of_their_own(spark):
    import corpus_pipeline

    rows = spark.createDataFrame([(1, "internationalisation of tokenizers " * 40, "en", "a")] * 2, SCHEMA)
    out = corpus_pipeline.piece_encoding(spark, rows, "").collect()
    assert len(out) == 2 and out[0].ids != out[1].ids


def test_codec_frames(hostile, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    extra = hostile.drop("ids")
    back = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(extra, path), path)
    assert back.where("decoded <> coalesce(text, '')").count() == 0 and back.count() == len(HOSTILE)
    digest = sentencepiece_codec.codec_digest(hostile, path)
    assert digest.where("not lossless").count() == 0 and digest.count() == len(HOSTILE)
    assert sentencepiece_codec.codec_digest(empty, path).count() == 0


# ---------------------------------------------------------------- quality


def brute_quality(text):
    w = words(text)
    runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality(spark, sf_dir, docs, hostile, empty):
    rows = queries.QUERIES["op7_quality_rules"](spark, sf_dir).collect()
    texts, labels = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = 0
    for r in rows:
        want = brute_quality(texts[r.doc_id])
        assert tuple(r[c] for c in quality.BASE) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
        right += r.doc_id in labels and (r.kept or r.base_failed and labels[r.doc_id] == 1) == bool(labels[r.doc_id])
    assert right >= 0.95 * len(labels)
    for text in (LONG, "a b c d e f g h " * 40, "x\ny\nx\n \n \nx"):
        assert tuple(quality.statistics(text.encode())[0]) == brute_quality(text)
    out = quality.filter_quality(hostile, None)
    assert out.columns == hostile.columns and [r.doc_id for r in out.collect()] == [5]
    assert quality.filter_quality(empty, None).count() == 0
    assert quality.fit_quality(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")) is None
    assert quality.fit_quality(empty, spark.createDataFrame([], "doc_id long, quality int")) is None


def test_trees_are_monotonic_and_accurate():
    draw = np.random.default_rng(1)
    x = draw.random((3000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.3)).astype(float)
    flip = draw.random(3000) < 0.05
    model = quality.fit_trees(x, np.where(flip, 1 - y, y), np.array([-1, 0, 0]))
    assert ((model.score(x) > 0) == y).mean() > 0.97
    grid = np.repeat(draw.random((50, 3)), 40, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(model.score(grid).reshape(50, 40), axis=1) <= 1e-9).all()


def walked(model, x):
    """One row down every tree, node by node."""
    total = model.bias
    for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
        at = 0
        while feature[at] >= 0:
            at = 2 * at + (2 if x[feature[at]] > threshold[at] else 1)
        total += value[at]
    return total


def test_flat_trees_equal_a_walk(spark, sf_dir, docs):
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in quality.quality_verdicts(docs, model).collect():
        counts, shape = quality.statistics(texts[r.doc_id])
        margin = walked(model, shape)
        assert r.good == pytest.approx(1 / (1 + math.exp(-margin)))
        assert r.kept == (not r.base_failed and r.good >= 0.5)


def test_fitting_takes_one_of_rows_that_share_an_id(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    twice = docs.select("doc_id", "text").union(docs.selectExpr("doc_id", "concat('other ', text, ' ', doc_id) as text"))
    a, b = (quality.fit_quality(twice.orderBy(F.rand(seed)).repartition(n), labels) for seed, n in ((1, 3), (2, 5)))
    assert all(np.array_equal(getattr(a, f), getattr(b, f)) for f in ("feature", "threshold", "value"))


# ---------------------------------------------------------------- toxicity


def all_paths(word, model):
    """The likeliest spelling by going through every path of the lattice."""
    best = None
    for path in itertools.product(*toxicity.lattice(word)):
        x, y, total = toxicity.N, 0, 0.0
        for text, q in path:
            total += q
            for c in text:
                k = ord(c) - 96
                total += model[x, y, k]
                x, y = (0 if x == toxicity.N else y), k
        total += model[x, y, 0]
        spelled = "".join(text for text, _ in path)
        if best is None or total > best[0] + 1e-12:
            best = (total, spelled)
    return best


def test_viterbi_finds_the_best_of_all_paths():
    draw = np.random.default_rng(4)
    counts = draw.poisson(0.3, toxicity.N**3) + toxicity.trigram_counts(["idiot stupid moron loser bloody the other"] * 40)
    model = toxicity.log_model(counts)
    for word in ("1d10t", "m.0.r0n", "$tup1d", "l00oser", "b!0|dy", "i-d--i", "aa", "4$5", "|!1", "m0*n"):
        want, spelled = all_paths(word, model)
        got = toxicity.viterbi(word, model)
        assert got == spelled or max(p for p in [score_of(word, got, model)]) == pytest.approx(want), word


def score_of(word, spelled, model):
    return max(t for t, s in ((total_of(path, model), "".join(x for x, _ in path)) for path in itertools.product(*toxicity.lattice(word))) if s == spelled)


def total_of(path, model):
    x, y, total = toxicity.N, 0, 0.0
    for text, q in path:
        total += q
        for c in text:
            k = ord(c) - 96
            total += model[x, y, k]
            x, y = (0 if x == toxicity.N else y), k
    return total + model[x, y, 0]


def test_toxicity_of_the_table(spark):
    """Held-out rows of the table that is large enough to learn from."""
    path = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect() if r.toxic is not None}
    rows = [r for r in queries.QUERIES["op8_toxicity"](spark, path).collect() if r.held_out and r.doc_id in labels]
    toxic, clean = ([r.predicted for r in rows if labels[r.doc_id] == y] for y in (1, 0))
    assert sum(toxic) >= 0.9 * len(toxic) > 50 and sum(clean) <= 0.005 * len(clean)


def test_what_may_be_hidden():
    assert all(map(toxicity.hidden, ("1d10t", "@$$", "$#!7", "looool", "a.b")))
    assert not any(map(toxicity.hidden, ("455", "10", "word", "***", "-", "#", "book")))
    assert {"you", "idiot"} <= set(toxicity.words_of("y o u  i d i o t")) and "youidiot" not in toxicity.words_of("y o u  i d i o t")


def test_toxicity(spark):
    draw = random.Random(2)
    vocabulary = ["".join(draw.choice("abcdeilmnorstu") for _ in range(draw.randint(3, 8))) for _ in range(400)]
    bad = ["idiot", "stupid", "moron", "loser"]
    text = lambda *extra: " ".join(draw.sample([*(draw.choice(vocabulary) for _ in range(40)), *extra], 40 + len(extra)))
    rows = [(i, text(draw.choice(bad)) if i % 5 == 0 else text(), int(i % 5 == 0)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.fit_toxicity(docs, docs.select("doc_id", F.col("y").alias("toxic")))
    hidden = ["1d10t", "s t u p i d", "m.o.r.o.n", "looooser", "STUP1D!!", "id1ooot", "l0s3r", "mor*n", "$tupid"]
    scores = model.score([text(h) for h in hidden])
    assert (scores >= 0.5).all(), dict(zip(hidden, scores, strict=True))
    assert (model.score([text() for _ in range(200)]) < 0.5).all() and model.score([""])[0] < 0.5
    got = toxicity.toxicity_scores(docs, model).join(docs, "doc_id")
    assert got.where("held_out and predicted = y").count() >= 0.98 * got.where("held_out").count()


def test_toxicity_of_hostile_rows(spark, hostile, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit_toxicity(hostile, none) is None
    assert {r.score for r in toxicity.toxicity_scores(hostile, None).collect()} == {0.0}
    some = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(hostile, toxicity.fit_toxicity(hostile, some)).count() == len(HOSTILE)
    assert toxicity.toxicity_scores(empty, None).count() == 0


# ---------------------------------------------------------------- token files


def test_token_files(spark, hostile, empty, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    hostile = hostile.unionByName(spark.createDataFrame([(8 + k, t, "en", "a") for k, t in enumerate(SPECIAL)], SCHEMA), allowMissingColumns=True)
    folder = f"file://{tmp_path}/seq"
    manifest = token_output.write_sequences(hostile, folder, path, length=16)
    rows = sorted(token_output.read_sequences(manifest, folder).collect(), key=lambda r: r.start)
    at, want = 0, Counter()
    for r in rows:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    assert [r.doc_id for r in rows] == [None, None, 1, 1, 1, 2, 3, 4, 5, 6, 7, *range(8, 8 + len(SPECIAL))]
    given = [(d, t) for d, t, *_ in HOSTILE] + [(8 + k, t) for k, t in enumerate(SPECIAL)]
    want = Counter((d, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 2])) for d, t in given)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    from pyarrow import fs

    for m in manifest.collect():
        with token_output.SequenceReader(fs.LocalFileSystem(), m.tokens_path) as s:
            n = -(-m.n_tokens // 16)
            assert sum(int(s.mask(k).sum()) for k in range(n)) == m.n_tokens
            assert np.concatenate([s.sequence(k) for k in range(n)])[: m.n_tokens].tolist() == s.stream(0, m.n_tokens).tolist()
            assert not s.sequence(0).flags.owndata
    assert token_output.read_sequences(token_output.write_sequences(empty, folder, path), folder).count() == 0


def test_pretokens_equal_the_tokenizer(docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    enc, plain, draw = encoder(path), Tokenizer.from_file(path), random.Random(6)
    texts = [r.text for r in docs.collect()] + ["it's  we'll\n\n x\t", "½²³ a b", "日本語 テスト", "\x85\x00\x7f", "   ", *SPECIAL]
    texts += ["".join(draw.choice(["a", " ", "\n", "é", "日", "'s", "1", "<|endoftext|>", "|>", "\x1c", "\u2028", "!"]) for _ in range(draw.randint(0, 12))) for _ in range(3_000)]
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, enc.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids, t


# ---------------------------------------------------------------- near duplicates


def shingles(text, n):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + min(n, len(w))]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_groups(rows, n):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        if d is not None and (least[find(i)] is None or d < least[find(i)]):
            least[find(i)] = d
    return [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("limit", [0, 200_000])
def test_near_duplicates(spark, limit):
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(d, t) for d, t, *_ in HOSTILE]
    for g in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(30, 90))]
        for _ in range(draw.randint(1, 14)):
            copy = list(base)
            for _ in range(draw.randint(0, 5)):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            rows.append((1000 - len(rows), " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    minhash.BROADCAST_IDS, kept = limit, minhash.BROADCAST_IDS
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, 4).collect())
    minhash.BROADCAST_IDS = kept
    assert got == Counter(brute_groups(rows, 4))


def test_prefix_join_finds_all_pairs_between_components(spark):
    draw = np.random.default_rng(3)
    sets = []
    for _ in range(12):
        base = draw.integers(0, 2**63, draw.integers(20, 80)).astype(np.uint64)
        for _ in range(12):
            kept = base[draw.random(len(base)) < 0.93]
            sets.append(np.unique(np.concatenate([kept, draw.integers(0, 2**63, draw.integers(0, 4)).astype(np.uint64)])))
    keys = [minhash.set_key(s) for s in sets]
    for labels in (keys, [keys[i // 4 * 4] for i in range(len(keys))]):
        alive = spark.createDataFrame([(bytearray(k), len(s), bytearray(x)) for k, s, x in zip(keys, sets, labels, strict=True)], "key binary, n long, label binary")
        full = spark.createDataFrame([(bytearray(k), bytearray(s.tobytes())) for k, s in zip(keys, sets, strict=True)], "key binary, hashes binary")
        got = {(bytes(r.a), bytes(r.b)) for r in minhash._prefix_pairs(alive, full, 80).collect()}
        want = 0
        for i, j in itertools.combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if labels[i] != labels[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                want += 1
                assert tuple(sorted((keys[i], keys[j]))) in got
        assert want > 50 and len(got) < len(sets) * 12


def test_near_duplicates_of_the_table(spark, sf_dir, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in queries.QUERIES["op10_minhash"](spark, sf_dir).collect()}
    assert got == set(brute_groups(rows, 4))


def test_keep_one(hostile, empty):
    out = minhash.keep_one(hostile)
    assert out.columns == hostile.columns
    got = Counter((r.doc_id, (r.text or "")[:20]) for r in out.collect())
    assert got == Counter([(1, "one two three four f"), (1, "another text under t"), (2, ""), (3, ""), (4, " \n\t "), (None, "a row without an id "), (None, ""), (5, LONG[:20]), (6, HOSTILE[9][1][:20])])
    assert minhash.keep_one(empty).count() == 0
    blank = hostile.sparkSession.createDataFrame([(5, "", "d"), (5, "", "e"), (None, None, "f"), (None, None, "g"), (6, "a b", "h"), (6, "a b", "i")], "doc_id long, text string, source string")
    assert sorted(r.source[0] for r in minhash.keep_one(blank).collect())[:4] == ["d", "e", "f", "g"] and minhash.keep_one(blank).count() == 5


def test_signature_estimates_similarity():
    draw = np.random.default_rng(0)
    a = np.unique(draw.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[:320], draw.integers(0, 2**63, 80).astype(np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert (minhash.one_permutation(a) == minhash.one_permutation(b)).mean() == pytest.approx(true, abs=0.12)
    assert len(set(minhash.one_permutation(a[:1]).tolist())) == 1
    assert set(minhash.one_permutation(a[:3]).tolist()) <= set(a[:3].tolist())
