"""Near-duplicate documents by one-permutation MinHash.

A document's shingles are hashed once. The top bits of a hash choose one of 256 bins and a bin keeps its smallest hash,
so one pass gives the whole signature. Empty bins are filled by optimal densification: bin i tries the bins h(i, 1),
h(i, 2), ... until one is not empty, which keeps each bin's chance to agree equal to the Jaccard similarity. Forty-two
bands of six bins make the buckets. A pair at similarity s shares no bucket with chance (1 - s^6)^42: 3e-6 at 0.8.

Documents with equal shingle sets are one node. Of each bucket the member that shares most buckets is its centre, and
only the edges from the centre to the others are checked, on full sets. So the pairs made stay near the number of members. Where
the other members of a bucket then lie in different components, which is where groups are loose, a prefix-filtered join
over the sets of those members finds every link that is left between the components. No link that shares a bucket is lost.

A bucket or component may hold a third of all documents: what is grouped by these is pre-aggregated, and in joins with one row for
each of them the many stand on the left, where adaptive execution splits a skewed partition.

Null or blank texts have the empty set and are linked with nothing. Rows that share a doc_id are documents of their own;
a group's id is the smallest doc_id in it, nulls left out. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import WORD, WORDS, column, documents, mix64, scoped, slices, staged, text_bytes, windows

BINS, BANDS, ROWS = 256, 42, 6
#: Up to so many 8-byte ids are broadcast to fetch texts (2 MB); beyond it the ids are joined by a shuffle.
BROADCAST_IDS = 200_000
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(56)


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words; of all words as one run if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(WORDS.of(words), min(n, len(words))))


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        parts = [mix64(hashes, 1).sum(dtype=np.uint64), mix64(hashes, 2).sum(dtype=np.uint64)]
    return np.array(parts, "<u8").tobytes()


def one_permutation(hashes: np.ndarray) -> np.ndarray:
    """The densified signature of a set that is not empty."""
    at = np.searchsorted(hashes, _EDGES)
    found = hashes[np.minimum(at, len(hashes) - 1)]
    full = (at < len(hashes)) & (found >> np.uint64(56) == np.arange(BINS, dtype=np.uint64))
    signature, empty, attempt = np.where(full, found, np.uint64(0)), np.flatnonzero(~full), 0
    if full.sum() == 1:
        return np.full(BINS, found[full][0])
    while len(empty):
        attempt += 1
        other = (mix64(empty.astype(np.uint64), 7 + attempt) & np.uint64(BINS - 1)).astype(np.int64)
        hit = full[other]
        signature[empty[hit]] = signature[other[hit]]
        empty = empty[~hit]
    return signature


def band_hashes(signature: np.ndarray) -> np.ndarray:
    bands = signature[: BANDS * ROWS].reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mix64(out ^ bands[:, k], 3)
    return out.view(np.int64)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, keys, bands = [], [], []
            for text in text_bytes(batch):
                s = shingle_set(text, n)
                sizes.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                bands.append(band_hashes(one_permutation(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "hash"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "hash", "n_shingles", "key", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("hash"), "text").mapInArrow(sign, "doc_id long, hash long, n_shingles long, key binary, bands array<long>")


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(x, n) for x in text_bytes(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_key, found), pa.binary()), pa.array((x.tobytes() for x in found), pa.binary())], names=["key", "hashes"])

    return docs.select("text").mapInArrow(sets, "key binary, hashes binary")


def _sets_of(keys: DataFrame, nodes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """key, hashes: the full set of each key, from one text that has it."""
    need = staged(keys.join(nodes.select("key", "rep"), "key"), "need")
    ids = need.select("rep").distinct()
    if need.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    return staged(shingle_sets(texts, n).join(need.select("key"), "key", "left_semi").dropDuplicates(["key"]), "sets")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set keys whose full sets are similar enough."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in column(batch, c).to_pylist()] for c in ("xs", "ys"))
            both = [len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)]
            keep = [100 * k >= percent * (len(p) + len(q) - k) for p, q, k in zip(x, y, both, strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = _sets_of(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), nodes, docs, n)
    joined = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("xs")), "a").join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("ys")), "b")
    return joined.select("a", "b", "xs", "ys").mapInArrow(similar, "a binary, b binary")


def _prefix_pairs(alive: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components among rows (key, n, label) that may be similar enough, by prefixes of their sets.

    With each set's shingles in the order of how many of the sets have them, two sets similar enough share one among the first
    n - ceil(n * percent / 100) + 1 of each; its places tell how many more they can share. Shingles of one set alone come
    first and meet nothing, so sets with words of their own have short prefixes or none. Of each shingle's rows those
    outside its commonest component meet all, which is every pair of different components.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, found = column(batch, "key"), [np.frombuffer(x, np.int64) for x in column(batch, "hashes").to_pylist()]
            places = np.repeat(np.arange(len(found)), list(map(len, found)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *found])), keys.take(pa.array(places))], names=["shingle", "key"])

    rows = sets.mapInArrow(explode, "shingle long, key binary")
    often = staged(rows.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1"), "often")
    shared = rows.join(often, "shingle")
    place = F.row_number().over(W.partitionBy("key").orderBy("sets", "shingle"))
    ranked = shared.withColumn("place", place).withColumn("common", F.count("*").over(W.partitionBy("key")))
    ranked = ranked.join(alive, "key").withColumn("place", F.col("n") - F.col("common") + F.col("place"))
    prefix = staged(ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("shingle", "key", "place", "n", "label"), "prefix")
    major = staged(prefix.groupBy("shingle").agg(F.mode("label").alias("major"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("shingle", "major"), "major")
    minor = staged(prefix.join(major, "shingle").where("label <> major").select("shingle", F.col("key").alias("other"), F.col("place").alias("at"), F.col("n").alias("m"), F.col("label").alias("its")), "minor")
    most = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at")) + 1
    near = (F.col("label") != F.col("its")) & (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (most * (100 + percent) >= (F.col("n") + F.col("m")) * percent)
    return prefix.join(minor, (prefix["shingle"] == minor["shingle"]) & near).select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """The component of each linked key, named by its smallest key: smallest label of the neighbours, then pointer jumping."""
    edges = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = staged(edges.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("label")).select("key", F.least("key", "label").alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        lower = staged(labels.join(near, "key").select("key", F.col("label").alias("old"), F.least("label", "near").alias("label")), "lower")
        jump = lower.select(F.col("key").alias("label"), F.col("label").alias("next"))
        new = staged(lower.join(jump, "label", "left").select("key", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        labels = new.select("key", "label")
        if new.where("old <> label").isEmpty():
            return labels


@scoped
def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, hash (of the text), n_shingles, group (the component's key), component_id, kept."""
    signed = staged(signatures(docs, n), "signed")
    nodes = staged(signed.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_docs"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "nodes")
    rows = nodes.select("key", "n", F.explode("bands").alias("bucket"))
    counts = staged(rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "counts")
    shared = staged(rows.join(counts.hint("merge"), "bucket"), "shared")  # by a shuffle at every size
    weights = staged(shared.groupBy("key").agg(F.sum("members").alias("weight")), "weights")
    members = staged(shared.select("bucket", "key", "n").join(weights.hint("merge"), "key").select("bucket", "key", "n", "weight"), "members")

    # stars: from the member of each bucket that shares most buckets to the others
    best = F.min(F.struct((-F.col("weight")).alias("order"), "key", "n")).alias("c")
    centers = staged(members.groupBy("bucket").agg(best).select("bucket", F.col("c.key").alias("center"), F.col("c.n").alias("m")), "centers")
    edges = members.join(centers, "bucket").where("key <> center").where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
    pairs = staged(edges.select(F.least("key", "center").alias("a"), F.greatest("key", "center").alias("b")).distinct(), "pairs")
    links = staged(_confirmed(pairs, nodes, docs, n, percent), "links")
    labels = components(links)

    # what the stars leave open: buckets whose other members lie in different components
    rest = members.join(centers.select("bucket", F.col("center").alias("key")), ["bucket", "key"], "left_anti").join(labels, "key", "left")
    rest = staged(rest.select("bucket", "key", "n", F.coalesce("label", "key").alias("label")), "rest")
    split = staged(rest.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket"), "split")
    alive = staged(rest.join(split, "bucket", "left_semi").select("key", "n", "label").distinct(), "alive")
    if not alive.isEmpty():
        more = _prefix_pairs(alive, _sets_of(alive.select("key"), nodes, docs, n), percent).join(pairs, ["a", "b"], "left_anti")
        found = staged(_confirmed(staged(more, "more"), nodes, docs, n, percent), "links")
        if not found.isEmpty():
            labels = components(links.union(found))

    groups = nodes.select("key", "rep", "n_docs")
    whole = groups.join(labels, "key", "left").where("n_docs > 1 or label is not null").withColumn("label", F.coalesce("label", "key"))
    whole = staged(whole, "whole")
    named = whole.select("key", "label").join(whole.groupBy("label").agg(F.min("rep").alias("component")), "label").select("key", "label", "component")
    named = staged(named, "named")
    out = signed.select("doc_id", "hash", "n_shingles", "key").join(named, "key", "left")
    return out.select("doc_id", "hash", "n_shingles", F.coalesce("label", "key").alias("group"), F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@scoped
def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, less all but one of each group: the one with the smallest doc_id, nulls last.

    Rows alike in doc_id and text are one document, but for blank ones, which are linked with nothing and all stay.
    """
    found = staged(near_duplicates(docs, n, percent), "groups")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")
    first = staged(found.where("n_shingles > 0").groupBy("group").agg(F.min(row).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    lost = found.join(first, "group").where(row != F.col("first")).select(F.col("doc_id").alias("__loom_id"), F.col("hash").alias("__loom_lost")).distinct()
    lost = staged(lost, "lost")
    if lost.count() <= BROADCAST_IDS:
        lost = F.broadcast(lost)
    rows = docs.withColumn("__loom_hash", F.xxhash64("text"))
    kept = rows.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col("__loom_id")) & (F.col("__loom_hash") == F.col("__loom_lost")), "left_anti")
    if not found.where("n_shingles > 0").groupBy("doc_id", "hash").count().where("count > 1").isEmpty():
        worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
        kept = kept.where(worded).dropDuplicates(["doc_id", "__loom_hash"]).union(kept.where(~worded))
    return kept.drop("__loom_hash")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), n=4).drop("hash", "group")


ORACLE_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM worded WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (
  SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
