from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import counting
from corpusloom.streaming import streams


def run(stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return stream.sparkSession.table(name)


def test_counts_equal_the_batch(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    docs.repartition(3).write.parquet(f"file://{tmp_path}/d")
    got = run(streams.item_counts(streams.stream_parquet(spark, f"file://{tmp_path}/d", docs.schema)), "complete", "counts")
    want = counting.classified_counts(counting.items(docs, T.process(F.col("text"))))
    assert {(r["class"], r.item, r.cnt) for r in got.collect()} == {(r["class"], r.item, r.cnt) for r in want.collect()}


def test_chunks_carry_their_buffer(spark, tmp_path):
    rows = spark.createDataFrame([(i % 2, i, [i] * 3) for i in range(10)], "lane int, doc_id long, ids array<int>")
    for k in range(2):
        rows.where(F.floor(F.col("doc_id") / 5) == k).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/c")
    stream = streams.stream_parquet(spark, f"file://{tmp_path}/c", rows.schema)
    got = run(streams.chunk_stream(stream, 4), "append", "chunks").collect()
    for lane in range(2):
        whole = [x for i in range(10) if i % 2 == lane for x in [i] * 3]
        mine = sorted((r.chunk_id, r.input_ids) for r in got if r.lane == lane)
        assert mine == [(k, whole[4 * k : 4 * k + 4]) for k in range(len(whole) // 4)]


def test_windows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = streams.windowed_events(events).agg(F.sum("events")).first()[0]
    assert got == events.count()
