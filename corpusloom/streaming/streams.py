"""Streams: running counts, windowed metrics with late data, and chunks of a token stream."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators.chunks import check_chunk_arguments


def stream_parquet(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def item_counts(stream: DataFrame) -> DataFrame:
    """class, item, cnt over all that came so far."""
    items = stream.select(F.explode(T.process(F.col("text"))).alias("item"))
    return items.groupBy(T.item_class(F.col("item")).alias("class"), "item").agg(F.count("*").alias("cnt"))


def windowed_events(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def chunk_stream(stream: DataFrame, block: int, stride: int | None = None, key: str = "lane") -> DataFrame:
    """Chunks of the ids of rows (key, doc_id, ids), each key a stream of its own; the state is the buffer, under a block of ids.

    Rows of one batch are taken in the order of doc_id.
    """
    stride = block if stride is None else stride
    check_chunk_arguments(block, stride)

    def cut(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, n = (np.array(state.get[0], np.int32), state.get[1]) if state.exists else (np.empty(0, np.int32), 0)
        # a key's rows of one batch are held as arrays, since their order is only known when all are there
        rows = sorted(((d, x) for f in frames for d, x in zip(f["doc_id"], f["ids"], strict=True)), key=itemgetter(0))
        for at in range(0, len(rows), 256):
            buffer = np.concatenate([buffer, *(np.asarray(x, np.int32) for _, x in rows[at : at + 256])])
            many = max(0, (len(buffer) - block) // stride + 1)
            if many:
                out = np.lib.stride_tricks.sliding_window_view(buffer, block)[: (many - 1) * stride + 1 : stride]
                yield pd.DataFrame({key: group[0], "chunk_id": range(n, n + many), "input_ids": list(out)})
                buffer, n = buffer[many * stride :], n + many
        state.update((buffer.tolist(), n))

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(cut, f"{key} {kind}, chunk_id long, input_ids array<int>", "buffer array<int>, n long", "append", GroupStateTimeout.NoTimeout)
