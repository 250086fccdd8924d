"""Tables staged in the folder that the driver and all executors share.

The folder is spark.checkpoint.dir. Only a session whose executors are the driver's own threads may go without: it gets a folder of its
own; on a cluster a missing setting is an error, since a machine-local folder would lose rows. Tables are deleted
once the operator that staged them returns a result that doesn't read them, and all that is left when the driver ends.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_OPEN = threading.local()


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, as Spark's readers and writers take it."""
    p, system = _hadoop(spark, path)
    return system.makeQualified(p).toString()


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}/checkpoints"
    return qualified(spark, named).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the application's folder, which goes when the driver ends."""
    folder = f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}"
    p, system = _hadoop(spark, folder)
    if system.mkdirs(p):
        system.deleteOnExit(p)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def arrow_uri(spark: SparkSession, folder: str) -> str:
    """A folder as pyarrow's file systems name it: qualified and resolved by Hadoop, so that a path without scheme is Spark's default
    store and not the local disk. The folder is made."""
    p, system = _hadoop(spark, folder)
    system.mkdirs(p)
    uri = system.resolvePath(p).toString()
    scheme, _, rest = uri.partition(":")
    return {"file": "file://", "s3a": "s3:", "s3n": "s3:"}.get(scheme, f"{scheme}:") + (rest if scheme != "file" else "/" + rest.lstrip("/"))


def discard(spark: SparkSession, path: str) -> None:
    p, system = _hadoop(spark, path)
    system.delete(p, True)


def release(spark: SparkSession) -> None:
    """Deletes all tables that this application has staged; results that read them must be written before."""
    discard(spark, f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts the lineage: lost executors cost nothing that is done."""
    path = fresh_path(df.sparkSession, name)
    for made in _OPEN.__dict__.get("made", [])[-1:]:
        made.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _read_by(df: DataFrame) -> str:
    """The root paths of all files that a DataFrame reads."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            out.append(leaf.relation().location().rootPaths().mkString("\n"))
    return "\n".join(out)


def scoped(f: Callable) -> Callable:
    """An operator whose staged tables are deleted when it returns, but for those that its result reads."""

    @wraps(f)
    def run(*args, **kwargs):
        open_ = _OPEN.__dict__.setdefault("made", [])
        open_.append([])
        try:
            out = f(*args, **kwargs)
        except BaseException:
            open_.pop()
            raise
        made = open_.pop()
        read = _read_by(out) if made and isinstance(out, DataFrame) else ""
        for spark, path in made:
            if path.rpartition("/")[2] in read:
                for outer in open_[-1:]:
                    outer.append((spark, path))
            else:
                discard(spark, path)
        return out

    return run
