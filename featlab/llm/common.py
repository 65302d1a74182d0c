"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlab.session import ensure_importable

#: A-Z to a-z on UTF-8 bytes; all other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Java and RE2 form of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_scratch: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_importable(spark)
    if spark.conf.get(_BATCH) == "10000":  # the default, made for short rows; documents are long
        spark.conf.set(_BATCH, "2000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where that is unset and all runs on this machine, else ValueError."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        kept = spark.sparkContext.getCheckpointDir()
        if kept:
            return kept
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="featlab-checkpoints-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at


def _remove(path: str) -> None:
    spark = _scratch.pop(path, None)
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already
        pass


@atexit.register
def _remove_all() -> None:
    for path in list(_scratch):
        _remove(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/featlab-{name}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, *frames: DataFrame) -> str:
    """name, or with underscores before it, so that no frame has such a column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def framed(rows: list, names: list[str], whole: tuple[str, ...]) -> pd.DataFrame:
    """rows as a pandas frame; the columns in whole are long, may hold nulls, and never pass through floats."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pd.DataFrame({c: pd.array(list(v), dtype="Int64") if c in whole else pd.Series(v, dtype=object) for c, v in zip(names, columns, strict=True)})


def give_back() -> None:
    """What this worker holds of earlier tasks goes back to the system: Spark keeps workers from stage to stage, and the C library keeps what
    they freed. Encoders of a stage that is over are dropped."""
    import pyarrow as pa

    if (tokens := sys.modules.get("featlab.llm.tokens")) is not None:
        tokens._made.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a map over batches, in a worker that gives back what it holds before and after."""

    def mapped(batches: Iterator) -> Iterator:
        give_back()
        yield from run(batches)
        give_back()

    return mapped


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
