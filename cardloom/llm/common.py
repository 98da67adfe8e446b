"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share. Where the session names none, one of this machine's if it runs everything itself, as in
    tests; on a cluster executors would write to their own disks, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="cardloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and that no plan will read again: what was made of them has been written itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(_paths.pop(table))
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of the column, one row at least."""
    if not batch.num_rows:
        return
    ends = np.cumsum(sizes(batch.column(column)))
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def sizes(texts: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text, 0 for null."""
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)


SALTS = 16


def salted_join(many: DataFrame, few: DataFrame, key: str, by: str, salts: int = SALTS) -> DataFrame:
    """many joined with few, which has a row for each key: rows of a key that is very frequent in many are dealt out by another
    column, few is repeated for each share. The shuffles stand right below the join, so adaptive execution can split more."""
    left = many.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "__salt"]).drop("__salt")
