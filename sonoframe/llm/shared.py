"""Stored intermediate tables, size-checked joins and small column helpers of the corpus operators."""

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A stored right side up to this many Parquet bytes is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only for a local master without it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, and forgets
    the partitioning, so that joins on it exchange both sides and adaptive execution can split hot keys."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _stored_path(df: DataFrame):
    files = df.inputFiles()
    if not files:
        return None, None
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    return path, path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


def stored_bytes(df: DataFrame) -> int:
    path, system = _stored_path(df)
    return system.getContentSummary(path).getLength() if path else 0


def forget(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    path, system = _stored_path(df)
    if path:
        system.delete(path, True)


def attach(left: DataFrame, right: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a stored, narrow right side: broadcast if its files are small, else by shuffle with adaptive splitting."""
    return left.join(F.broadcast(right) if stored_bytes(right) <= BROADCAST_BYTES else right, on, how)


def pieces(batches, rows: int = 512):
    """Batches in slices of few rows, so that what a kernel makes of one stays small; gives unused memory back at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def share(id_column: str, salt: str, part: float) -> Column:
    """A repeatable sample of about ``part`` of the ids."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(id_column)), F.lit(1_000_000)) < int(part * 1_000_000)


def checked_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator works on, so that further columns cannot clash with its own."""
    return df.select(*[F.col(f"`{n}`") for n in names])
