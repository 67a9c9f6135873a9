"""Session settings and lineage cutting."""

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Sample arrays are wide rows, so Arrow batches have to stay small in rows.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "128",
}

# Bytes of an Arrow batch where rows hold samples or whole texts; Spark's own limit of 10,000 rows lets a batch grow with the partition.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session end at ``BATCH_BYTES``, unless its owner has set a number of bytes.

    Spark reads the limit when it plans a job, so it stays set.  Results do not depend on it.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(BATCH_BYTES))


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "sonoframe") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def local_folder(spark: SparkSession) -> str:
    """A temporary folder in place of a shared one, for a local master only."""
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; a
    temporary one is made only where none is set (local tests).
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or local_folder(spark))
    return df.checkpoint(eager=True)
