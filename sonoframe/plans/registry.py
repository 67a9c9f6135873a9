"""Registration of queries and small helpers shared by the query modules."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name, with its SQL when there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a tiny table arrives as fewer partitions; a no-op on real data."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def r6(c, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def block_total(series: str, block: int, width: int) -> Column:
    """Total of the ``block``-th run of ``width`` values of a series."""
    return F.aggregate(F.slice(series, block * width + 1, width), F.lit(0.0), lambda total, x: total + x.cast("double"))


def block_total_sql(series: str, block: int, width: int) -> str:
    return f"list_sum(list_transform({series}[{block * width + 1}:{(block + 1) * width}], lambda x: x::DOUBLE))"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: r6(n, digits) for n in names})


def s6(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL, without negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"
