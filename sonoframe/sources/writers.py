"""Sinks: windows, manifests, reports, live results."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sonoframe import settings
from sonoframe.functions import checks as C


def write_windows(df: DataFrame, path: str, partition: str = "split") -> None:
    """Fixed windows as Parquet, one folder per subset."""
    df.write.mode("overwrite").partitionBy(partition).parquet(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """Manifest CSV with the fixed column order; quotes are doubled, as ``scan_manifest`` reads them."""
    df.select(*settings.MANIFEST_COLUMNS).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _has_non_finite(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.coalesce(F.isnan(column) | (F.abs(column) == float("inf")), F.lit(False))
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.exists(column, lambda x: _has_non_finite(x, dtype.elementType)), F.lit(False))
    if isinstance(dtype, T.MapType):
        return F.coalesce(F.exists(F.map_values(column), lambda x: _has_non_finite(x, dtype.valueType)), F.lit(False))
    if isinstance(dtype, T.StructType):
        out = F.lit(False)
        for f in dtype.fields:
            out = out | _has_non_finite(column[f.name], f.dataType)
        return out
    return F.lit(False)


def guard_finite(df: DataFrame) -> DataFrame:
    """Fail the write when any number of a row, at any depth, is NaN or infinite."""
    bad = F.lit(False)
    for f in df.schema.fields:
        bad = bad | _has_non_finite(F.col(f.name), f.dataType)
    first, dtype = df.columns[0], df.schema.fields[0].dataType
    guarded = F.when(bad, F.raise_error(F.lit("a report must not contain NaN or infinity")).cast(dtype)).otherwise(F.col(first))
    return df.withColumn(first, guarded)


def write_report(df: DataFrame, path: str, private_keys=settings.REPORT_PRIVATE_KEYS) -> None:
    """Report or model rows as JSON: identifier fields removed, only finite numbers.

    The commit protocol publishes the files at job end, so readers never see half a report.
    """
    shown = df.select(*[
        C.drop_private_fields(F.col(f.name), f.dataType, private_keys).alias(f.name)
        for f in df.schema.fields if f.name not in private_keys])
    guard_finite(shown).write.mode("overwrite").json(path)


def write_results(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Live results as one JSON object per update; runs until the input is used up."""
    return (
        stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
