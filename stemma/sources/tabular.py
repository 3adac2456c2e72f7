"""Tables as CSV with a header, and logs as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows; an empty cell is null, and a cell that isn't of its type fails the job."""
    return spark.read.schema(schema).options(header=True, mode="FAILFAST", enforceSchema=False, emptyValue="").csv(path)


def write_csv(rows: DataFrame, path: str, *, separator: str = ",") -> None:
    """A folder of files, each with a header; numbers have all their digits."""
    rows.write.mode("overwrite").options(header=True, sep=separator).csv(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; none where the log isn't there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def write_log(rows: DataFrame, path: str) -> None:
    """Appends a JSON line for each row."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)
