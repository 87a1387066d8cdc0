"""Generated tables: a range, and one without end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def range_table(spark: SparkSession, n: int, name: str = "idx") -> DataFrame:
    """The ints 1 to n, in order."""
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias(name))


def unbounded_table(spark: SparkSession, rows_per_second: int = 1000, n: int = 1 << 18, name: str = "idx") -> DataFrame:
    """A stream without end that runs through 1 to n again and again."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select((F.col("value") % n + 1).cast("int").alias(name), "timestamp")


def grouped_counts(df: DataFrame, width: int = 1000, name: str = "idx") -> DataFrame:
    """Rows for each value of idx div width."""
    return df.groupBy(F.expr(f"{name} div {width}").cast("int").alias("bucket")).agg(F.count("*").alias("n"))
