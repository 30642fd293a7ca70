"""Tables from CSV, Parquet and inline rows."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A CSV file or folder with an inferred schema; headerless columns are named by position."""
    return spark.read.option("header", header).option("inferSchema", True).csv(path)


def remote_csv(spark: SparkSession, url: str, header: bool = True) -> DataFrame:
    """The same from a URL. Stores that Spark reads are read by Spark; others are streamed by an executor, line by line, and kept there."""
    if urlparse(url).scheme not in ("http", "https", "ftp"):
        return local_csv(spark, url, header)

    def lines(urls: Iterator[str]) -> Iterator[str]:
        from urllib.request import urlopen

        for u in urls:
            with urlopen(u) as response:
                for line in response:
                    yield line.decode("utf-8").rstrip("\r\n")

    # Kept on disk: inference and reading both need it, and the server should be asked once.
    body = spark.sparkContext.parallelize([url], 1).mapPartitions(lines).persist(StorageLevel.DISK_ONLY)
    return spark.read.option("header", header).option("inferSchema", True).csv(body)


def named(df: DataFrame, *names: str) -> DataFrame:
    """Columns renamed by position."""
    return df.toDF(*names)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
