"""Rows of an external database (S3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def query_options(url: str, sql: str, **connection: str) -> dict[str, str]:
    """Options that run one query. It is read by one task: for results of moderate size."""
    return {"url": url, "query": sql, **connection}


def table_options(url: str, name: str, column: str, lower: int, upper: int, partitions: int,
                  **connection: str) -> dict[str, str]:
    """Options that read a table in ``partitions`` key ranges, each by its own task. Keys outside are read too."""
    return {"url": url, "dbtable": name, "partitionColumn": column, "lowerBound": str(lower),
            "upperBound": str(upper), "numPartitions": str(partitions), **connection}


def query_rows(spark: SparkSession, url: str, sql: str, **connection: str) -> DataFrame:
    """S3: the result of a query, columns by name."""
    return spark.read.format("jdbc").options(**query_options(url, sql, **connection)).load()


def table_rows(spark: SparkSession, url: str, name: str, column: str, lower: int, upper: int, partitions: int,
               **connection: str) -> DataFrame:
    """S3 for whole tables, read in parallel."""
    options = table_options(url, name, column, lower, upper, partitions, **connection)
    return spark.read.format("jdbc").options(**options).load()


def keyed_table(spark: SparkSession, url: str, name: str, column: str = "id", partitions: int = 32,
                **connection: str) -> DataFrame:
    """S3 for a whole table with a numeric key: its key bounds are asked first, then key ranges are read in parallel."""
    bounds = query_rows(spark, url, f"select min({column}) as low, max({column}) as high from {name}", **connection)
    low, high = bounds.first()
    if low is None:
        return query_rows(spark, url, f"select * from {name}", **connection)
    return table_rows(spark, url, name, column, int(low), int(high) + 1, partitions, **connection)
