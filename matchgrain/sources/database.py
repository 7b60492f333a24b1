"""Tables of a relational database, read in parallel by ranges of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, url: str, table: str, key: str, parts: int = 8, properties: dict[str, str] | None = None) -> DataFrame:
    """``table`` in ``parts`` partitions by equal ranges of a whole-number ``key``; filters and columns are pushed to the database.

    The key's bounds are asked for first; they only set the ranges, so rows beyond them or without a key are read too. An
    empty table is one partition.
    """
    reader = lambda: spark.read.format("jdbc").options(url=url, **(properties or {}))
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    low, high = reader().option("query", f"select min({quoted}) as lo, max({quoted}) as hi from {table}").load().first()
    whole = reader().option("dbtable", table)
    if low is None:
        return whole.load()
    return whole.options(partitionColumn=key, lowerBound=str(int(low)), upperBound=str(int(high) + 1), numPartitions=str(parts)).load()
