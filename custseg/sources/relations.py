"""The six warehouse relations the reference reads, with explicit schemas.

``fixture_sources`` maps them onto the driver's Parquet tables as documented in
FIXTURES.md; ``table_sources`` / ``jdbc_sources`` read real tables.  Every
relation is a lazy DataFrame, so Catalyst prunes columns and pushes the
extract predicates into the scan.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custseg.functions.dates import date_key

# Fixed "today" of the fixtures (FIXTURES.md): never current_date().
ORDERS_AS_OF = _dt.date(2001, 8, 1)
READER_AS_OF = _dt.date(2024, 1, 30)

# Column types of the relations (survey §1.1).
ORDER_FACT_COLUMNS = {
    "Customer_Key": "bigint", "DateOrdered_Key": "int", "5_DB2": "decimal(18,2)",
    "DateCancelled_Key": "int", "Date": "date",
}
READER_FACT_COLUMNS = {
    "Customer_Key": "bigint", "Date_Key": "int", "Streaming_Key": "int",
    "IsBucketRead_Key": "int", "Premium_Key": "int", "Date": "date",
}


@dataclass
class Sources:
    """The reference's input relations.

    ``order_fact``         Customer_Key, DateOrdered_Key, 5_DB2, DateCancelled_Key[, Date]
    ``premium_active``     Customer_Key, IsActive
    ``premium_subscribed`` Customer_Key
    ``reader_fact``        Customer_Key, Date_Key, Streaming_Key, IsBucketRead_Key, Premium_Key[, Date]
    ``cltv_input``         Customer_Key, Segment
    ``churn_data``         Customer_Key, RFM_cluster

    The optional ``Date`` column is the parsed day of the integer key; when a
    table stores it (or is partitioned by it) the day-window predicate is
    evaluated on it and reaches the scan as a pushed filter.
    """

    order_fact: DataFrame
    premium_active: DataFrame
    premium_subscribed: DataFrame
    reader_fact: DataFrame
    cltv_input: DataFrame
    churn_data: DataFrame


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture_sources(spark: SparkSession, sf_dir: str) -> Sources:
    """Views over /root/testdata/sf*/ exactly as FIXTURES.md defines them."""
    orders = _read(spark, sf_dir, "orders")
    customer = _read(spark, sf_dir, "customer")
    events = _read(spark, sf_dir, "events")

    odate = F.col("o_orderdate").cast("date")
    okey = date_key(odate)
    order_fact = orders.select(
        F.col("o_custkey").cast("bigint").alias("Customer_Key"),
        okey.alias("DateOrdered_Key"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("5_DB2"),
        F.when(F.col("o_orderstatus") == "F", okey).otherwise(F.lit(-1)).cast("int")
        .alias("DateCancelled_Key"),
        odate.alias("Date"),
    )
    # the premium tables are the customers whose key is not a multiple of 3
    premium_rows = customer.filter(F.col("c_custkey") % 3 != 0)
    premium_active = premium_rows.select(
        F.col("c_custkey").cast("bigint").alias("Customer_Key"),
        F.when(F.col("c_acctbal") >= 0, 1).otherwise(0).cast("int").alias("IsActive"),
    )
    premium_subscribed = premium_rows.select(
        F.col("c_custkey").cast("bigint").alias("Customer_Key"))
    edate = F.col("ts").cast("date")
    reader_fact = events.select(
        F.col("user_id").cast("bigint").alias("Customer_Key"),
        date_key(edate).alias("Date_Key"),
        F.when(F.col("event_type").isin("view", "click"), 1).otherwise(0).cast("int")
        .alias("Streaming_Key"),
        F.when(F.col("event_type") != "error", 1).otherwise(0).cast("int")
        .alias("IsBucketRead_Key"),
        F.lit(1).cast("int").alias("Premium_Key"),
        edate.alias("Date"),
    )
    cltv_input = customer.select(
        F.col("c_custkey").cast("bigint").alias("Customer_Key"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("BTC"))
        .otherwise(F.col("c_mktsegment")).alias("Segment"),
    )
    churn_data = customer.select(
        F.col("c_custkey").cast("bigint").alias("Customer_Key"),
        F.col("c_mktsegment").alias("RFM_cluster"),
    )
    return Sources(order_fact, premium_active, premium_subscribed, reader_fact,
                   cltv_input, churn_data)


def table_sources(spark: SparkSession, names: dict[str, str]) -> Sources:
    """Catalog tables, e.g. ``{"order_fact": "sales.orders", ...}``."""
    return Sources(**{field: spark.table(tbl) for field, tbl in names.items()})


def jdbc_sources(spark: SparkSession, url: str, tables: dict[str, str],
                 properties: dict[str, str], partitioning: dict[str, tuple] | None = None
                 ) -> Sources:
    """Warehouse tables over JDBC.

    ``partitioning`` maps a field to ``(column, lower, upper, num_partitions)`` so
    that large fact tables are read by many tasks in parallel (e.g. the order
    fact by ``DateOrdered_Key``); small dimensions are read in one query.
    """
    partitioning = partitioning or {}
    frames = {}
    for field, tbl in tables.items():
        if field in partitioning:
            col, lo, hi, n = partitioning[field]
            frames[field] = spark.read.jdbc(url, tbl, column=col, lowerBound=lo,
                                            upperBound=hi, numPartitions=n,
                                            properties=properties)
        else:
            frames[field] = spark.read.jdbc(url, tbl, properties=properties)
    return Sources(**frames)
