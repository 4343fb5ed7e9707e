"""A third of all rows on one key / one value: results stay exact and whole,
and no task receives the hot group as a whole."""

import datetime as dt
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from custseg.operators import features as feat
from custseg.operators.quantiles import TileSpec, exact_ntile
from tests.reference_impl import window_ntile
from custseg.sources.relations import Sources


def _src(spark, orders, premium):
    of = spark.createDataFrame(orders, "Customer_Key long, DateOrdered_Key int, `5_DB2` decimal(18,2), DateCancelled_Key int")
    pa = spark.createDataFrame(premium, "Customer_Key long, IsActive int")
    e = spark.createDataFrame([], "Customer_Key long, Date_Key int, Streaming_Key int, IsBucketRead_Key int, Premium_Key int")
    c = spark.createDataFrame([], "Customer_Key long, Segment string")
    h = spark.createDataFrame([], "Customer_Key long, RFM_cluster string")
    return Sources(of, pa, pa.select("Customer_Key"), e, c, h)


def test_hot_customer_features_exact(spark):
    orders = []
    for i in range(3000):
        key = 7 if i % 3 == 0 else 100 + i % 400         # customer 7 holds a third of the orders
        day = dt.date(2001, 1, 1) + dt.timedelta(days=i % 200)
        orders.append((key, int(day.strftime("%Y%m%d")), Decimal(f"{(i % 97) + 0.25:.2f}"), -1))
    premium = [(7, 1)] + [(100 + j, 1) for j in range(400)]
    src = _src(spark, orders, premium)
    got = feat.premium_features(src, 1, dt.date(2001, 8, 1), None, "all").toPandas() \
        .set_index("Customer_Key").sort_index()
    pdf = pd.DataFrame(orders, columns=["k", "d", "m", "c"])
    pdf["date"] = pd.to_datetime(pdf["d"].astype(str))
    ref_day = pdf["date"].max()
    exp = pdf.groupby("k").agg(last=("date", "max"), first=("date", "min"), n=("k", "size"),
                               m=("m", lambda s: float(sum(s))))
    assert len(got) == 401
    assert (got["Frequency"] == exp["n"]).all()
    assert (got["Monetary"].round(2) == exp["m"].round(2)).all()
    assert (got["RecencyDays"] == (ref_day - exp["last"]).dt.days).all()
    assert (got["Tenure"] == (ref_day - exp["first"]).dt.days).all()
    assert got.loc[7, "Frequency"] == 1000


def test_partial_aggregation_before_shuffle(spark):
    src = _src(spark, [(1, 20010101, Decimal("1.00"), -1)], [(1, 1)])
    agg = feat.order_aggregates_premium(src, 1, dt.date(2001, 8, 1))
    plan = agg._jdf.queryExecution().executedPlan().toString()
    # partial_max / partial_count run map-side, before the exchange on the key
    first_exchange = plan.rfind("Exchange hashpartitioning(Customer_Key")
    assert first_exchange > 0 and plan.find("partial_count", first_exchange) > first_exchange


def test_hot_value_is_split_across_partitions(spark):
    n = 6000
    rows = [(i, 0.0 if i % 3 == 0 else float(i)) for i in range(n)]   # a third share the value 0
    df = spark.createDataFrame(rows, "k long, v double")
    ranged = df.repartitionByRange(8, "v", "k")
    sizes = [r["c"] for r in ranged.groupBy(F.spark_partition_id().alias("p"))
             .agg(F.count(F.lit(1)).alias("c")).collect()]
    assert max(sizes) < 2 * n / 8                 # the hot value does not land in one task
    spec = [TileSpec("v", "q")]
    got = {r["k"]: r["q"] for r in exact_ntile(df, "k", spec).collect()}
    ref = {r["k"]: r["q"] for r in window_ntile(df, "k", spec).collect()}
    assert got == ref and len(got) == n
