"""Bucketed tables: same features, and no Exchange on the customer."""

import datetime as dt
import uuid
from decimal import Decimal

from custseg.operators import features as feat
from custseg.sources import bucketed, extracts
from custseg.sources.relations import Sources

AS_OF = dt.date(2020, 3, 1)


def day(back):
    return int((AS_OF - dt.timedelta(days=back)).strftime("%Y%m%d"))


def sources(spark):
    orders = [(c, day((c * 7 + j) % 400), None if (c, j) == (5, 1) else Decimal(f"{c + j}.25"), -1 if j % 4 else day(0))
              for c in range(-1, 60) for j in range(c % 6 + 1)] + [(2, day(3), Decimal("1.00"), -1)] * 500
    reads = [(c, day(j * 30), 1, j % 2, 1) for c in range(60) for j in range(c % 16)]
    o = spark.createDataFrame(orders, "Customer_Key long, DateOrdered_Key int, `5_DB2` decimal(18,2), DateCancelled_Key int")
    r = spark.createDataFrame(reads, "Customer_Key long, Date_Key int, Streaming_Key int, IsBucketRead_Key int, Premium_Key int")
    prem = spark.createDataFrame([(c, int(c % 5 > 0)) for c in range(50)] + [(3, 1), (4, 1)], "Customer_Key long, IsActive int")
    segs = spark.createDataFrame([(c, "BTC" if c % 2 else None) for c in range(60)] + [(7, "BTC"), (7, "X")],
                                 "Customer_Key long, Segment string")
    return Sources(o, prem, prem.select("Customer_Key"), r, segs, segs)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_equal_to_the_plain_path_without_exchange(spark, tmp_path):
    src, prefix = sources(spark), f"t_{uuid.uuid4().hex}"
    for _ in range(2):                                   # a repeated build replaces its tables
        bucketed.build(src, prefix, str(tmp_path), buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for segment in ("BTC", None):
            stream = extracts.streaming_counts(src, 1, AS_OF)
            plain = feat.premium_features(src, 1, AS_OF, segment, "cohort", stream, extracts.segment_lookup(src))
            fast = bucketed.premium_features(spark, prefix, AS_OF, 1, segment, AS_OF)
            assert fast.columns == plain.columns and rows(fast) == rows(plain) and rows(plain)
            plan = fast._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning" not in plan and "Bucketed: true" in plan
            assert "hashpartitioning" in plain._jdf.queryExecution().executedPlan().toString()
        assert rows(bucketed.premium_features(spark, prefix, AS_OF, 1, require_active=False)) == \
            rows(feat.premium_features(src, 1, AS_OF, require_active=False))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert rows(bucketed.streaming_counts(spark, prefix, AS_OF)) == rows(extracts.streaming_counts(src, 1, AS_OF))
    # the customer of 500 orders a day is one row a day
    assert spark.table(f"{prefix}_orders").filter("Customer_Key = 2").count() <= 4


def test_empty_facts(spark, tmp_path):
    src, prefix = sources(spark), f"t_{uuid.uuid4().hex}"
    none = Sources(src.order_fact.limit(0), src.premium_active, src.premium_subscribed, src.reader_fact.limit(0),
                   src.cltv_input, src.churn_data)
    bucketed.build(none, prefix, str(tmp_path), buckets=2)
    assert bucketed.premium_features(spark, prefix, AS_OF, 1, "BTC", AS_OF).count() == 0
    assert {n for _, n in rows(bucketed.streaming_counts(spark, prefix, AS_OF))} == {0}
