"""R-vs-Spark semantics of the extracts and features."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from custseg.operators import features as feat
from custseg.sources import extracts
from custseg.sources.relations import Sources

D = dt.date


def _sources(spark, orders, premium, reader=None, cltv=None):
    orders = [(k, d, Decimal(m), c) for k, d, m, c in orders]
    of = spark.createDataFrame(orders, "Customer_Key long, DateOrdered_Key int, `5_DB2` decimal(18,2), DateCancelled_Key int")
    pa = spark.createDataFrame(premium, "Customer_Key long, IsActive int")
    ps = pa.select("Customer_Key")
    rf = spark.createDataFrame(reader or [], "Customer_Key long, Date_Key int, Streaming_Key int, IsBucketRead_Key int, Premium_Key int")
    cl = spark.createDataFrame(cltv or [], "Customer_Key long, Segment string")
    ch = spark.createDataFrame([], "Customer_Key long, RFM_cluster string")
    return Sources(of, pa, ps, rf, cl, ch)


def test_extract_filters_and_fanout(spark):
    orders = [(1, 20010801, 10, -1), (1, 20000801, 5, -1), (1, 20000731, 7, -1),  # window edge
              (-1, 20010101, 3, -1),                                          # unknown key
              (2, 20010101, 4, 20010102),                                     # cancelled
              (3, 20010101, 2, -1), (4, 20010101, 9, -1)]
    premium = [(1, 1), (3, 1), (3, 1), (4, 0)]          # 3 duplicated, 4 inactive
    src = _sources(spark, orders, premium)
    got = sorted((r["Customer_Key"], r["DateOrdered_Key"]) for r in
                 extracts.orders_extract(src, years=1, as_of=D(2001, 8, 1)).collect())
    assert got == [(1, 20000801), (1, 20010801), (3, 20010101), (3, 20010101)]
    dup = extracts.duplicate_keys(src.premium_active).collect()
    assert [r["Customer_Key"] for r in dup] == [3]
    anyp = extracts.orders_extract(src, 1, D(2001, 8, 1), require_active=False)
    assert {r["Customer_Key"] for r in anyp.collect()} == {1, 3, 4}
    assert anyp.columns[-1] == "IsActive"


def test_non_premium_is_anti_join(spark):
    src = _sources(spark, [(1, 20010101, 1, -1), (5, 20010101, 1, -1)], [(1, 1)])
    out = extracts.orders_non_premium(src, 1, D(2001, 8, 1))
    assert [r["Customer_Key"] for r in out.collect()] == [5]
    assert "LeftAnti" in out._jdf.queryExecution().optimizedPlan().toString()


def test_features_na_propagation_and_malformed_dates(spark):
    lines = spark.createDataFrame(
        [(1, D(2001, 1, 1), 10.0), (1, D(2001, 3, 1), None), (2, D(2001, 2, 1), -5.0),
         (2, D(2001, 2, 3), 1.0)],
        "Customer_Key long, Date date, DB2 double").withColumn("DB2", F.col("DB2").cast("decimal(18,2)"))
    f = {r["Customer_Key"]: r for r in feat.rfmt_features(lines).collect()}
    assert f[1]["Monetary"] is None                  # sum(NA) is NA
    assert f[2]["Monetary"] == -4.0                  # negative money kept
    assert f[1]["RecencyDays"] == 0 and f[1]["Tenure"] == 59
    assert f[2]["Frequency"] == 2 and f[2]["RecencyDays"] == 26
    skip = {r["Customer_Key"]: r for r in feat.rfmt_features(lines, na_policy="skip").collect()}
    assert skip[1]["Monetary"] == 10.0
    # malformed date key -> NULL date -> NULL reference date under R's rules
    orders = spark.createDataFrame([(1, 20010230, 1), (1, 20010101, 1)],
                                   "Customer_Key long, DateOrdered_Key int, `5_DB2` int")
    ol = feat.order_lines(orders)
    assert sorted(str(r["Date"]) for r in ol.collect()) == ["2001-01-01", "None"]
    assert feat.rfmt_features(ol).collect()[0]["RecencyDays"] is None


def test_reference_date_modes(spark):
    lines = spark.createDataFrame([(1, D(2001, 1, 1), 1.0), (2, D(2001, 1, 11), 1.0)],
                                  "Customer_Key long, Date date, DB2 double")
    a = {r["Customer_Key"]: r["RecencyDays"] for r in feat.rfmt_features(lines).collect()}
    b = {r["Customer_Key"]: r["RecencyDays"] for r in
         feat.rfmt_features(lines, reference=D(2001, 1, 21)).collect()}
    assert a == {1: 10, 2: 0} and b == {1: 20, 2: 10}


def test_cohort_vs_all_reference(spark):
    orders = [(1, 20010101, 1, -1), (2, 20010301, 1, -1)]
    src = _sources(spark, orders, [(1, 1), (2, 1)], reader=[(1, 20010101, 1, 1, 1)],
                   cltv=[(1, "BTC"), (2, "X"), (1, "BTC")])
    lines = feat.order_lines(extracts.orders_extract(src, 1, D(2001, 8, 1)))
    stream = extracts.streaming_counts(src, 1, D(2001, 8, 1))
    seg = extracts.segment_lookup(src)
    cohort = feat.rfmts_features(lines, stream, seg, "BTC", "cohort").collect()
    allref = feat.rfmts_features(lines, stream, seg, "BTC", "all").collect()
    assert [(r["Customer_Key"], r["RecencyDays"], r["Streaming"]) for r in cohort] == [(1, 0, 1)]
    assert [(r["Customer_Key"], r["RecencyDays"]) for r in allref] == [(1, 59)]


def test_streaming_counts_zero_fill(spark):
    src = _sources(spark, [], [(1, 1), (2, 1), (2, 1)],
                   reader=[(1, 20010101, 1, 1, 1), (1, 20010102, 1, 0, 1), (1, 20010103, 1, 1, 1)])
    got = {r["Customer_Key"]: r["n"] for r in
           extracts.streaming_counts(src, 1, D(2001, 8, 1)).collect()}
    assert got == {1: 2, 2: 0}


def test_one_orders_scan_for_features(spark):
    from custseg.plans import queries as Q
    df = Q.customer_tiers(spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the per-customer aggregate is read from one persisted relation by both
    # the reference-date subquery and the features (event logs show a single
    # scan stage over orders)
    assert "InMemoryTableScan" in plan and "ReusedSubquery" in plan

    import contextlib
    import io
    from custseg.sources import relations
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        extracts.orders_extract(relations.fixture_sources(spark, "/root/testdata/sf0.001"), 1, D(2001, 8, 1)) \
            .explain("formatted")
    text = buf.getvalue()
    assert "GreaterThanOrEqual(o_orderdate,2000-08-01T00:00)" in text     # window reaches the scan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz>" in text


def test_aggregate_first_equals_join_first(spark):
    orders = [(1, 20010101, 10, -1), (1, 20010301, 5, -1), (3, 20010101, 2, -1),
              (3, 20010201, 4, -1), (4, 20010101, 9, -1), (5, 20000101, 1, -1)]
    premium = [(1, 1), (3, 1), (3, 1), (4, 0), (5, 1)]      # 3 listed twice: fan-out
    src = _sources(spark, orders, premium)
    a = feat.premium_features(src, 1, D(2001, 8, 1), None, "all")
    b = feat.rfmt_features(feat.order_lines(extracts.orders_extract(src, 1, D(2001, 8, 1))))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    got = {r["Customer_Key"]: (r["Frequency"], r["Monetary"]) for r in a.collect()}
    assert got[3] == (4, 12.0)


def test_two_segments_and_missing_segment(spark):
    feats = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "Customer_Key long, RecencyDays int")
    segs = spark.createDataFrame([(1, "BTC"), (1, "X"), (1, "BTC"), (2, None)],
                                 "Customer_Key long, Segment string").distinct()
    got = sorted((r["Customer_Key"], r["Segment"]) for r in feat.features_by_segment(feats, segs).collect())
    # customer 1 appears once per segment (left_join semantics), 2 (NULL) and 3 (none) drop out
    assert got == [(1, "BTC"), (1, "X")]


def test_table_sources_read_catalog_views(spark):
    from custseg.sources import relations
    fx = relations.fixture_sources(spark, "/root/testdata/sf0.001")
    names = {}
    for field in ("order_fact", "premium_active", "premium_subscribed", "reader_fact",
                  "cltv_input", "churn_data"):
        getattr(fx, field).createOrReplaceTempView(f"t_{field}")
        names[field] = f"t_{field}"
    src = relations.table_sources(spark, names)
    a = sorted(map(tuple, extracts.orders_extract(src, 3, D(2001, 8, 1)).collect()))
    b = sorted(map(tuple, extracts.orders_extract(fx, 3, D(2001, 8, 1)).collect()))
    assert a == b and len(a) > 0
