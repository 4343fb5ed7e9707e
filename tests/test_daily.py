"""Daily state: equal to the full extract, and only new days are read."""

import datetime as dt

from custseg.operators import daily
from custseg.operators import features as feat
from custseg.sources.relations import Sources

ORDERS = "Customer_Key long, DateOrdered_Key int, `5_DB2` decimal(18,2), DateCancelled_Key int"


def sources(spark, path, orders):
    from decimal import Decimal
    rows = [(c, d, None if m is None else Decimal(m), x) for c, d, m, x in orders]
    spark.createDataFrame(rows, ORDERS).write.mode("overwrite").parquet(path)
    prem = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (3, 0), (4, 1)], "Customer_Key long, IsActive int")
    return Sources(spark.read.parquet(path), prem, prem, prem, prem, prem)


def day(as_of, back):
    return int((as_of - dt.timedelta(days=back)).strftime("%Y%m%d"))


def same(state, full):
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, full.collect()))


def test_two_days_equal_the_full_extract(spark, tmp_path):
    one, two = dt.date(2020, 3, 1), dt.date(2020, 3, 4)
    old = [(1, day(one, 364), "5.00", -1), (1, day(one, 365), "7.00", -1), (1, day(one, 366), "9.00", -1),
           (2, day(one, 10), "1.50", -1), (2, day(one, 10), None, -1), (3, day(one, 1), "2.00", -1),
           (-1, day(one, 1), "2.00", -1), (4, day(one, 3), "2.00", 20200227), (4, day(one, 0), "-3.25", -1),
           (9, day(one, 2), "1.00", -1)]
    src = sources(spark, str(tmp_path / "o1"), old)
    path = str(tmp_path / "state")
    daily.build(path, src, one, 1)
    for active in (True, False):
        same(daily.features(path, src, one, 1, active), feat.premium_features(src, 1, one, require_active=active))
    new = old + [(1, day(two, 2), "4.00", -1), (2, day(two, 0), "8.00", -1), (4, day(two, 1), "6.00", 20200303)]
    src = sources(spark, str(tmp_path / "o2"), new)
    daily.refresh(path, src)
    same(daily.features(path, src, two, 1), feat.premium_features(src, 1, two))
    daily.refresh(path, src)                               # nothing new: nothing changes
    same(daily.features(path, src, two, 1), feat.premium_features(src, 1, two))
    # an old order is cancelled late: its day is aggregated anew
    late = [(c, d, m, 20200304 if (c, d) == (2, day(one, 10)) else x) for c, d, m, x in new] + [(2, day(one, 10), "3.00", -1)]
    src = sources(spark, str(tmp_path / "o3"), late)
    daily.refresh(path, src, again=[day(one, 10)])
    same(daily.features(path, src, two, 1), feat.premium_features(src, 1, two))


def test_scans_read_the_new_days_only(spark, tmp_path, request):
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.maxMetadataStringLength", old))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    as_of = dt.date(2020, 3, 1)
    src = sources(spark, str(tmp_path / "o"), [(1, day(as_of, b), "1.00", -1) for b in range(0, 400, 20)])
    plan = daily.state_of(daily.orders_of_days(src, 20200220))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(DateOrdered_Key,20200220)" in plan
    path = str(tmp_path / "state")
    daily.build(path, src, as_of, 1)
    read = daily.features(path, src, as_of, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in read
