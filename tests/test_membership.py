"""Bloom pre-filter: exact results, few false positives, bounded filter."""

import pytest

from custseg.operators import membership as m

KEYS = [None] + [7 * i for i in range(300)] * 2


def frames(spark, kind="bigint"):
    facts = spark.range(20_000).selectExpr(f"CAST(IF(id % 50 = 0, NULL, id % 10000) AS {kind}) AS k", "id AS v",
                                           "id AS _word", "'x' AS `a.b`").repartition(8)
    keys = spark.createDataFrame([(k,) for k in KEYS], "k long").selectExpr(f"CAST(k AS {kind}) AS k")
    return facts, keys


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_exact_whatever_the_bound(spark, kind):
    facts, keys = frames(spark, kind)
    want = sorted(map(tuple, facts.join(keys, "k", "left_semi").select("v", "_word").collect()))
    for bound in (1, 40, 300, 10 ** 12):
        got = m.bloom_semi_join(facts, keys, "k", bound)
        assert got.columns == facts.columns
        assert sorted(map(tuple, got.select("v", "_word").collect())) == want


def test_rows_leave_before_the_shuffle(spark):
    facts, keys = frames(spark)
    members = facts.join(keys, "k", "left_semi").count()
    passed = m.may_contain(facts, keys, "k", 300).count()
    assert members <= passed <= members + 0.02 * 20_000        # at most two in a hundred pass wrongly
    assert m.may_contain(facts, keys, "k", 1).count() >= passed
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = m.bloom_semi_join(facts, keys, "k", 300)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # the fact's branch: semi join, its shuffle, and below both the filter by the words
    fact = plan[plan.index("SortMergeJoin"):]
    assert fact.index("Exchange hashpartitioning(k") < fact.index("Filter") < fact.index("Scan")
    assert "subquery" in fact[fact.index("Filter"):].split("\n")[0].lower()


def test_no_keys_and_types(spark):
    facts, keys = frames(spark)
    assert m.bloom_semi_join(facts, keys.limit(0), "k", 10).count() == 0
    assert m.bloom_semi_join(facts.limit(0), keys, "k", 10).count() == 0
    with pytest.raises(ValueError):
        m.bloom_semi_join(facts, keys.selectExpr("CAST(k AS int) AS k"), "k", 10)
    assert m.words_for(10 ** 15) == m.MAX_WORDS and m.words_for(0) == 1
