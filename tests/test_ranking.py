"""Ordinals and running sums: classes over several ranges, null classes, equal rows, no rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from testsieve.operators import passk
from testsieve.operators.ranking import ordinal_within, weight_before

SCHEMA = "k string, o int, w long, i long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [(rng.choice(["a", "b", None, f"c{i % 50}"]), rng.randint(0, 20), rng.randint(0, 5), i) for i in range(3000)]


def by_class(got):
    out = defaultdict(list)
    for r in got:
        out[r.k].append(r)
    return out.values()


@pytest.mark.parametrize("few", [True, False])
def test_ordinal_within(spark, rows, few):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = ordinal_within(df, "k", [F.col("o").desc()], out="r", few_classes=few).collect()
    assert sorted(r.i for r in got) == list(range(3000))
    for part in by_class(got):
        part.sort(key=lambda r: r.r)
        assert [r.r for r in part] == list(range(len(part))) and {r.r_n for r in part} == {len(part)}
        assert [r.o for r in part] == sorted((r.o for r in part), reverse=True)
    assert ordinal_within(df.limit(0), "k", ["o"]).count() == 0


def test_weight_before(spark, rows):
    for part in by_class(weight_before(spark.createDataFrame(rows, SCHEMA).repartition(5), "k", ["o", "i"], "w").collect()):
        total = 0
        for r in sorted(part, key=lambda r: (r.o, r.i)):
            assert r.before == total
            total += r.w
        assert {r.before_total for r in part} == {total}


def test_one_range_exchange_and_equal_rows_spread(spark):
    df = spark.range(4000).select(F.lit("all").alias("k"), F.lit(1).alias("o"))
    seen = []
    from testsieve.operators import ranking
    plan = ranking._dealt(df, "k", ["o"], None)._jdf.queryExecution().toString()
    assert plan.count("Exchange rangepartitioning") >= 1 and "Exchange hashpartitioning" not in plan
    seen = ranking._dealt(df, "k", ["o"], 8).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in seen) < 1500  # though all rows are equal
    assert sorted(r.n for r in ordinal_within(df, "k", ["o"], out="n").collect()) == list(range(4000))


def test_choice_groups_of_one_task_spread(spark):
    df = spark.range(3000).select(F.lit("t").alias("task_id"), (F.col("id") % 1500).cast("double").alias("score"), "id")
    got = passk._choice_groups(df).collect()
    assert len(got) == 3000 and all(r.group == 1499 - r.score and r.n_groups == 1500 for r in got)
