"""What keeps merging in proportion to its input: spread records, pruned parts, values computed once, and equal results of few and of many entries."""

import pytest
from pyspark.sql import functions as F

from fusionweft.functions.core import let, strip
from fusionweft.operators import facts as fact_rows
from fusionweft.operators import merge as merging
from fusionweft.plans import queries as q


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    return q.three(q.rows(spark, sf_dir, q._THREE))


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_are_spread_over_tasks(spark, raw):
    sizes = [r["count"] for r in raw.groupBy(F.spark_partition_id()).count().collect()]
    assert raw.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and len(sizes) == 4
    assert max(sizes) < 2 * min(sizes)


@pytest.mark.parametrize(("column", "not_asked"), [("skills", ("facts", "education", "links")), ("provenance", ("skills", "experience", "education")), ("education", ("facts", "skills"))])
def test_parts_that_are_not_asked_for_are_not_made(raw, column, not_asked):
    plan = optimised(merging.merge(raw).select("candidate_id", column))
    assert column.replace("provenance", "facts") in plan
    assert not [x for x in not_asked if f"AS {x}#" in plan]


def test_provenance_is_computed_once(raw):
    below = optimised(fact_rows.low_confidence(fact_rows.facts(merging.merge(raw)))).partition("Generate")[2]
    assert below.count("_wins") == 1


@pytest.mark.parametrize("n", [0, 1, merging.FEW, merging.FEW + 1])
def test_few_and_many_entries_are_grouped_alike(spark, n):
    values = [(k * k) % 7 for k in range(n)]
    df = spark.createDataFrame([([str(v) for v in values],)], "v array<string>")
    groups, first = df.select(merging._groups(F.col("v"), lambda x, _: x).alias("g"), merging._first_of(F.col("v"), lambda x, _: x).alias("f")).first()
    assert first == [str(v) for v in dict.fromkeys(values)]
    assert sorted([e["i"] for e in g] for g in groups) == sorted([k for k, v in enumerate(values) if v == own] for own in set(values))
    assert all(e["k"] == e["x"] == str(values[e["i"]]) for g in groups for e in g)


def test_strip_takes_all_white_space(spark):
    codes = spark.range(1, 0xD800).select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    both = codes.select("id", strip(F.concat("c", F.lit("a b"), "c")).alias("got"), F.regexp_replace(F.concat("c", F.lit("a b"), "c"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "").alias("want"))
    assert both.where("got <> want").collect() == []
    assert both.where("got = 'a b'").count() == len(set(" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000")) + 11


def test_let(spark):
    got = spark.range(3).select(let(F.when(F.col("id") > 0, F.col("id")), lambda x: let(x + 1, lambda y: F.coalesce(x * y, F.lit(-1)))).alias("v")).collect()
    assert [r["v"] for r in got] == [-1, 2, 6]
