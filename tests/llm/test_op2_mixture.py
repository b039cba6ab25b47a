from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from wallscope.llm import op2_mixture as op
from wallscope.llm import oracle, queries
from tools.check_oracle import oracle_rows, spark_rows

SF_DIR = "/root/testdata/sf0.01"


def test_query_equals_its_sql(spark):
    result = queries.QUERIES["op2_mixture"](spark, SF_DIR)
    assert spark_rows(result) == oracle_rows(SF_DIR, oracle.ORACLES["op2_mixture"])
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rates_are_met(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 4 = 0, 'a', if(id % 4 = 1, null, 'hot')) AS source", "'x' AS text")
    got = Counter(r.source for r in op.mix(docs, {"a": 5, None: 3, "hot": 2}, size=1.5).select("row.source").collect())
    assert sum(got.values()) == pytest.approx(30_000, rel=0.03)
    assert [got[s] / 30_000 for s in ("a", None, "hot")] == pytest.approx([0.5, 0.3, 0.2], abs=0.02)


def test_large_and_missing_rates(spark):
    docs = spark.createDataFrame([(i, "rare" if i == 0 else "b", None, i) for i in range(800)], "doc_id long, source string, text string, copy long")
    mixed = op.mix(docs, {"rare": 1.0, "absent": 1.0}, size=1.0).collect()
    assert {r.row.source for r in mixed} == {"rare"} and 650 < len(mixed) < 950
    assert sorted(r.copy for r in mixed) == list(range(1, len(mixed) + 1))
    assert op.mix(docs, {}).count() == 0


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert op.mix(empty).count() == 0
    twice = spark.createDataFrame([(1, "s", "t")] * 2 + [(None, None, "")] * 2, "doc_id long, source string, text string")
    counts = [r.n_copies for r in op.copies(twice, op.rates(twice)).orderBy("row.doc_id").collect()]
    assert counts[0] == counts[1] and counts[2] == counts[3]


def test_rows_without_doc_id_are_spread(spark):
    """Each draws a number of its own and has a place of its own; a hot doc_id fills more than one task."""
    docs = spark.range(8_000).selectExpr("if(id % 2 = 0, null, 7L) AS doc_id", "'s' AS source", "concat('t', id) AS text")
    counts = Counter(r.n_copies for r in op.copies(docs, op.rates(docs)).where("row.doc_id = 7").collect())
    assert len(counts) == 1
    # Partitions this small would be united.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = op.mix(docs, size=4.0).selectExpr("row.*", "mix_key", "copy", "spark_partition_id() AS task").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    unnamed = [r for r in mixed if r.doc_id is None]
    assert len(unnamed) == pytest.approx(16_000, rel=0.05)
    assert len({r.mix_key for r in unnamed}) == len(unnamed)
    for rows in (unnamed, [r for r in mixed if r.doc_id == 7 and r.copy == 1]):
        assert max(Counter(r.task for r in rows).values()) < len(rows) / 4


def test_sql_of_rows_without_doc_id(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = op.mix(docs).select("row.doc_id", "row.source", "copy", "mix_key", "row.text").collect()
    sql = oracle.ORACLES["op2_mixture"]
    with duckdb.connect() as own:
        own.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = own.execute(sql).fetchall()
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, want))
