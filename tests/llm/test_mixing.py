"""Mixing at large rates, and whole rows."""

import math

import duckdb
import pytest
import pyspark.sql.functions as F

from geoloom.llm import mixing
from geoloom.llm.queries import op7_mixing

FOLDER = "/root/testdata/sf0.001"


def reference(u, rate):
    """Terms in log space, summed from zero."""
    k, total = 0, math.exp(-rate)
    while total < u:
        k += 1
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


@pytest.mark.parametrize("rate", [0.3, 744.0, 800.0, 30_000.0])
def test_poisson_inverse_at_large_rates(spark_text, rate):
    rows = spark_text.range(40).selectExpr("(id + 0.5) / 40 AS u", f"CAST({rate} AS DOUBLE) AS rate")
    for r in rows.withColumn("k", mixing.poisson_inverse(F.col("u"), F.col("rate"))).collect():
        assert r.k == reference(r.u, rate)


def test_a_large_rate_does_not_change_another(spark_text):
    docs = spark_text.range(20_000).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id = 0 THEN 'one' WHEN id < 20 THEN 'few' ELSE 'hot' END AS source")
    rows = mixing.mix(docs, weights={"one": 1.0, "few": 0.8, "hot": 0.2}).groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.first("rate").alias("rate")).collect()
    large = [r for r in rows if r.source != "hot"]
    assert len(large) == 20 and {round(r.rate) for r in large} == {10_000, 421}
    assert all(abs(r.n - r.rate) < 6 * math.sqrt(r.rate) for r in large)


def test_query_carries_whole_documents(spark_text, documents):
    rows = op7_mixing(spark_text, FOLDER).collect()
    want = {r.doc_id: r for r in documents[0].collect()}
    assert rows and all((r.text, r.lang, r.source, r.n_chars) == (want[r.doc_id].text, want[r.doc_id].lang, want[r.doc_id].source, want[r.doc_id].n_chars) for r in rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    names = ["doc_id", "text", "lang", "source", "n_chars", "rate", "copies", "copy", "shuffle_key"]
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({mixing.MIX_SQL})").fetchall())
