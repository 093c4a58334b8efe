"""The registered queries of the subpackage against their oracle SQL, and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from checks.compare import TABLES, canonical
from panelloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, FOLDER)
    result = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert canonical(frame.columns, [tuple(r) for r in frame.collect()]) == canonical(columns, result.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == [*docs.columns, "shard"]
    assert out.join(docs.select("doc_id", "text"), ["doc_id", "text"], "left_anti").isEmpty()
    counts = {r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts <= {1, 2} and {r["shard"] for r in out.collect()} <= set(range(24))
