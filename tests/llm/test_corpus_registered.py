from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from kohorta.llm.queries import ORACLES, QUERIES
from kohorta.llm.text import stage
from kohorta.session import BATCH_BYTES_KEY
from tools import check

LOCATION = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(LOCATION).exists(), reason="given tables are absent")


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.sql(f"create view {t} as select * from '{LOCATION}/{t}.parquet'")
    state, text, _ = check.compare(spark, con, name, LOCATION)
    assert state == "ok", text


def test_pipeline(spark):
    docs = spark.read.parquet(f"{LOCATION}/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, stage(step(spark, docs, LOCATION), name)
        if name != "best_fit_packing":
            assert docs.columns == columns and docs.select("doc_id").distinct().count() == docs.count()
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def test_pipeline_hands_python_small_batches(spark, tmp_path, monkeypatch):
    """12 MB of texts reach a stage's Python in several batches, and the session's own size stands again afterwards."""
    before = spark.conf.get(BATCH_BYTES_KEY, None)
    spark.range(0, 6_000, 1, 1).selectExpr("id as doc_id", "repeat('abcd ', 400) as text").write.parquet(str(tmp_path / "documents.parquet"))

    def counted(spark, docs, sf_dir):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})
        return docs.mapInArrow(run, "rows long, bytes long")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("counted", counted)])
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.rows for r in found) == 6_000 and max(r.bytes for r in found) < 5_000_000
    assert spark.conf.get(BATCH_BYTES_KEY, None) == before
