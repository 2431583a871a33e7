"""What runs leave on disk: shuffle files of written stages, and stages after their last reader."""

import time
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kohorta.llm import text
from kohorta.llm.jaccard import jaccard_components
from kohorta.session import SHUFFLE_FILES_KEY, materialize, shared_folder
from kohorta.sources import sinks


def shuffle_files(spark):
    folders = [Path(f.getPath()) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return {p for folder in folders for p in folder.rglob("shuffle_*.data")}


def labels(spark):
    folder = Path(shared_folder(spark).removeprefix("file://"), "kohorta-scratch")
    return {p.name for p in folder.glob("*")}


@pytest.mark.parametrize("run", [
    lambda df, path: text.stage(df, "trial"), lambda df, path: materialize(df),
    lambda df, path: sinks.stage(df.sparkSession, path, lambda: df)])
def test_written_rows_leave_no_shuffle_files(spark, tmp_path, run):
    df = spark.range(20_000).groupBy((F.col("id") % 5_000).alias("k")).agg(F.count("*").alias("n"))
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLE_FILES_KEY, None)
    rows = run(df, str(tmp_path / "rows"))
    left = shuffle_files(spark) - before
    for _ in range(50):  # they go a moment later
        if not left:
            break
        time.sleep(0.1)
        left = shuffle_files(spark) - before
    assert not left
    assert rows.count() == 5_000 and rows.agg(F.sum("n")).first()[0] == 20_000
    assert spark.conf.get(SHUFFLE_FILES_KEY, None) == setting


def test_jaccard_keeps_only_what_its_result_reads(spark):
    texts = [" ".join(f"w{i % 8}x{k}" for k in range(40)) + f" end{i}" for i in range(24)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = labels(spark)
    found = jaccard_components(docs, 3, (80, 100))
    left = {name.rsplit("-", 1)[0] for name in labels(spark) - before}
    assert left <= {"counts", "classes", "inside", "final", "edges"}
    assert sorted(r.component_id for r in found.collect()) == sorted([*(3 * list(range(8))), 24, 25])


def test_pipeline_drops_a_stage_after_the_next(spark, tmp_path, monkeypatch):
    spark.range(100).selectExpr("id as doc_id", "'a' as text").write.parquet(str(tmp_path / "documents.parquet"))
    steps = [(n, lambda spark, docs, sf_dir: docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays(
        b.columns, names=b.schema.names) for b in batches), docs.schema)) for n in ("one", "two", "three")]
    monkeypatch.setattr(corpus_pipeline, "STAGES", steps)
    before = labels(spark)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 100
    assert {name.rsplit("-", 1)[0] for name in labels(spark) - before} == {"pipeline-three"}
