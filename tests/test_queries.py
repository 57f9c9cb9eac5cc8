from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from textloom.plans import catalogue
from textloom.streaming.predict import event_counts, stream_predictions, stream_requests, write_available

from .oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, con, name):
    df = catalogue.queries()[name](spark, sf)
    if sql := catalogue.oracle_sql().get(name):
        compare(df, con, sql)
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["request_id", "mode"] and df.count() > 0


def test_expected_segment_counts(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("no fixture")
    assert catalogue.queries()["segment_sentence"](spark, folder).count() == 34283
    assert catalogue.queries()["segment_paragraph"](spark, folder).count() == 8899
    assert catalogue.queries()["html_blocks"](spark, folder).count() == 2608


def test_predict_plan_is_narrow(spark, sf):
    plan = catalogue.queries()["predict_sentence"](spark, f"{sf}")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") <= 1  # the only one deals out a small table


def test_stream_gives_the_batch_rows(spark, sf, tmp_path):
    source = tmp_path / "in"
    requests = catalogue.requests_of(catalogue.read_table(spark, sf, "documents").limit(40), "doc_id", "text", "paragraph")
    requests.write.parquet(str(source))
    query = write_available(stream_predictions(stream_requests(spark, str(source), 1)), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    batch = catalogue.predict.predictions(spark.read.parquet(str(source)))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == batch.count() and got.select(batch.columns).exceptAll(batch).count() == 0


def test_late_events_are_dropped(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-05 00:00:00", "a"), (3, "2024-01-01 01:00:00", "a"), (4, "2024-01-09 00:00:00", "a")]
    for i, r in enumerate(rows):
        spark.createDataFrame([(*r, 1.0)], "event_id long, ts string, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    schema = spark.read.parquet(str(tmp_path / "in" / "0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = event_counts(stream).writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    days = {str(r.window.start)[:10]: r.n for r in spark.table("late").collect()}
    assert days.get("2024-01-05") == 1


def test_rest_works_without_the_pipeline_modules(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "textloom"), tmp_path / "textloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'predict_sentence' in q and not [x for x in q if x.startswith('op') or x == 'pipeline']; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_ordered_predictions_compute_segments_once(spark, sf):
    """A range sort reads its input twice; what it reads is kept, so the plan that sorts holds no segmentation."""
    assert "posexplode" not in catalogue.queries()["ordered_predictions"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def odd_documents(spark, tmp_path):
    """Empty texts, as larger tables hold them, beside blank ones, signs of several code units and texts that are cut."""
    rows = enumerate(["", " \n", "a😀é", "e\u0301x", "Some words.\n\nMore of them.", "x" * 600, "", "w " * 70])
    spark.createDataFrame(list(rows), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return str(tmp_path), con


@pytest.mark.parametrize("name", ["attention_mask", "encode_pad", "encode_truncate", "scorer_failures"])
def test_queries_of_odd_documents(spark, odd_documents, name):
    folder, con = odd_documents
    compare(catalogue.queries()[name](spark, folder), con, catalogue.oracle_sql()[name])
