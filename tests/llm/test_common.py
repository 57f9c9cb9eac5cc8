from __future__ import annotations

import subprocess
import sys
import time
from pathlib import Path
from types import SimpleNamespace

import pytest

from textloom.llm import common


def session(master: str, named: str | None = None, older: str | None = None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: named), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: older))


def test_the_shared_folder_is_the_one_that_the_cluster_names():
    assert common.checkpoint_dir(session("yarn", "hdfs://x/y")) == "hdfs://x/y"
    assert common.checkpoint_dir(session("yarn", None, "hdfs://z")) == "hdfs://z"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.checkpoint_dir(session("spark://host:7077"))
    assert common.checkpoint_dir(session("local[2]")).startswith("file:")
    assert common.checkpoint_dir(session("local")).startswith("file:")


def test_saved_tables_go_and_kept_ones_stay(spark):
    df = spark.range(5)
    with common.Scratch(spark) as scratch:
        saved, kept = scratch.save(df, "a"), scratch.keep(df, "b")
        assert saved.count() == kept.count() == 5
    assert kept.count() == 5
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(f"{scratch.base}/0-a").count()
    common.drop_kept()
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(f"{scratch.base}/1-b").count()


@pytest.mark.parametrize("end", ["spark.stop()", "pass", "raise SystemExit(3)"])
def test_nothing_is_left_after_the_process(tmp_path, end):
    """Kept tables go at exit, also when the session was stopped first; failed stages of the pipeline leave nothing."""
    root = Path(__file__).parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
import corpus_pipeline
from textloom.llm import pii
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", "file://{tmp_path}").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(i, "mail a@b.com now") for i in range(4)], "doc_id long, text string")
assert pii.personal_data(docs).count() == 4
def bad(spark, docs, folder):
    raise ValueError("a stage fails")
corpus_pipeline.STAGES[:] = [("first", lambda s, d, f: d.limit(5)), ("second", bad), ("third", bad)]
try:
    corpus_pipeline.run(spark, "/root/testdata/sf0.001")
except ValueError:
    pass
{end}
"""
    subprocess.run([sys.executable, "-c", code], cwd=root, timeout=200, check=end[:5] != "raise", capture_output=True)
    deadline = time.time() + 20  # the JVM ends a little later
    while time.time() < deadline and any(p.is_file() for p in tmp_path.rglob("*")):
        time.sleep(0.5)
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
