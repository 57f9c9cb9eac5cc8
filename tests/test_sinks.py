"""Requests in, predictions and responses out, and what is read once in a process."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import classify, predict, requests
from textloom.sources import settings, tables

GIVEN = [(2, "One two. Three four.", "sentence"), (1, "A b.\n\nC d.", "paragraph"), (3, "", "article"), (4, "Plain words", None)]


@pytest.mark.parametrize("form", ["json", "parquet"])
def test_requests_to_responses(spark, tmp_path, form):
    spark.createDataFrame(GIVEN, tables.REQUESTS).write.format(form).save(str(tmp_path / "in"))
    read = tables.read_requests(spark, str(tmp_path / "in"), form)
    assert sorted(map(tuple, read.collect())) == sorted(GIVEN) and read.dtypes == [("request_id", "bigint"), ("input", "string"), ("mode", "string")]
    tables.write_predictions(predict.predictions(read), str(tmp_path / "rows"), in_order=True)
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert sorted((r.request_id, r.segment_index, r.text) for r in rows.collect()) == [(1, 0, "A b."), (1, 1, "C d."), (2, 0, "One two."), (2, 1, "Three four."), (4, 0, "Plain words")]
    files = sorted(p for p in (tmp_path / "rows").glob("part-*"))
    in_files = [(r.request_id, r.segment_index) for p in files for r in spark.read.parquet(str(p)).collect()]
    assert in_files == sorted(in_files)
    tables.write_responses(predict.responses(read), str(tmp_path / "out"))
    out = {x["request_id"]: x for p in (tmp_path / "out").glob("part-*") for x in map(json.loads, p.read_text().splitlines())}
    assert out[3]["status"] == 422 and "results" not in out[3] and [s["text"] for s in out[1]["results"]] == ["A b.", "C d."]
    assert set(out[2]["results"][0]["probabilities"]) == {"LEFT", "RIGHT", "CENTER"}


def test_requests_without_segments_fail(spark):
    """Cleaning leaves no text without segments, so this is fed from behind it."""
    row = [(1, "text", " ", "sentence", 200, None), (2, "text", "A b.", "sentence", 200, None), (3, "text", None, "sentence", 422, "bad")]
    df = spark.createDataFrame(row, "request_id long, source_type string, resolved_text string, mode string, status int, error string")
    got = {r.request_id: (r.status, r.error) for r in requests.with_segments(df).collect()}
    assert got == {1: (400, requests.NO_SEGMENTS), 2: (200, None), 3: (422, "bad")}


def test_read_once_in_a_process(monkeypatch, tmp_path):
    monkeypatch.setattr(settings, "_settings", None)
    assert settings.settings() is settings.settings()
    calls = []
    monkeypatch.setattr(classify, "_workers", {})
    monkeypatch.setattr("textloom.operators.roberta.Roberta", lambda folder: calls.append(folder) or type("M", (), {"in_parts": staticmethod(len)}))
    from tokenizers import Tokenizer, models

    Tokenizer(models.WordLevel({"<unk>": 0}, unk_token="<unk>")).save(str(tmp_path / "tokenizer.json"))
    assert classify._loaded(str(tmp_path)) is classify._loaded(str(tmp_path)) and calls == [str(tmp_path)]


def test_failures_are_logged(spark, caplog):
    with caplog.at_level("WARNING", logger="textloom"):
        done = predict.responses(spark.createDataFrame(GIVEN, tables.REQUESTS))
        assert predict.log_failures(done) == 1 == done.filter(F.col("status") != 200).count()
    assert "request 3 failed with status 422" in caplog.text
