"""Keyed state and stream joins against loops: order, repeats, timers, restarts."""

from __future__ import annotations

import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from textloom.functions import table_functions
from textloom.functions.html import read_page
from textloom.operators.requests import BAD_URL, NO_INPUT, NO_PAGE, NO_TEXT_ON_PAGE
from textloom.streaming.assembly import Assemble, assemble
from textloom.streaming.pages import resolve_stream
from textloom.streaming.run import arrivals, finish, keyed_state

DAY = datetime(2024, 1, 1)
SEGMENTS = "request_id long, mode string, n_segments int, segment_index int, text string, label string, label_id int, p_left double, p_right double, p_center double, error string, at timestamp"


def segment(request: int, n: int, i: int, at: int = 0, error: str | None = None, text: str | None = None) -> tuple:
    return (request, "sentence", n, i, text or f"text {request}.{i}", "LEFT", 0, 0.5, 0.25, 0.25, error, DAY + timedelta(seconds=at))


def run_parts(spark, folder, parts: list[list[tuple]], wait: int = 600):
    frames = [spark.createDataFrame(p, SEGMENTS) for p in parts]
    stream = arrivals(frames, str(folder), "in").withWatermark("at", "1 minute")
    return finish(assemble(stream, wait, "at"), str(folder))


END = [segment(-1, 1, 0, 10**6)]


def test_assembly(spark, tmp_path):
    rng = random.Random(1)
    rows = [segment(r, n, i, r % 20) for r in range(30) for n in [r % 5 + 1] for i in range(n)]
    rows += rng.sample(rows, 20)  # arrive twice
    rng.shuffle(rows)
    odd = [segment(100, 3, 0), segment(100, 3, 2), segment(101, 2, 0, error="no"), segment(101, 2, 1), segment(102, 1, 7), segment(103, 2, 1, error="late"), segment(103, 2, 0, error="early")]
    got = {r.request_id: r for r in run_parts(spark, tmp_path, [rows[:30], rows[30:] + odd, END]).collect()}
    assert len(got) == 30 + 4 + 1
    for r in range(30):
        assert got[r].status == 200 and got[r].error is None and [(x.segment_index, x.text) for x in got[r].results] == [(i, f"text {r}.{i}") for i in range(r % 5 + 1)]
    assert (got[100].status, got[100].error, got[100].results) == (400, "2 of 3 segments arrived", None)
    assert (got[101].status, got[101].error, got[101].results) == (400, "no", None)
    assert (got[102].status, got[102].error) == (400, "0 of 1 segments arrived")
    assert got[103].error == "early"


def test_assembly_after_a_restart(spark, tmp_path):
    """The second run goes on from the state of the first; a closed request stays closed, and the first of two segments counts."""
    first = run_parts(spark, tmp_path, [[segment(1, 3, 0), segment(2, 2, 1), segment(3, 1, 0)]])
    assert [r.request_id for r in first.collect()] == [3]
    more = [segment(1, 3, 2), segment(1, 3, 0, text="again"), segment(3, 1, 0), segment(1, 3, 1)]
    spark.createDataFrame(more, SEGMENTS).coalesce(1).write.parquet(f"{tmp_path}/in/0001")
    spark.createDataFrame(END, SEGMENTS).coalesce(1).write.parquet(f"{tmp_path}/in/0002")
    stream = spark.readStream.schema(SEGMENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withWatermark("at", "1 minute")
    got = {r.request_id: r for r in finish(assemble(stream, 600, "at"), str(tmp_path)).collect()}
    assert sorted(got) == [-1, 1, 2, 3]
    assert [x.text for x in got[1].results] == ["text 1.0", "text 1.1", "text 1.2"] and got[2].error == "1 of 2 segments arrived"


def test_assembly_by_the_clock(spark, tmp_path):
    """Without event time the stream needs no watermark; complete requests don't wait for timers. Such a query runs until it is stopped."""
    stream = arrivals([spark.createDataFrame(p, SEGMENTS) for p in ([segment(1, 2, 1)], [segment(1, 2, 0), segment(2, 2, 0)])], str(tmp_path), "in")
    with keyed_state(spark):
        query = assemble(stream, 3600).writeStream.format("memory").queryName("by_the_clock").outputMode("append").start()
    try:
        ends = time.monotonic() + 60
        while time.monotonic() < ends and not spark.table("by_the_clock").count():
            time.sleep(0.5)
    finally:
        query.stop()
    assert [(r.request_id, r.status) for r in spark.table("by_the_clock").collect()] == [(1, 200)]


class _State:
    """A key's state and timers without a stream, with a count of the calls that would be round trips."""

    def __init__(self) -> None:
        self.value, self.timers, self.calls, self.clock = None, set(), 0, 0

    def getValueState(self, name: str, schema: str) -> _State:
        return self

    def get(self) -> tuple | None:
        self.calls += 1
        return self.value

    def update(self, value: tuple) -> None:
        self.calls, self.value = self.calls + 1, value

    def clear(self) -> None:
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at: int) -> None:
        self.calls += 1
        self.timers.add(at)

    def getCurrentWatermarkInMs(self) -> int:
        return self.clock

    def getExpiryTimeInMs(self) -> int:
        return self.fired


def test_requests_that_share_a_key():
    """A batch of many requests takes a few calls on the state, and each request still ends at its own time; calls grew with the requests."""
    state, made = _State(), Assemble(1000, True)
    made.init(state)
    row = lambda r, n, i, at: Row(request_id=r, mode="article", n_segments=n, segment_index=i, text=f"t{r}", label="LEFT", label_id=0, p_left=0.1, p_right=0.7, p_center=0.2, error=None, at_ms=at)
    got = list(made.handleInputRows((0,), iter([row(r, 2, 0, r * 10) for r in range(300)] + [row(r, 2, 1, r * 10) for r in range(0, 300, 3)]), state))
    assert sorted(r.request_id for r in got) == list(range(0, 300, 3)) and state.calls <= 3 and state.timers == {1000}
    assert list(made.handleInputRows((0,), iter([row(0, 2, 1, 0), row(1, 2, 0, 0)]), state)) == []  # closed; come already
    (late,) = made.handleInputRows((0,), iter([row(1, 2, 1, 5)]), state)
    assert late.status == 200 and [x[:2] + x[4:] for x in late.results] == [(0, "t1", 0.1, 0.7, 0.2), (1, "t1", 0.1, 0.7, 0.2)]
    ended = {}
    while state.timers and min(state.timers) < 2005:
        state.fired = state.clock = min(state.timers)
        state.timers.remove(state.fired)
        ended |= {r.request_id: (state.fired, r.error) for r in made.handleExpiredTimer((0,), state, state)}
    assert ended == {r: (1000 + r * 10, "1 of 2 segments arrived") for r in range(2, 101) if r % 3}
    state.fired, state.clock = min(state.timers), 10**6
    assert len(list(made.handleExpiredTimer((0,), state, state))) == sum(r % 3 > 0 for r in range(101, 300)) and state.value is None


WORDS = "one two three four five six seven eight nine"
PAGE = f"<html><p>{WORDS}</p></html>"


def test_requests_wait_for_pages(spark, tmp_path):
    at = lambda s: DAY + timedelta(seconds=s)
    requests = [
        (1, "http://a/", "article", at(0)), (2, "http://b/", None, at(10)), (3, "http://late/", "sentence", at(20)), (4, "http://never/", "sentence", at(30)), (5, "plain  text", "article", at(40)),
        (6, "  ", "article", at(41)), (7, "http://[bad", "article", at(42)), (8, "", "article", at(43)), (9, "x", "word", at(44)), (10, "http://empty/", "article", at(45)), (1, "http://b/", "article", at(46)), (11, " http://a/ ", "article", at(900)),
    ]
    pages = [("http://a/", PAGE, at(5)), ("http://a/", "<p>other</p>", at(6)), ("http://b/", PAGE.replace("one", "uno"), at(300)), ("http://empty/", "<p>short</p>", at(50)), ("http://late/", PAGE, at(20 + 601)), ("http://unasked/", PAGE, at(7))]
    schemas = "request_id long, input string, mode string, asked_at timestamp", "url string, html string, fetched_at timestamp"
    far = at(10**6)
    r = arrivals([spark.createDataFrame(x, schemas[0]) for x in (requests[:6], requests[6:], [(-1, "end", "article", far)])], str(tmp_path), "r")
    p = arrivals([spark.createDataFrame(x, schemas[1]) for x in (pages[:2], pages[2:], [("http://end/", "", far)])], str(tmp_path), "p")
    got = {x.request_id: (x.source_type, x.resolved_text, x.status, x.error) for x in finish(resolve_stream(r, p, "10 minutes", "1 hour", "30 minutes"), str(tmp_path)).collect() if x.request_id > 0}
    assert got == {
        1: ("url", WORDS, 200, None), 2: ("url", WORDS.replace("one", "uno"), 200, None), 3: ("url", None, 400, NO_PAGE), 4: ("url", None, 400, NO_PAGE), 5: ("text", "plain text", 200, None),
        6: ("text", "", 400, NO_INPUT), 7: ("url", None, 400, BAD_URL), 8: ("text", None, 422, "input must have at least 1 character"), 9: ("text", None, 422, "mode must be article, sentence or paragraph"),
        10: ("url", None, 400, NO_TEXT_ON_PAGE), 11: ("url", WORDS, 200, None),
    }


def test_table_functions(spark):
    table_functions.register(spark)
    pages = [(1, "u", "<p>a</p><p>b</p>"), (2, "u", "<p>c</p>"), (3, "v", None), (4, None, "<p>d</p>"), (5, "w", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = Counter(map(tuple, spark.sql("SELECT p.page_id, b.* FROM {df} p, LATERAL page_blocks(p.html) b", df=df).collect()))
    assert got == Counter((i, k, t) for i, _, h in pages for k, t in enumerate(read_page(h)[0] if h else []))
    got = Counter(map(tuple, spark.sql("SELECT * FROM blocks_by_url(TABLE({df}))", df=df.withColumn("extra", F.lit(1))).collect()))
    assert got == Counter([("u", 1, 0, "a"), ("u", 1, 1, "b"), (None, 4, 0, "d")])
    with pytest.raises(Exception, match="missing"):
        spark.sql("SELECT * FROM blocks_by_url(TABLE({df}))", df=df.drop("html"))


def test_arrivals_of_many_files_and_a_stream_without_a_deadline(spark, tmp_path):
    """Large parts are written and read by many tasks, and the stream ends when its rows do; one file and 300 seconds were the bounds."""
    import inspect

    parts = [spark.range(i * 1000, i * 1000 + 1000, 1, 4).select("id") for i in range(3)]
    stream = arrivals(parts, str(tmp_path), "in", 4)
    assert [len(list((tmp_path / "in" / f"{i:04}").glob("*.parquet"))) for i in range(3)] == [4, 4, 4]
    assert finish(stream, str(tmp_path)).agg({"id": "sum"}).first()[0] == sum(range(3000))
    assert inspect.signature(finish).parameters["seconds"].default is None
