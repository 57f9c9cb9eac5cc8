"""The page source: ranges of lines, retries, archives, and streams that fetch each line once."""

from __future__ import annotations

import random
from collections import Counter
from urllib.error import HTTPError, URLError

import pyarrow.fs as fs
import pytest

from textloom.sources import page_source as P


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 1000])
@pytest.mark.parametrize("end", ["", "\n"])
def test_ranges_hold_each_line_once(tmp_path, size, end):
    rng = random.Random(size)
    lines = ["x" * rng.choice([0, 1, 2, 5, 300, 600]) + f"é{i}" for i in range(60)] + [""]
    lines.insert(10, "")
    path = tmp_path / "urls"
    path.write_text("\n".join(lines) + end, encoding="utf-8")
    system = fs.LocalFileSystem()
    got = [x for part in P.ranges(str(path), 0, path.stat().st_size, size) for x in P.lines_of(system, part)]
    assert got == [x for x in lines if x]


def test_whole_lines(tmp_path):
    path = tmp_path / "urls"
    for text, want in (("", 0), ("abc", 0), ("a\nb", 2), ("a\nb\n", 4), ("a\n" + "b" * 9000, 2), ("a" * 9000 + "\n" + "b" * 9000, 9001)):
        path.write_text(text)
        assert P.whole_lines(fs.LocalFileSystem(), str(path), len(text)) == want


def test_retries(monkeypatch):
    monkeypatch.setattr(P, "WAIT_SECONDS", 0)
    calls: Counter = Counter()

    def get(url, timeout, hosts):
        calls[url] += 1
        if url == "flaky" and calls[url] < 3:
            raise HTTPError(url, 503, "busy", {}, None)
        if url == "gone":
            raise HTTPError(url, 404, "gone", {}, None)
        if url == "down":
            raise URLError("no route")
        if url == "slow":
            raise TimeoutError
        if url == "bad":
            raise ValueError("host not allowed: bad")
        return f"page of {url}"

    page = P.from_web(frozenset({"h"}), 1, 3, get)
    assert page("fine") == ("page of fine", 200, None) and page("flaky") == ("page of flaky", 200, None)
    assert page("gone") == (None, 404, "HTTP 404") and page("down") == (None, None, "no route")
    assert page("slow")[0] is None and page("bad") == (None, None, "host not allowed: bad")
    assert calls == {"fine": 1, "flaky": 3, "gone": 1, "down": 3, "slow": 3, "bad": 1}


@pytest.fixture
def archive(spark, tmp_path):
    pages = [(f"http://e/{i}", f"<p>{i}</p>") for i in range(50)] + [("http://e/3", "<p>2</p>"), ("http://null/", None)]
    folder = f"file://{tmp_path}/archive"
    P.write_archive(spark.createDataFrame(pages, "url string, html string"), folder, 5)
    return folder


def test_batch_from_an_archive(spark, tmp_path, archive):
    listed = [f"http://e/{i}" for i in range(0, 60, 2)] + ["http://e/3", "http://e/3", "http://null/"]
    folder = f"file://{tmp_path}/list"
    spark.createDataFrame([(u,) for u in listed], "url string").repartition(3).write.text(folder)
    P.register(spark)
    df = spark.read.format(P.NAME).options(list=folder, archive=archive, bytes="64").load()
    assert df.rdd.getNumPartitions() > 5
    want = Counter((u, f"<p>{2 if u.endswith('/3') else u[9:]}</p>", 200, None) if u != "http://null/" and int(u[9:]) < 50 else (u, None, 404, "HTTP 404") for u in listed)
    assert Counter(map(tuple, df.collect())) == want
    with pytest.raises(Exception, match="name the hosts"):
        spark.read.format(P.NAME).options(list=folder).load().collect()


def test_stream_fetches_each_line_once(spark, tmp_path, archive):
    """A list that grows, with a line half written; a second run fetches what is new only, also after the archive is changed."""
    path = tmp_path / "urls.txt"
    out = f"file://{tmp_path}/saved"
    path.write_text("http://e/1\nhttp://e/2\nhttp://e/3")
    first = P.saved_pages(spark, out, list=str(path), archive=archive)
    assert sorted(r.url for r in first.collect()) == ["http://e/1", "http://e/2"]
    path.write_text("http://e/1\nhttp://e/2\nhttp://e/33\nhttp://e/99\n")
    P.write_archive(spark.createDataFrame([(f"http://e/{i}", "<p>new</p>") for i in range(50)], "url string, html string"), f"{archive}2", 3)
    second = P.saved_pages(spark, out, list=str(path), archive=f"{archive}2")
    got = {r.url: (r.html, r.status) for r in second.collect()}
    assert got == {"http://e/1": ("<p>1</p>", 200), "http://e/2": ("<p>2</p>", 200), "http://e/33": ("<p>new</p>", 200), "http://e/99": (None, 404)}
    assert second.count() == 4
