from __future__ import annotations

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import html, urls
from textloom.functions.html import read_page
from textloom.functions import text
from textloom.operators import predict, requests, views
from textloom.operators.classify import ModelFolder, StandIn, scored, scored_distinct
from textloom.sources import fetch, tables
from textloom.sources.settings import Settings

W = "w1 w2 w3 w4 w5 w6 w7 w8"
URLS = {
    "https://e.com": (True, False), "HTTPS://E.com": (True, False), " https://e.com ": (True, False), "https://e.com is down today": (True, False),
    "http:///x": (False, False), "https://?q=1": (False, False), "https:e.com": (False, False), "ftp://e.com": (False, False), "e.com": (False, False),
    "http://[bad": (True, True), "https://e.com\nBody": (True, False), "h\nttps://e.com": (True, False),
}
PAGES = {
    "H1": (f"<article><p>{W}</p></article>", [W]),
    "H2": (f"<article><p>A {W}</p><p>B {W}</p></article>", [f"A {W} B {W}", f"A {W}", f"B {W}"]),
    "H3": (f"<p>{W}<p>z {W}", [f"{W} z {W}", f"z {W}"]),
    "H4": (f"<p>w1 w2 w3</p><div>{W}</div>", [W]),
    "H5": (f"<nav><p>{W}</p></nav><p>x{W}</p>", [f"x{W}"]),
    "H6": ("<p>w1<b>w2</b>w3 w4 w5 w6 w7</p>", None),
    "H7": (f"<title>{W}</title><div>a\n{W} {W}</div>", [W, f"{W} {W}"]),
    "H8": ("<p>short</p>", None),
    "H9": (f"<p>{W}<!-- c --> tail</p>", [f"{W} tail"]),
    "H10": (f"<p>{W}&amp;&nbsp;x</p>", [f"{W}&\xa0x"]),
    "unclosed": (f"<p>{W}</p><aside><p>gone {W}", [W]),
    "script": (f"<p>{W}</p><script>var a = '<p>{W} {W}</p>';</script>", [W]),
    "template": (f"<p>{W}<template><b>x</b> y</template> z</p>", [f"{W} z"]),
    "null": (None, None),
    "empty": ("", None),
}


def test_url_cases(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    for r in df.select("u", urls.looks_like_url(F.col("u")).alias("a"), urls.malformed_authority(F.col("u")).alias("b")).collect():
        assert (r.a, r.b) == URLS[r.u], r.u


def test_page_cases(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in PAGES.items()], "url string, html string")
    got = {r.url: r.page_text for r in requests.page_text(df).collect()}
    assert got == {k: "\n\n".join(v[1]) if v[1] else None for k, v in PAGES.items()}


def test_deeply_nested_page():
    blocks, lines = read_page("<div>" * 5000 + f"<p>{W}")
    assert blocks == [W] and lines == [W]


#: Unclosed, so that each holds all after it: 2,400 characters give 401,000 in blocks.
NESTED = "<p>word" * 400


def test_parts_of_pages_leave_in_small_batches():
    made = list(html._page_parts.func(iter([pa.array([NESTED] * 20 + [None, ""])])))
    assert len(made) > 5 and max(x.nbytes for x in made) < 4 * html.STEP_CHARS
    assert [x.as_py() for some in made for x in some] == [dict(zip(("blocks", "lines"), read_page(NESTED), strict=True))] * 20 + [{"blocks": [], "lines": []}] * 2


@pytest.mark.parametrize("of", ["blocks", "lines"])
def test_texts_of_pages_as_rows(spark, of):
    given = [(1, NESTED), (2, None), (3, ""), (None, "<p>a</p><p></p>"), (5, "a\n b<p>c")]
    got = html.page_texts(spark.createDataFrame(given, "page_id long, html string"), of, "place")
    assert got.dtypes == [("page_id", "bigint"), ("place", "int"), ("text", "string")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((k, i, t) for k, h in given for i, t in enumerate(read_page(h or "")[of == "lines"])), key=str)


def test_requests_statuses(spark):
    cases = [
        (0, "", "article", 422, None), (1, " \n ", "article", 400, requests.NO_INPUT), (2, "text", None, 200, None), (3, "text", "word", 422, None),
        (4, "https://no.example/x", "sentence", 400, requests.NO_PAGE), (5, "https://bad.example/", "sentence", 400, requests.NO_TEXT_ON_PAGE),
        (6, " https://good.example/ ", "paragraph", 200, None), (7, "http://[x", "article", 400, requests.BAD_URL), (8, None, "article", 422, None),
        (9, "A b. C d.", "sentence", 200, None),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "request_id long, input string, mode string")
    pages = spark.createDataFrame([("https://good.example/", f"<p>{W}</p><p>X {W}</p>"), ("https://bad.example/", "<p>x</p>")], "url string, html string")
    got = {r.request_id: r for r in predict.responses(df, pages).collect()}
    for i, _, mode, status, error in cases:
        assert got[i].status == status, i
        assert (got[i].results is None) == (status != 200)
        if error:
            assert got[i].error == error
    assert got[2].mode == "article" and got[2].source_type == "text"
    assert got[6].source_type == "url" and [x.text for x in got[6].results] == [W, f"X {W}"]
    assert [x.segment_index for x in got[9].results] == [0, 1]
    body = {r.request_id: json.loads(r.body) for r in predict.response_json(predict.responses(df, pages)).collect()}
    assert set(body) == {2, 6, 9} and set(body[9]["results"][0]) == {"segment_index", "text", "label", "label_id", "probabilities"}


class Rows(StandIn):
    """The stand-in without its column form: responses are then gathered from rows."""

    column = property()


def test_both_ways_to_responses(spark):
    df = spark.createDataFrame([(1, "A b. C d. E f."), (2, "One. Two.")], "request_id long, input string").withColumn("mode", F.lit("sentence"))
    key = lambda rows: sorted((r.request_id, [x.asDict(True) for x in r.results]) for r in rows)
    assert key(predict.responses(df).collect()) == key(predict.responses(df, scorer=Rows()).collect())


def test_fail_fast(spark):
    df = spark.createDataFrame([(0, "")], "request_id long, input string")
    with pytest.raises(Exception, match="at least 1 character"):
        predict.responses(df, fail_fast=True).collect()


def test_body_limit(spark):
    df = spark.createDataFrame([(0, "abcdef")], "request_id long, input string")
    assert requests.validate(df, max_body=5).first().status == 413
    assert predict.prepared(df, max_body=5).first().status == 413 and predict.prepared(df).first().status == 200


def test_probabilities(spark, sf):
    p = predict.predictions(tables.requests_of(tables.read_table(spark, sf, "documents"), "doc_id", "text", "sentence"))
    r = p.agg(F.max(F.abs(F.col("p_left") + F.col("p_right") + F.col("p_center") - 1)), F.count(F.lit(1)), F.countDistinct("label")).first()
    assert r[0] <= 2e-6 and r[1] > 1000 and r[2] == 3
    once = scored_distinct(p.select("request_id", "segment_index", "text"))
    assert once.exceptAll(scored(p.select("request_id", "segment_index", "text"))).count() == 0


def test_missing_model_folder(tmp_path):
    with pytest.raises(FileNotFoundError, match="tokenizer.json"):
        ModelFolder(str(tmp_path))


def test_settings():
    s = Settings.read({"TEXTLOOM_PORT": "9", "TEXTLOOM_ALLOWED_ORIGINS": " a, ,b"})
    assert (s.port, s.allowed_origins, s.host, s.request_timeout) == (9, ("a", "b"), "127.0.0.1", 10)
    assert Settings.read({"TEXTLOOM_ALLOWED_ORIGINS": "  "}).allowed_origins == ()


def test_fetch_is_off_without_hosts(spark):
    df = spark.createDataFrame([("https://a.example/x",), ("https://b.example/y",)], "url string")
    with pytest.raises(ValueError, match="hosts"):
        fetch.fetch_pages(df, frozenset())
    got = {r.url: (r.html, r.error) for r in fetch.fetch_pages(df, frozenset({"a.example"}), get=lambda u, t, h: f"<p>{u}").collect()}
    assert got == {"https://a.example/x": ("<p>https://a.example/x", None), "https://b.example/y": (None, "host not allowed: b.example")}


def test_fetched_pages_in_the_whole_flow(spark):
    def get(url, timeout, hosts):
        if "bad" in url:
            raise OSError("HTTP Error 404: Not Found")
        return "<p>one two three four five six seven eight nine</p>"

    given = [(1, "https://a.example/x"), (2, "https://a.example/bad"), (3, "https://b.example/y"), (4, "plain words"), (5, "https://[x")]
    valid = requests.validate(spark.createDataFrame(given, "request_id long, input string"))
    got = {r.request_id: (r.status, r.error) for r in requests.resolve_online(valid, frozenset({"a.example"}), get=get).collect()}
    assert got[1] == got[4] == (200, None) and got[2] == (400, "HTTP Error 404: Not Found") and got[3] == (400, "host not allowed: b.example")
    assert got[5][0] == 400


def test_fetching_over_http():
    """Redirects off the list, other schemes and long answers are refused."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/away":
                self.send_response(302)
                self.send_header("Location", f"http://localhost:{server.server_port}/x")
            else:
                self.send_response(200)
            self.end_headers()
            self.wfile.write(b"<p>hello</p>")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, hosts = f"http://127.0.0.1:{server.server_port}", frozenset({"127.0.0.1"})
    try:
        assert fetch.fetch(f"{base}/x", 5, hosts) == "<p>hello</p>"
        with pytest.raises(ValueError, match="host not allowed: localhost"):
            fetch.fetch(f"{base}/away", 5, hosts)
        with pytest.raises(ValueError, match="more than 3 bytes"):
            fetch.fetch(f"{base}/x", 5, hosts, max_bytes=3)
        with pytest.raises(ValueError, match="scheme"):
            fetch.fetch("file:///etc/hosts", 5, hosts)
    finally:
        server.shutdown()


def test_views(spark):
    df = spark.createDataFrame([("LEFT",), (None,), ("OTHER",)], "label string")
    assert sorted(r.style_bar for r in views.styled(df).collect()) == ["bg-blue-400", "bg-slate-300", "bg-slate-300"]
    r = spark.range(1).select(
        views.headline(F.lit("article"), F.lit(1)).alias("a"), views.headline(F.lit("sentence"), F.lit(1)).alias("b"),
        views.run_summary(F.lit("article"), F.lit(1)).alias("c"), views.run_summary(F.lit("article"), F.lit(None).cast("int")).alias("d"), views.mode_title(F.lit("sentence")).alias("e"),
    ).first()
    assert tuple(r) == ("Whole article prediction", "1 segment predictions", "Latest run returned 1 prediction in article mode.", views.NO_RUN, "Sentence analysis")


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_text_and_segments_are_computed_once(spark, sf):
    """Cleaning (its blank-line step) and splitting at paragraphs stand once in the plan of nested responses."""
    docs = tables.requests_of(tables.read_table(spark, sf, "documents"), "doc_id", "text", "paragraph")
    plan = optimized(predict.response_json(predict.responses(docs)))
    assert plan.count(r"\n{3,}") == 1 and plan.count(r"\n\s*\n") + plan.count(r"\n{2,}") <= 2
    pages = tables.read_table(spark, sf, "pages")
    plan = optimized(requests.page_text(pages))
    assert plan.count("_page_parts(") == 1 and plan.count("RLIKE") == 2 and plan.count(r"\n{3,}") == 1


def test_words(spark):
    df = spark.createDataFrame([("",), (" \u3000 ",), ("a",), ("\u00a0a b\n\u2003c\t",), ("\U0001f600 x",), (None,)], "t string")
    got = [tuple(r) for r in df.select(text.words(F.col("t")), text.word_count(F.col("t")), text.enough_words(F.col("t"), 2), text.enough_words(F.col("t"), 0)).collect()]
    assert got == [([], 0, False, True), ([], 0, False, True), (["a"], 1, False, True), (["a", "b", "c"], 3, True, True), (["\U0001f600", "x"], 2, True, True), (None, None, None, False)]
