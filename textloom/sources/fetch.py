"""Pages fetched from the web: off unless hosts are named.

The offline way is a table of saved pages. This one turns URLs into such a table, on executors, over
http or https and for hosts on a list only. Every redirect is held to the same list, so a request
reaches no other host, and an answer is read up to a bound. A name on the list that resolves to a
private address is trusted: name public hosts only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urlsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener

import pandas as pd
from pyspark.sql import DataFrame

AGENT = "Mozilla/5.0 (compatible; textloom)"
#: Most bytes of an answer; a longer one is an error.
MAX_BYTES = 20 << 20


def check_url(url: str, hosts: frozenset[str]) -> None:
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https"):
        raise ValueError(f"scheme not allowed: {parts.scheme}")
    if parts.hostname not in hosts:
        raise ValueError(f"host not allowed: {parts.hostname}")


class _Redirects(HTTPRedirectHandler):
    def __init__(self, hosts: frozenset[str]):
        self.hosts = hosts

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        check_url(newurl, self.hosts)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def fetch(url: str, timeout: int, hosts: frozenset[str], max_bytes: int = MAX_BYTES) -> str:
    check_url(url, hosts)
    with build_opener(_Redirects(hosts)).open(Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as answer:
        body = answer.read(max_bytes + 1)
        if len(body) > max_bytes:
            raise ValueError(f"the page has more than {max_bytes} bytes")
        try:
            return body.decode(answer.headers.get_content_charset() or "utf-8", errors="replace")
        except LookupError:  # a charset that doesn't exist
            return body.decode("utf-8", errors="replace")


def fetch_pages(urls: DataFrame, hosts: frozenset[str], timeout: int = 10, get: Callable[[str, int, frozenset[str]], str] = fetch) -> DataFrame:
    """url, html and error of each distinct URL; where fetching fails html is null and error says why. Refused without a list of hosts."""
    if not hosts:
        raise ValueError("name the hosts that may be fetched")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(url: str) -> tuple[str | None, str | None]:
            try:
                check_url(url, hosts)
                return get(url, timeout, hosts), None
            except Exception as e:  # noqa: BLE001 - a page fails its own requests only
                return None, str(e) or type(e).__name__

        for batch in batches:
            found = [one(u) for u in batch["url"]]
            yield pd.DataFrame({"url": batch["url"], "html": [f[0] for f in found], "error": [f[1] for f in found]})

    return urls.select("url").distinct().mapInPandas(run, "url string, html string, error string")
