"""Pages of listed URLs as a data source: ``spark.read.format("textloom_pages")``, or a stream that follows a growing list.

The list is a text file, or a folder of them, with a URL on each line; files may grow and join, nothing else. A partition is a range of
bytes of a file, which its task reads itself, so the driver sees sizes of files only. A stream's offset is the number of whole lines' bytes read of
each file. Pages come from the web, or from an archive of pages saved before.

Fetching isn't repeatable: a page may change between two attempts. :func:`saved_pages` therefore writes what a stream fetches to a
table, once for each line of the list; whatever reads pages later reads the table, so a lost executor gives the same pages.

Options: ``list``; ``hosts``, comma-separated, or ``archive``, a folder that :func:`write_archive` made; ``bytes`` of the list in a
partition (16384); ``timeout`` in seconds (10); ``attempts`` (3). A page that can't be had has its status and why in ``error``.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.error import HTTPError, URLError

import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .fetch import fetch

NAME = "textloom_pages"
SCHEMA = "url string, html string, status int, error string"
PART_BYTES, ATTEMPTS, WAIT_SECONDS = 16_384, 3, 0.5
NOT_FOUND, OK = 404, 200


def _files(uri: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The list's files by name, without those that writers hide."""
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.Directory:
        found = [x for x in system.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and x.base_name[:1] not in "._"]
        return system, sorted(found, key=lambda x: x.path)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(uri)
    return system, [info]


@dataclass
class Lines(InputPartition):
    """The lines of a file that start in a range of bytes."""

    path: str
    start: int
    stop: int


def ranges(path: str, start: int, stop: int, size: int) -> list[Lines]:
    return [Lines(path, a, min(a + size, stop)) for a in range(start, stop, size)]


def lines_of(system: fs.FileSystem, part: Lines) -> Iterator[str]:
    """Stripped lines, without empty ones; the last one is read to its end, beyond the range if need be."""
    with system.open_input_file(part.path) as f:
        f.seek(max(part.start - 1, 0))
        at = part.start
        if part.start and f.read(1) != b"\n":
            at += len(_line(f))
        while at < part.stop and (line := _line(f)):
            at += len(line)
            if text := line.decode("utf-8", errors="replace").strip():
                yield text


def _line(f) -> bytes:
    """Up to and with the next line end."""
    out = b""
    while chunk := f.read(256):
        end = chunk.find(b"\n")
        if end >= 0:
            f.seek(f.tell() - len(chunk) + end + 1)
            return out + chunk[: end + 1]
        out += chunk
    return out


def whole_lines(system: fs.FileSystem, path: str, size: int) -> int:
    """Bytes up to the last line end, as a writer may be in the middle of a line."""
    with system.open_input_file(path) as f:
        stop = size
        while stop > 0:
            start = max(stop - 4096, 0)
            f.seek(start)
            end = f.read(stop - start).rfind(b"\n")
            if end >= 0:
                return start + end + 1
            stop = start
    return 0


def from_web(hosts: frozenset[str], timeout: int, attempts: int, get: Callable = fetch) -> Callable[[str], tuple]:
    """html, status and error of a URL. Server errors and lost connections are tried again; refusals and what a list of hosts forbids aren't."""

    def page(url: str) -> tuple[str | None, int | None, str | None]:
        for k in range(attempts):
            last = k == attempts - 1
            try:
                return get(url, timeout, hosts), OK, None
            except HTTPError as e:
                if e.code < 500 or last:
                    return None, e.code, f"HTTP {e.code}"
            except (URLError, TimeoutError, ConnectionError) as e:
                if last:
                    return None, None, str(getattr(e, "reason", e)) or type(e).__name__
            except Exception as e:  # noqa: BLE001 - a page fails its own row only
                return None, None, str(e) or type(e).__name__
            time.sleep(WAIT_SECONDS * 2**k)
        raise AssertionError("unreachable")

    return page


def write_archive(pages: DataFrame, folder: str, buckets: int) -> None:
    """url and html in ``buckets`` folders by the CRC-32 of the URL. A reader holds one bucket at a time: choose so many that one is a few megabytes."""
    bucket = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(buckets)).cast("int")
    pages.select("url", "html", F.lit(buckets).alias("of"), bucket.alias("bucket")).repartition(buckets, "bucket").write.partitionBy("of", "bucket").parquet(folder)


def from_archive(uri: str) -> Callable[[str], tuple]:
    """html, status and error of a URL from an archive; of pages with one URL the least text counts."""
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    numbered = lambda path, name: {int(x.base_name.partition("=")[2]) for x in system.get_file_info(fs.FileSelector(path)) if x.base_name.startswith(f"{name}=")}
    buckets = next(iter(numbered(path, "of")), 1)
    path = f"{path}/of={buckets}"
    made = numbered(path, "bucket") if system.get_file_info(path).type == fs.FileType.Directory else set()
    held: dict[int, dict[str, str]] = {}

    def page(url: str) -> tuple[str | None, int | None, str | None]:
        k = zlib.crc32(url.encode()) % buckets
        if k not in held:
            held.clear()
            rows = pq.read_table(f"{path}/bucket={k}", filesystem=system, columns=["url", "html"], partitioning=None).to_pylist() if k in made else []
            held[k] = {}
            for r in sorted((r for r in rows if r["html"] is not None), key=lambda r: r["html"], reverse=True):
                held[k][r["url"]] = r["html"]
        html = held[k].get(url)
        return (html, OK, None) if html is not None else (None, NOT_FOUND, f"HTTP {NOT_FOUND}")

    return page


class _Pages:
    def __init__(self, options: dict[str, str]):
        self.uri, self.archive = options["list"], options.get("archive")
        self.hosts = frozenset(h.strip() for h in options.get("hosts", "").split(",") if h.strip())
        self.size, self.timeout, self.attempts = int(options.get("bytes", PART_BYTES)), int(options.get("timeout", 10)), int(options.get("attempts", ATTEMPTS))
        if not self.hosts and not self.archive:
            raise ValueError("name the hosts that may be fetched, or an archive")

    def read(self, part: Lines) -> Iterator[tuple]:
        system = fs.FileSystem.from_uri(self.uri)[0] if "://" in self.uri else fs.LocalFileSystem()
        page = from_archive(self.archive) if self.archive else from_web(self.hosts, self.timeout, self.attempts)
        urls = lines_of(system, part)
        # A partition's lines are few, so the archive's buckets are read once each.
        for url in sorted(urls, key=lambda u: zlib.crc32(u.encode())) if self.archive else urls:
            yield (url, *page(url))


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Lines]:
        _, found = _files(self.uri)
        return [part for x in found for part in ranges(x.path, 0, x.size, self.size)]


class PageStream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, found = _files(self.uri)
        return {x.path: whole_lines(system, x.path, x.size) for x in found}

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        return [part for path, stop in sorted(end.items()) for part in ranges(path, start.get(path, 0), stop, self.size)]


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))

    def streamReader(self, schema) -> PageStream:
        return PageStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)


def saved_pages(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The table of pages below ``folder``, with those of lines that are new in the list fetched and added."""
    from textloom.streaming.run import finish

    register(spark)
    return finish(spark.readStream.format(NAME).options(**options).load(), folder)
