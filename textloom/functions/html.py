"""Text blocks and lines of saved web pages.

Elements are those of a lenient parser without implied end tags: an unclosed element runs to the
end tag of an enclosing one or to the end of the page, so an unclosed ``p`` holds the ``p`` after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that go with all they hold, elements whose text is a block, elements without an end.
DROPPED = frozenset("script style noscript header footer nav aside".split())
BLOCKS = frozenset({"p", "article"})
VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split())
#: Text anywhere in them isn't text of the page.
SILENT = frozenset({"template", "rt", "rp"})


class _Page(HTMLParser):
    """One pass over the page: text pieces in order, and the range of pieces of each block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []  # tag and block number or -1
        self.depth: dict[str, int] = {}
        self.dropped = self.silent = 0
        self.pieces: list[str] = []
        self.blocks: list[list[int]] = []
        self.run: list[str] = []

    def _end_run(self) -> None:
        if self.run:
            text = "".join(self.run).strip()
            self.run = []
            if text and not self.dropped and not self.silent:
                self.pieces.append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._end_run()
        if tag in VOID:
            return
        block = -1
        self.dropped += tag in DROPPED
        self.silent += tag in SILENT
        if tag in BLOCKS and not self.dropped:
            block = len(self.blocks)
            self.blocks.append([len(self.pieces), -1])
        self.open.append((tag, block))
        self.depth[tag] = self.depth.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def _close(self) -> str:
        tag, block = self.open.pop()
        self.depth[tag] -= 1
        self.dropped -= tag in DROPPED
        self.silent -= tag in SILENT
        if block >= 0:
            self.blocks[block][1] = len(self.pieces)
        return tag

    def handle_endtag(self, tag: str) -> None:
        self._end_run()
        if self.depth.get(tag):
            while self._close() != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.run.append(data)

    def handle_comment(self, data: str) -> None:
        self._end_run()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def finish(self) -> None:
        self.close()
        self._end_run()
        while self.open:
            self._close()


def _parsed(html: str) -> _Page:
    page = _Page()
    page.feed(html)
    page.finish()
    return page


def _blocks(page: _Page) -> Iterator[str]:
    return (" ".join(page.pieces[a:b]) for a, b in page.blocks)


def _lines(page: _Page) -> Iterator[str]:
    return (x.strip() for x in "\n".join(page.pieces).splitlines())


def read_page(html: str) -> tuple[list[str], list[str]]:
    """Texts of all blocks in document order, and the lines of the whole page."""
    page = _parsed(html)
    return list(_blocks(page)), list(_lines(page))


#: Characters, and 64 for each text, for which a batch is handed on. Blocks hold each other, so a page can give many times its own length.
STEP_CHARS = 1 << 20
_PARTS = pa.struct([(name, pa.list_(pa.string())) for name in ("blocks", "lines")])


@F.arrow_udf(T.StructType([T.StructField(name, T.ArrayType(T.StringType())) for name in ("blocks", "lines")]))
def _page_parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Batches come by number of rows; what is made of them leaves by size."""
    for pages in batches:
        made, held = [], 0
        for html in pages:
            blocks, lines = read_page(html.as_py()) if html.is_valid else ([], [])
            made.append({"blocks": blocks, "lines": lines})
            held += sum(map(len, blocks)) + sum(map(len, lines)) + 64 * (1 + len(blocks) + len(lines))
            if held >= STEP_CHARS:
                yield pa.array(made, _PARTS)
                made, held = [], 0
        yield pa.array(made, _PARTS)


def page_parts(html: Column) -> Column:
    """struct<blocks, lines>; a null page has neither."""
    return _page_parts(html)


_TEXTS = {"blocks": _blocks, "lines": _lines}


def page_texts(pages: DataFrame, of: str, index: str) -> DataFrame:
    """page_id, ``index`` and text of all ``blocks`` or ``lines`` of pages, a row each; a null page has none.

    A text leaves before the next one of its page is made, so a task holds one page and a small batch of texts, not all texts of many pages.
    """
    texts = _TEXTS[of]

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for page_id, html in zip(batch.column("page_id"), batch.column("html"), strict=True):
            for i, text in enumerate(texts(_parsed(html.as_py())) if html.is_valid else ()):
                yield page_id.as_py(), i, text

    def batch_of(made: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("page_id", batch.schema.field("page_id").type), (index, pa.int32()), ("text", pa.string())])
            made, held = [], 0
            for row in rows(batch):
                made.append(row)
                held += len(row[2]) + 64
                if held >= STEP_CHARS:
                    yield batch_of(made, schema)
                    made, held = [], 0
            if made:
                yield batch_of(made, schema)

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, {index} int, text string")
