"""Table functions in Python for SQL: the blocks of a page as rows.

``page_blocks(html)`` stands in a lateral join. ``blocks_by_url(TABLE ...)`` takes a table of pages and gives the blocks of
one page of each URL; it asks for its rows by URL and in order of page_id itself, so the caller needs no PARTITION BY.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

from .html import read_page


@F.udtf(returnType="block_index int, text string", useArrow=True)
class PageBlocks:
    def eval(self, html: str | None) -> Iterator[tuple]:
        yield from enumerate(read_page(html)[0] if html is not None else [])


@F.udtf
class BlocksByUrl:
    """The page with the least page_id counts; a null id comes first. Pages without blocks give no row."""

    def __init__(self) -> None:
        self.seen = False

    @staticmethod
    def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
        given = pages.dataType.fieldNames() if pages.isTable else []
        if missing := {"url", "page_id", "html"} - set(given):
            raise ValueError(f"blocks_by_url needs a table with columns url, page_id and html; missing: {sorted(missing)}")
        # No session here, so no DDL.
        kinds = {"url": T.StringType(), "page_id": T.LongType(), "block_index": T.IntegerType(), "text": T.StringType()}
        schema = T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])
        chosen = [SelectedColumn("url"), SelectedColumn("page_id"), SelectedColumn("html")]
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("url")], orderBy=[OrderingColumn("page_id"), OrderingColumn("html")], select=chosen)

    def eval(self, page: Row) -> Iterator[tuple]:
        if self.seen:
            return
        self.seen = True
        for i, text in enumerate(read_page(page["html"])[0] if page["html"] is not None else []):
            yield page["url"], page["page_id"], i, text


def register(spark: SparkSession) -> None:
    spark.udtf.register("page_blocks", PageBlocks)
    spark.udtf.register("blocks_by_url", BlocksByUrl)
