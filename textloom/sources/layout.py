"""Tables in partitions and buckets: rerunning a load replaces its partitions only, and joins on the bucket key need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def write_layout(df: DataFrame, table: str, partition_by: str, bucket_by: str, buckets: int, path: str | None = None) -> DataFrame:
    """Writes ``df`` to a catalog table, by values of ``partition_by`` and ``buckets`` buckets of ``bucket_by``, and gives the table.

    A new table's files lie at ``path``, if given, and not in the warehouse.

    An existing table keeps its other partitions, and those that ``df`` has rows of are replaced, so writing the same
    rows again changes nothing. Rows are dealt out by bucket first, so each partition has one file for each bucket at most.
    """
    spark = df.sparkSession
    # The same hash places rows here and in buckets.
    dealt = df.repartition(buckets, bucket_by)
    if not spark.catalog.tableExists(table):
        writer = dealt.write.format("parquet").partitionBy(partition_by).bucketBy(buckets, bucket_by).sortBy(bucket_by)
        (writer.option("path", path) if path else writer).saveAsTable(table)
        return spark.table(table)
    _check(spark, table, partition_by, bucket_by, buckets)
    before = spark.conf.get(OVERWRITE)
    spark.conf.set(OVERWRITE, "dynamic")
    try:
        dealt.select(*spark.table(table).columns).write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(OVERWRITE, before)
    return spark.table(table)


def _check(spark: SparkSession, table: str, partition_by: str, bucket_by: str, buckets: int) -> None:
    """A table of another layout is refused: its joins would shuffle unnoticed."""
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    columns = {c.name: c for c in spark.catalog.listColumns(table)}
    found = (int(told.get("Num Buckets", 0)), [c for c in columns if columns[c].isBucket], [c for c in columns if columns[c].isPartition])
    if found != (buckets, [bucket_by], [partition_by]):
        raise ValueError(f"{table} has {found[0]} buckets of {found[1]} in partitions of {found[2]}")


def counts_by_file(table: DataFrame) -> DataFrame:
    """Rows of each file of a table: what a load left behind."""
    return table.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
