"""Cutting numbered lines into blocks and packs, and what is known of a block."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BLOCK_ROWS, PACK_ROWS, shared_dir


def _drop(spark, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone by then
        pass


def number_lines(df: DataFrame, order: list[str], column: str = "line_no", start: int = 0) -> DataFrame:
    """Number rows from `start` in the order of some columns, without ever bringing all rows to one task.

    A range sort places rows and writes them to the shared folder, as the sort's cut points come from a sample and the
    partitions must be those that were counted; a lost executor costs no more than what reads them. One count a partition
    goes to the driver and comes back as the partition's offset. The order must be total for the numbers to be the same
    every time. What is written stays until the driver ends.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    path = f"{shared_dir(spark)}/numbered-{uuid.uuid4().hex}"
    placed.write.parquet(path)
    atexit.register(_drop, spark, path)
    placed = spark.read.schema(placed.schema).parquet(path)
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())
    starts, at = [], start
    for number, size in sizes:
        starts.append((number, at))
        at += size
    starts = F.broadcast(spark.createDataFrame(starts or [(0, start)], "_part long, _start long"))  # a row for each partition
    return placed.withColumn("_part", part).join(starts, "_part").withColumn(column, F.col("_start") + inside).drop("_part", "_start", "_at")


def block_of(line_no: str, block_rows: int = BLOCK_ROWS, first_block: int = 0) -> Column:
    return F.expr(f"`{line_no}` div {block_rows}L") + F.lit(first_block).cast("long")


def line_of(line_no: str, block_rows: int = BLOCK_ROWS) -> Column:
    return (F.col(line_no) % block_rows).cast("int")


def pack_of(line_id: str, pack_rows: int = PACK_ROWS) -> Column:
    return F.expr(f"`{line_id}` div {pack_rows}").cast("int")


def assign_blocks(numbered: DataFrame, block_rows: int = BLOCK_ROWS, pack_rows: int = PACK_ROWS, first_block: int = 0, column: str = "line_no") -> DataFrame:
    """Numbered lines with block_id, line_id (its place in the block) and pack_id."""
    placed = numbered.withColumns({"block_id": block_of(column, block_rows, first_block), "line_id": line_of(column, block_rows)})
    return placed.withColumn("pack_id", pack_of("line_id", pack_rows))


def block_metadata(lines: DataFrame, pack_rows: int = PACK_ROWS) -> DataFrame:
    """block_id, num_lines, rows_per_pack, num_packs, data_size (bytes of text) of every block."""
    return lines.groupBy("block_id").agg(
        F.count("*").alias("num_lines"),
        F.lit(pack_rows).alias("rows_per_pack"),
        F.ceil(F.count("*") / pack_rows).cast("int").alias("num_packs"),
        F.sum(F.octet_length("line")).cast("long").alias("data_size"),
    )
