"""The inverted index: postings, their dictionary, set operations on them, and how they would be coded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import POSTING_CHUNK
from ..plans.compile import BLOCK


def postings(lines: DataFrame, key: list[str], tokens: str = "tokens") -> DataFrame:
    """(term, *key): one row for each distinct token of each line."""
    # The outer form, as Spark would guard the plain one by a filter that works the tokens out a second time.
    return lines.select(*key, F.explode_outer(tokens).alias("term")).filter(F.col("term").isNotNull()).select("term", *key)


def block_lists(lines: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(block_id, term, num_ids, ids): a list of ascending line ids for each term of each block, which bounds its length,
    and a BLOCK row for each block with the number of its lines."""
    lists = postings(lines, ["block_id", "line_id"], tokens).groupBy("block_id", "term").agg(F.sort_array(F.collect_list("line_id")).alias("ids"))
    lists = lists.select("block_id", "term", F.size("ids").cast("long").alias("num_ids"), "ids")
    blocks = lines.groupBy("block_id").agg(F.count("*").alias("num_ids"))
    return lists.unionByName(blocks.select("block_id", F.lit(BLOCK).alias("term"), "num_ids", F.array().cast("array<int>").alias("ids")))


def dictionary(index: DataFrame, by: list[str]) -> DataFrame:
    """num_ids and num_chunks of every term (of every block, if `by` says so)."""
    entries = index.groupBy(*by, "term").agg(F.count("*").alias("num_ids"))
    return entries.withColumn("num_chunks", chunks(F.col("num_ids")))


def chunks(num_ids: Column) -> Column:
    """Full chunks of POSTING_CHUNK ids, and one for the rest."""
    return F.ceil(num_ids / POSTING_CHUNK).cast("long")


def ids_of(index: DataFrame, term: str, id_column: str) -> DataFrame:
    """The distinct ids of a term."""
    return index.filter(F.col("term") == term).select(id_column).distinct()


def intersect(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.join(b, key, "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.join(b, key, "left_anti")


def intersect_ids(a: Column, b: Column) -> Column:
    """Of two arrays of ids; ascending and distinct, as are the other two."""
    return F.array_sort(F.array_intersect(a, b))


def union_ids(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def difference_ids(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def deltas(index: DataFrame, by: list[str], id_column: str) -> DataFrame:
    """Every posting with its difference to the one before it in its list; the first counts from zero. `by` names a list:
    with the block in it no list, and so no task, has more ids than a block has lines."""
    before = Window.partitionBy(*by).orderBy(id_column)
    return index.withColumn("delta", F.col(id_column) - F.coalesce(F.lag(id_column).over(before), F.lit(0)))


def undelta(coded: DataFrame, by: list[str], order: str) -> DataFrame:
    """The ids back from deltas: running sums in their order."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return coded.withColumn("id", F.sum("delta").over(upto))


def bit_length(value: Column) -> Column:
    return F.when(value == 0, 0).otherwise(F.length(F.bin(value.cast("long"))))


def varint_bytes(value: Column) -> Column:
    """Bytes of a non-negative number at seven bits a byte."""
    return F.ceil(F.greatest(bit_length(value), F.lit(1)) / 7).cast("long")


def coded_size(index: DataFrame, by: list[str], id_column: str) -> DataFrame:
    """num_ids, num_chunks and bytes of every posting list, coded as chunks: POSTING_CHUNK deltas at the bits of the
    largest, behind a byte that says how many; the rest as varints behind a byte and a count of four. A size model, as
    Parquet does the coding.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(id_column)) - 1
    coded = deltas(index, by, id_column).withColumn("chunk", F.floor(place / POSTING_CHUNK))
    parts = coded.groupBy(*by, "chunk").agg(F.count("*").alias("n"), F.max("delta").alias("most"), F.sum(varint_bytes(F.col("delta"))).alias("varints"))
    size = F.when(F.col("n") == POSTING_CHUNK, 1 + POSTING_CHUNK // 8 * bit_length(F.col("most"))).otherwise(5 + F.col("varints"))
    return parts.groupBy(*by).agg(F.sum("n").alias("num_ids"), F.count("*").alias("num_chunks"), F.sum(size).cast("long").alias("bytes"))
