"""Search over any DataFrame of lines: all that match, their number, and the first few in order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compile import predicate, predicate_on_text
from ..plans.query import Query, parse_query, spark_chars


def as_query(spark, query: Query | str) -> Query:
    return parse_query(query, spark_chars(spark, query)) if isinstance(query, str) else query


def matching(lines: DataFrame, query: Query | str, on: Column | None = None, line: str = "line") -> DataFrame:
    """The lines that match. `on`: their stored tokens; else lines are folded in the filter."""
    query = as_query(lines.sparkSession, query)
    return lines.filter(predicate_on_text(query, line) if on is None else predicate(query, on))


@dataclass
class SearchResult:
    """What a search finds. `total` counts all matches; `rows` holds the first `limit` in order."""

    matches: DataFrame
    order: list[str]
    limit: int | None
    line: str = "line"

    @property
    def total(self) -> int:
        return self.matches.count()

    @property
    def rows(self) -> DataFrame:
        ordered = self.matches.orderBy(*self.order)
        return ordered if self.limit is None else ordered.limit(self.limit)

    def lines(self) -> list[str]:
        """To the driver: bounded by the limit, unless there is none."""
        return [r[0] for r in self.rows.select(self.line).collect()]


def term_count(lines: DataFrame, term: str, on: Column) -> DataFrame:
    """One row: the number of lines that hold a term."""
    return lines.filter(F.array_contains(on, term)).agg(F.count("*").alias("count"))


def term_lines(lines: DataFrame, term: str, on: Column, order: list[str], limit: int | None = None) -> SearchResult:
    """The lines that hold a term, the first `limit` in order."""
    return SearchResult(lines.filter(F.array_contains(on, term)), order, limit)


def response(result: SearchResult, query_text: str) -> DataFrame:
    """One row: query, count, total, results. The limit is applied before anything is gathered."""
    if result.limit is None:
        raise ValueError("a response gathers its results in one row and needs a limit")
    numbered = result.rows.select(F.struct(*result.order, F.col(result.line).alias("_line")).alias("r"))
    top = numbered.agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["_line"]).alias("results"))
    total = result.matches.agg(F.count("*").alias("total"))
    return total.join(top).select(F.lit(query_text).alias("query"), F.size("results").cast("long").alias("count"), "total", "results")
