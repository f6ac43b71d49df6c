"""Bodies of requests and datagrams, as columns of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_array_body(bodies: DataFrame, body: str = "body", line: str = "line") -> DataFrame:
    """A JSON array of strings to a row for each, empty strings and line breaks kept. A body of another kind gives none."""
    return bodies.select(F.explode(F.from_json(body, "array<string>")).alias(line)).filter(F.col(line).isNotNull())


def split_lines(text: Column) -> Column:
    """The lines of a datagram or of what a connection sent: split at line feeds, without the carriage returns behind, without empty ones."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "\r+$", "")), lambda x: x != "")


def from_datagrams(datagrams: DataFrame, payload: str = "payload", line: str = "line") -> DataFrame:
    """Binary or text payloads to a row for each line; bytes that are no UTF-8 become replacement characters."""
    text = F.col(payload)
    if dict(datagrams.dtypes)[payload] == "binary":
        text = F.make_valid_utf8(F.col(payload).cast("string"))
    return datagrams.select(F.explode(split_lines(text)).alias(line))
