"""Reducing NDJSON to its message.

A JSON string gives its content. A JSON object gives the first of KEYS that holds a string. All else, invalid JSON
included, stays as it came. Done with variant functions, so it stays in the plan; strings only count as strings (a
number under `message` is passed over), the last of equal keys wins, and trailing text makes a line invalid.

Only lines that begin like a string or an object are parsed. They must parse as the only element of an array and as the
value of an object, so that no line can close the bracket that is put around it.

Two kinds of line differ from a strict parser: objects with a number beyond double range anywhere, and strings with an
escaped lone surrogate. Both give their message here and would stay as they came there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of the message, in the order in which they are tried.
KEYS = ("message", "@message", "msg", "log", "text")


def prepare(spark) -> None:
    """Let objects with equal keys parse; the last one wins."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def normalize_line(raw: Column | str) -> Column:
    raw = F.col(raw) if isinstance(raw, str) else raw
    parsed = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    as_value = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}")))

    def string_at(path: str) -> Column:
        value = F.try_variant_get(parsed, path, "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(parsed, path, "string"))

    single = F.try_variant_get(parsed, "$[1]", "variant").isNull() & as_value.isNotNull()
    found = F.coalesce(string_at("$[0]"), *(string_at(f'$[0]["{key}"]') for key in KEYS))
    may_be = F.substring(F.ltrim(raw, F.lit(" \t\n\r")), 1, 1).isin("{", '"')
    return F.coalesce(F.when(may_be, F.when(single, found)), raw)
