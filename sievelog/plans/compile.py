"""From queries to plans. Four forms give the same rows:

* `predicate_on_text(q, "line")`: folds lines in the filter, and only those that hold the terms as substrings; for lines
  without an index.
* `predicate(q, col("tokens"))`: the stored tokens.
* `from_lists`: reads only the lists of the query's terms, a list for each block, and combines them inside each block.
* `from_postings`: the same from an index of any key in row form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded, normalize_token
from .query import And, Not, Query, depth, fold, matches, program, simplified, terms

KEY = ["block_id", "line_id"]


#: Depth of a simplified tree from which on it is run as a program, as Catalyst walks expressions by recursion.
DEEP = 40


def balanced(join: Callable[[Column, Column], Column], parts: list[Column]) -> Column:
    """Many conditions joined as a tree of little depth."""
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _compile(query: Query, holds: Callable[[Column], Column]) -> Column:
    """A condition, given that of a term. Constants are left to the optimizer to fold."""
    query = simplified(query)
    if depth(query) > DEEP:
        return _run(query, holds)

    def node(q: Query, parts: list[Column]) -> Column:
        if isinstance(q, Not):
            return ~parts[0]
        return balanced(Column.__and__ if isinstance(q, And) else Column.__or__, parts)

    return fold(query, lambda t: holds(F.lit(t.text)) if t.text else F.lit(False), node)


def _steps(query: Query) -> Column:
    return F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(text).alias("text")) for kind, text in program(query)))


def _run(query: Query, holds: Callable[[Column], Column]) -> Column:
    """The same for a tree of any depth: one expression of fixed depth that runs through its program with a stack of truths."""

    def step(stack: Column, now: Column) -> Column:
        size = F.size(stack)
        top, below = F.element_at(stack, -1), F.get(stack, size - 2)
        pushed = F.concat(stack, F.array((now["text"] != "") & holds(now["text"])))
        turned = F.concat(F.slice(stack, F.lit(1), size - 1), F.array(~top))
        joined = F.concat(F.slice(stack, F.lit(1), size - 2), F.array(F.when(now["kind"] == "and", below & top).otherwise(below | top)))
        return F.when(now["kind"] == "term", pushed).when(now["kind"] == "not", turned).otherwise(joined)

    return F.element_at(F.aggregate(_steps(query), F.array().cast("array<boolean>"), step), 1)


def predicate(query: Query, tokens: Column) -> Column:
    """A filter over an array of distinct tokens, which holds no null."""
    return _compile(query, lambda term: F.array_contains(tokens, term))


def predicate_on_text(query: Query, line: str) -> Column:
    """A filter over raw lines. The line is folded once, whatever the number of terms: the lambda binds it, as a filter
    would otherwise work it out for every term."""
    if not terms(query):
        return F.lit(matches(query))
    return guard(query, normalize_token(F.coalesce(F.col(line), F.lit("")))) & F.exists(F.array(folded(line)), lambda text: _compile(query, lambda term: F.contains(text, F.concat(F.lit(" "), term, F.lit(" ")))))


def guard(query: Query, lowered: Column) -> Column:
    """A cheap condition that every match meets: the terms occur somewhere in the lowered line. What NOT asks for is left open."""
    query = simplified(query)
    if depth(query) > DEEP:
        return F.lit(True)

    def node(q: Query, parts: list[Column]) -> Column:
        if isinstance(q, Not):
            return F.lit(True)
        return balanced(Column.__and__ if isinstance(q, And) else Column.__or__, parts)

    return fold(query, lambda t: F.contains(lowered, F.lit(t.text)) if t.text else F.lit(False), node)


#: Term of a block's row that stands for the block itself: the empty string, which is no token. Its num_ids is the number of lines.
BLOCK = ""


def _ids(query: Query) -> Column:
    """Line ids of a block that match, ascending, from `held`, the lists of the query's terms, and `num_lines`."""
    none = F.array().cast("array<int>")
    every = F.when(F.col("num_lines") > 0, F.sequence(F.lit(0), (F.col("num_lines") - 1).cast("int"))).otherwise(none)
    of = lambda text: F.coalesce(F.try_element_at(F.col("held"), text), none)
    query = simplified(query)
    if depth(query) > DEEP:

        def step(stack: Column, now: Column) -> Column:
            size = F.size(stack)
            top, below = F.element_at(stack, -1), F.get(stack, size - 2)
            turned = F.concat(F.slice(stack, F.lit(1), size - 1), F.array(F.array_except(every, top)))
            joined = F.concat(F.slice(stack, F.lit(1), size - 2), F.array(F.when(now["kind"] == "and", F.array_intersect(below, top)).otherwise(F.array_union(below, top))))
            return F.when(now["kind"] == "term", F.concat(stack, F.array(F.when(now["text"] == "", none).otherwise(of(now["text"]))))).when(now["kind"] == "not", turned).otherwise(joined)

        return F.array_sort(F.element_at(F.aggregate(_steps(query), F.array().cast("array<array<int>>"), step), 1))

    def node(q: Query, parts: list[tuple[bool, Column]]) -> tuple[bool, Column]:
        """Each value is a list, or if its first part is True what a list leaves of the block, which is made only if it must be."""
        if isinstance(q, Not):
            return not parts[0][0], parts[0][1]
        kept, left = [c for n, c in parts if not n], [c for n, c in parts if n]
        meet, union = (F.array_intersect, F.array_union) if isinstance(q, And) else (F.array_union, F.array_intersect)
        # AND: what all lists share, less what any of those to be left out has; OR is the same the other way round.
        inside, outside = balanced(meet, kept) if kept else None, balanced(union, left) if left else None
        if outside is None or inside is None:
            return inside is None, outside if inside is None else inside
        return (False, F.array_except(inside, outside)) if isinstance(q, And) else (True, F.array_except(outside, inside))

    turned, ids = fold(query, lambda t: (False, of(F.lit(t.text)) if t.text else none), node)
    return F.array_sort(F.array_except(every, ids) if turned else ids)


def from_lists(query: Query, lists: DataFrame) -> DataFrame:
    """(block_id, ids): line ids found in each block that has any. lists: (block_id, term, num_ids, ids) with a BLOCK row
    for each block. Only rows of the query's terms are read; a block's are met without a shuffle if lists are bucketed by it.
    """
    wanted = terms(query)
    rows = lists.filter(F.col("term").isin(BLOCK, *wanted))
    held = F.map_from_entries(F.collect_list(F.when(F.col("term") != BLOCK, F.struct("term", "ids"))))
    blocks = rows.groupBy("block_id").agg(held.alias("held"), F.max(F.when(F.col("term") == BLOCK, F.col("num_ids"))).alias("num_lines"))
    return blocks.select("block_id", _ids(query).alias("ids")).filter(F.size("ids") > 0)


def from_postings(query: Query, postings: DataFrame, lines: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Keys of the lines found; postings: (term, *key); lines: at least *key.

    A line that holds none of the terms has no posting. If such a line matches (as with NOT), the lines that don't match
    are found instead, and taken from all.
    """
    universe = lines.select(*key)
    if not terms(query):
        return universe.filter(F.lit(matches(query)))
    inverted = matches(query)  # a line without any of the terms
    wanted = Not(query) if inverted else query
    hits = postings.filter(F.col("term").isin(terms(query))).select("term", *key)
    found = hits.groupBy(*key).agg(F.collect_set("term").alias("_held")).filter(predicate(wanted, F.col("_held"))).select(*key)
    return universe.join(found, key, "left_anti") if inverted else found


def fetch(lines: DataFrame, keys: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Late materialization: the lines of the keys, nothing else of them moved."""
    return lines.join(keys, key, "left_semi")
