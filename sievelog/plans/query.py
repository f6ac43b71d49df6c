"""The query language: terms, AND, OR, NOT and parentheses, or the same as a JSON tree.

    query := or | blank            blank finds nothing
    or    := and (OR and)*
    and   := not ([AND] not)*      two operands side by side are joined by AND
    not   := NOT* atom
    atom  := "(" or ")" | term

Words are runs of token characters, AND, OR and NOT are known in any case, and every other character separates: so
`env=prod` is two terms joined by AND, and `not-found` is NOT found. JSON: {"term": text}, {"and": [..]}, {"or": [..]},
{"not": ..}; there `and` is a word like any other, and a term of several words joins them by AND.

Queries may nest to any depth: every walk over a tree here keeps its own stack.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

#: Unicode white space.
WHITE_SPACE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


class QueryError(ValueError):
    """The query does not parse."""


class Query:
    """A node of a query."""

    def __str__(self) -> str:
        return display(self)


@dataclass(frozen=True)
class Term(Query):
    text: str

    __str__ = Query.__str__


@dataclass(frozen=True)
class And(Query):
    children: tuple[Query, ...]

    __str__ = Query.__str__


@dataclass(frozen=True)
class Or(Query):
    children: tuple[Query, ...]

    __str__ = Query.__str__


@dataclass(frozen=True)
class Not(Query):
    child: Query

    __str__ = Query.__str__


def parts_of(query: Query) -> tuple[Query, ...]:
    match query:
        case Term():
            return ()
        case And(children) | Or(children):
            return children
        case Not(child):
            return (child,)
    raise TypeError(f"no query: {query!r}")


def fold(query: Query, leaf: Callable[[Term], object], node: Callable[[Query, list], object]):
    """The value of a tree from its leaves up: leaf(term), node(query, values of its parts)."""
    todo, values = [(query, False)], []
    while todo:
        q, seen = todo.pop()
        parts = parts_of(q)
        if isinstance(q, Term):
            values.append(leaf(q))
        elif seen:
            at = len(values) - len(parts)
            values[at:] = [node(q, values[at:])]
        else:
            todo.append((q, True))
            todo.extend((p, False) for p in reversed(parts))
    return values[0]


def display(query: Query) -> str:
    """Infix text. All but terms are put in parentheses inside others."""
    out, todo = [], [query]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        elif isinstance(item, Term):
            out.append(item.text)
        else:
            parts = parts_of(item)
            between = " OR " if isinstance(item, Or) else " AND "
            line: list[Query | str] = ["NOT "] if isinstance(item, Not) else []
            for i, part in enumerate(parts):
                line += [between] * (i > 0) + ([part] if isinstance(part, Term) else ["(", part, ")"])
            todo.extend(reversed(line))
    return "".join(out)


#: What a character is to the tokenizer: (whether it belongs to tokens, its lower case).
CharTable = Callable[[str], tuple[bool, str]]


def plain_chars(char: str) -> tuple[bool, str]:
    """By Python's own tables. They agree with the JVM's on ASCII and on nearly all letters."""
    return char.isalnum() or char == "_", char.lower()


def spark_chars(spark, text: str) -> CharTable:
    """By the JVM's tables, which tokenize lines. A query is asked only if the text is not ASCII."""
    special = sorted({c for c in text if ord(c) > 127})
    if not special:
        return plain_chars
    from pyspark.sql import functions as F

    from ..functions.text import is_token_char, normalize_token

    # One row that never leaves the driver's optimizer: the characters as an array of code points.
    rows = spark.createDataFrame([(c,) for c in special], "c string").select("c", is_token_char(F.col("c")).alias("t"), normalize_token(F.col("c")).alias("n")).collect()
    known = {r["c"]: (r["t"], r["n"]) for r in rows}
    return lambda char: known.get(char) or plain_chars(char)


def words(text: str, chars: CharTable = plain_chars) -> Iterator[str]:
    """Runs of token characters, as they are written; a parenthesis comes as a word of its own."""
    run = []
    for char in text:
        if chars(char)[0]:
            run.append(char)
            continue
        if run:
            yield "".join(run)
            run = []
        if char in "()":
            yield char
    if run:
        yield "".join(run)


def normalize(word: str, chars: CharTable = plain_chars) -> str:
    return "".join(chars(c)[1] for c in word)


_OPERATORS = {"AND", "OR", "NOT"}


def _operator(word: str) -> str | None:
    """The operator that a word spells, in ASCII letters of any case."""
    upper = word.upper() if word.isascii() else word
    return upper if upper in _OPERATORS else None


class _Level:
    """What an open parenthesis has so far: finished alternatives, operands of the last one, and NOTs that wait for theirs."""

    def __init__(self):
        self.either, self.all, self.nots = [], [], 0

    def take(self, query: Query) -> None:
        for _ in range(self.nots):
            query = Not(query)
        self.nots = 0
        self.all.append(query)

    def alternative(self) -> None:
        self.either.append(self.all[0] if len(self.all) == 1 else And(tuple(self.all)))
        self.all = []

    def close(self) -> Query:
        self.alternative()
        return self.either[0] if len(self.either) == 1 else Or(tuple(self.either))


def parse_query(text: str, chars: CharTable = plain_chars) -> Query:
    if all(c in WHITE_SPACE for c in text):
        return Term("")
    items = []
    for word in words(text, chars):
        kind = word if word in "()" else _operator(word)
        items.append((kind, None) if kind else ("TERM", normalize(word, chars)))
    levels, operand = [_Level()], True  # operand: whether one must come next
    for kind, value in [*items, ("END", None)]:
        if not operand and kind in ("TERM", "(", "NOT"):
            operand = True  # side by side: AND
        if operand:
            if kind == "NOT":
                levels[-1].nots += 1
            elif kind == "TERM":
                levels[-1].take(Term(value))
                operand = False
            elif kind == "(":
                levels.append(_Level())
            else:
                raise QueryError("the query ends where a term should come" if kind == "END" else f"{kind} where a term should come")
        elif kind == "AND":
            operand = True
        elif kind == "OR":
            levels[-1].alternative()
            operand = True
        elif kind == ")":
            if len(levels) == 1:
                raise QueryError(") is left over")
            query = levels.pop().close()
            levels[-1].take(query)
        elif len(levels) > 1:
            raise QueryError("a parenthesis is not closed")
    return levels[0].close()


def term(text: str, chars: CharTable = plain_chars) -> Query:
    """A term as JSON gives it: its words, joined by AND."""
    found = tuple(Term(normalize(w, chars)) for w in words(text, chars) if w not in "()")
    return found[0] if len(found) == 1 else And(found) if found else Term("")


class _Reading:
    """A JSON node on its way to a query: the keys that may still hold it, and the parts of the one that is being read."""

    def __init__(self, tree: object):
        self.given = tree if isinstance(tree, dict) else {}
        self.keys = [(k, n) for k, n in (("and", And), ("or", Or), ("not", Not)) if k in self.given and (k == "not" or isinstance(self.given[k], list))]
        self.next_key()

    def next_key(self) -> None:
        self.node, self.parts, self.read = None, [], []
        if self.keys:
            key, self.node = self.keys.pop(0)
            self.parts = [self.given[key]] if key == "not" else self.given[key]


def from_json(tree: object, chars: CharTable = plain_chars) -> Query:
    """A tree of term, and, or, not. The first of these keys that holds the right kind of value counts."""
    todo, done = [_Reading(tree)], None  # done: the query of the node that was finished last, or False if it is none
    while todo:
        now = todo[-1]
        if done is not None:
            if done is False:
                now.next_key()
            else:
                now.read.append(done)
            done = None
        if isinstance(now.given.get("term"), str):
            done = term(now.given["term"], chars)
        elif now.node is None:
            done = False
        elif len(now.read) < len(now.parts):
            todo.append(_Reading(now.parts[len(now.read)]))
            continue
        elif now.node is Not:
            done = Not(now.read[0])
        else:
            done = now.read[0] if len(now.read) == 1 else now.node(tuple(now.read))
        todo.pop()
    if done is False:
        raise QueryError("a query is an object with term, and, or or not")
    return done


def terms(query: Query) -> list[str]:
    """The distinct terms, sorted, without the empty one."""
    found, todo = set(), [query]
    while todo:
        q = todo.pop()
        if isinstance(q, Term):
            found.add(q.text)
        todo.extend(parts_of(q))
    return sorted(found - {""})


def matches(query: Query, tokens: set[str] | frozenset[str] = frozenset()) -> bool:
    """Whether a line of these tokens is found. An empty AND or OR finds nothing."""

    def node(q: Query, values: list) -> bool:
        return not values[0] if isinstance(q, Not) else bool(values) and all(values) if isinstance(q, And) else any(values)

    return fold(query, lambda t: t.text != "" and t.text in tokens, node)


NOTHING = Term("")


def _constant(query: Query) -> bool | None:
    """False for what finds nothing, True for NOT of it, else None."""
    if isinstance(query, Not):
        return True if isinstance(query.child, Term) and not query.child.text else None
    return False if isinstance(query, Term) and not query.text else None


def simplified(query: Query) -> Query:
    """The same lines by a smaller tree: no NOT of a NOT, no AND in an AND or OR in an OR, no term twice, no branch that
    finds nothing or everything where it says nothing."""

    def node(q: Query, parts: list[Query]) -> Query:
        if isinstance(q, Not):
            return parts[0].child if isinstance(parts[0], Not) else Not(parts[0])
        if not parts:
            return NOTHING
        kind, decides = type(q), isinstance(q, Or)  # the constant that settles the whole
        kept, known = [], set()
        for part in (x for p in parts for x in (p.children if type(p) is kind else (p,))):
            constant = _constant(part)
            if constant is decides:
                return part
            if constant is None and not (isinstance(part, Term) and part.text in known):
                kept.append(part)
                known |= {part.text} if isinstance(part, Term) else set()
        if not kept:
            return NOTHING if decides else Not(NOTHING)
        return kept[0] if len(kept) == 1 else kind(tuple(kept))

    return fold(query, lambda t: t, node)


def depth(query: Query) -> int:
    return fold(query, lambda t: 1, lambda q, values: 1 + max(values, default=0))


def program(query: Query) -> list[tuple[str, str]]:
    """A query as steps of a machine with a stack: (term, text), (not, ""), (and, ""), (or, ""), the last two on two values."""
    out: list[tuple[str, str]] = []
    todo: list[Query | tuple[str, str]] = [query]
    while todo:
        q = todo.pop()
        if isinstance(q, tuple):
            out.append(q)
        elif isinstance(q, Term):
            out.append(("term", q.text))
        else:
            parts, step = parts_of(q), ("not" if isinstance(q, Not) else "and" if isinstance(q, And) else "or", "")
            if not parts:
                out.append(("term", ""))
                continue
            todo.extend([step] if step[0] == "not" else [])
            for i, part in reversed(list(enumerate(parts))):
                todo.extend([step] if i and step[0] != "not" else [])
                todo.append(part)
    return out
