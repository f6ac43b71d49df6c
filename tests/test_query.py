import random

import pytest

from sievelog.plans.query import And, Not, Or, QueryError, Term, depth, display, from_json, matches, parse_query, program, simplified, terms

a, b, c = Term("a"), Term("b"), Term("c")

PARSES = {
    "error": Term("error"),
    "auth error": And((Term("auth"), Term("error"))),
    "auth OR error debug": Or((Term("auth"), And((Term("error"), Term("debug"))))),
    "a AND b OR c": Or((And((a, b)), c)),
    "NOT (a OR b)": Not(Or((a, b))),
    "env=prod": And((Term("env"), Term("prod"))),
    "": Term(""),
    " \t　": Term(""),
    "a and b or c": Or((And((a, b)), c)),
    "a NOT b": And((a, Not(b))),
    "NOT NOT a": Not(Not(a)),
    "(a b) c": And((And((a, b)), c)),
    "not-found": Not(Term("found")),
    "rock-and-roll": And((Term("rock"), Term("roll"))),
    "and_or": Term("and_or"),
    '"foo bar"': And((Term("foo"), Term("bar"))),
    "foo*": Term("foo"),
    "-foo": Term("foo"),
    "ERROR": Term("error"),
    "((a))": a,
    "a AND (b OR c) AND NOT a": And((a, Or((b, c)), Not(a))),
}


@pytest.mark.parametrize("text", PARSES)
def test_parse(text):
    assert parse_query(text) == PARSES[text]


@pytest.mark.parametrize("text", ["(a OR b", "!!!", "a AND", "OR a", "a OR", "a AND AND b", "NOT", "()", "a)"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse_query(text)


JSON = [
    ({"term": "!!!"}, Term("")),
    ({"term": "and"}, Term("and")),
    ({"term": "env=prod"}, And((Term("env"), Term("prod")))),
    ({"and": []}, And(())),
    ({"or": []}, Or(())),
    ({"or": [{"term": "A"}]}, a),
    ({"not": {"and": []}}, Not(And(()))),
    ({"and": [{"term": "a"}, {"not": {"term": "b"}}]}, And((a, Not(b)))),
    ({"term": 5, "or": [{"term": "a"}, {"term": "b"}]}, Or((a, b))),
    ({"term": "a", "and": [], "more": 1}, a),
    ({"and": [{"no": 1}], "not": {"term": "a"}}, Not(a)),
]


@pytest.mark.parametrize(("tree", "want"), JSON)
def test_json(tree, want):
    assert from_json(tree) == want


@pytest.mark.parametrize("tree", [None, [], "a", {}, {"and": {}}, {"not": None}, {"and": [1]}])
def test_json_errors(tree):
    with pytest.raises(QueryError):
        from_json(tree)


def test_display():
    q = parse_query("auth OR (error AND debug)")
    assert display(q) == "auth OR (error AND debug)" and parse_query(display(q)) == q
    assert str(from_json({"and": [{"term": "auth"}, {"not": {"term": "timeout"}}]})) == "auth AND (NOT timeout)"
    assert str(Not(Not(a))) == "NOT (NOT a)" and str(And(())) == ""


def test_any_depth():
    """Ten thousand levels of parentheses, NOT, and JSON: parsed, shown, simplified, evaluated."""
    n = 10_000
    assert parse_query("(" * n + "a" + ")" * n) == a
    deep = parse_query("NOT " * (n + 1) + "a")
    assert matches(deep, set()) and not matches(deep, {"a"}) and display(deep).startswith("NOT (NOT (") and terms(deep) == ["a"]
    assert simplified(deep) == Not(a) and depth(deep) == n + 2
    tree = {"term": "a"}
    for i in range(n):
        tree = {"not": tree} if i % 2 else {"or": [{"term": "b"}, tree]}
    deep = from_json(tree)
    assert matches(deep, {"a"}) is (n // 2 % 2 == 0) and terms(deep) == ["a", "b"]
    with pytest.raises(QueryError):
        parse_query("(" * n + "a")
    for _ in range(3):
        deep = And((deep, b))
    assert depth(simplified(deep)) <= depth(deep)


def test_simplified_finds_the_same():
    rng = random.Random(1)

    def tree(levels):
        kind = rng.choice("tttaon") if levels else "t"
        if kind == "t":
            return Term(rng.choice(["a", "b", "c", ""]))
        return Not(tree(levels - 1)) if kind == "n" else (And if kind == "a" else Or)(tuple(tree(levels - 1) for _ in range(rng.randrange(4))))

    for _ in range(500):
        q = tree(4)
        for held in (set(), {"a"}, {"b", "c"}, {"a", "b", "c"}):
            stack = []
            for kind, text in program(q):
                if kind == "term":
                    stack.append(text != "" and text in held)
                elif kind == "not":
                    stack.append(not stack.pop())
                else:
                    y, x = stack.pop(), stack.pop()
                    stack.append(x and y if kind == "and" else x or y)
            assert matches(simplified(q), held) == matches(q, held) == stack[0] and len(stack) == 1, display(q)


def test_sets():
    """Over four lines, as posting lists would give it."""
    lines = [{"a"}, {"b"}, {"a", "b"}, set()]
    found = lambda text: [i for i, held in enumerate(lines) if matches(parse_query(text), held)]
    assert found("a AND b") == [2] and found("a OR b") == [0, 1, 2] and found("NOT a") == [1, 3]
    assert found("") == [] and terms(parse_query("b a NOT b")) == ["a", "b"]
    assert matches(Not(And(()))) and not matches(Or(()))
