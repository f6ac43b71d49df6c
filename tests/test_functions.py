import json

from pyspark.sql import functions as F

from sievelog.functions.json_lines import normalize_line, prepare
from sievelog.functions.text import first_token, token_list, tokenize, tokens
from sievelog.operators.search import as_query
from sievelog.plans.query import Term
from sievelog.sources.bodies import from_array_body, from_datagrams

TOKENS = {
    "auth_error: user failed!": ["auth_error", "user", "failed"],
    "env=prod GET /api/users 200": ["env", "prod", "GET", "api", "users", "200"],
    "req_id_42 trace_id=abc": ["req_id_42", "trace_id", "abc"],
    "": [],
    "--": [],
    "İstanbul ΟΔΟΣ ²x": ["İstanbul", "ΟΔΟΣ", "²x"],
}


def test_tokenize(spark):
    rows = spark.createDataFrame([(k,) for k in TOKENS], "line string").select("line", tokenize("line").alias("raw"), token_list("line").alias("low")).collect()
    for r in rows:
        assert r["raw"] == TOKENS[r["line"]]
    low = {r["line"]: r["low"] for r in rows}
    assert low["İstanbul ΟΔΟΣ ²x"] == ["i̇stanbul", "οδοσ", "²x"] and "get" in low["env=prod GET /api/users 200"]


def test_dedup_and_null(spark):
    rows = spark.createDataFrame([("error error ERROR",), (None,)], "line string").select(tokens("line").alias("t"), first_token("line").alias("f")).collect()
    assert [tuple(r) for r in rows] == [(["error"], "error"), ([], "")]


def test_query_chars_agree_with_lines(spark):
    """What the parser takes for a word, the tokenizer takes for one, also beyond ASCII."""
    text = "ΟΔΟΣ ÜBER"
    words = spark.createDataFrame([(text,)], "line string").select(token_list("line")).head()[0]
    assert [t.text for t in as_query(spark, text).children] == words == ["οδοσ", "über"]
    mark = "का"  # a vowel sign: alphabetic to the JVM, not to Python
    assert as_query(spark, mark) == Term(spark.createDataFrame([(mark,)], "line string").select(token_list("line")).head()[0][0])


def test_normalize(spark):
    prepare(spark)
    cases = {
        "hello world": "hello world",
        '"log line content"': "log line content",
        '{"level":"info","message":"user logged in"}': "user logged in",
        '{"@message":"cloudwatch line"}': "cloudwatch line",
        '{"foo":"bar"}': '{"foo":"bar"}',
        "not { json": "not { json",
        '["a","b"]': '["a","b"]',
        '{"message":1,"msg":"x"}': "x",
        '{"message":"a","message":"b"}': "b",
        '{"message":"m"} x': '{"message":"m"} x',
        '"a" "b"': '"a" "b"',
        '"a","b"': '"a","b"',
        '"a"],["b"': '"a"],["b"',
        '"a","v":"b"': '"a","v":"b"',
        '\t{"msg":"tab"}\n': "tab",
        "null": "null",
        "1": "1",
        '  "ab"  ': "ab",
        '""': "",
        "": "",
        '{"text":"t","log":"l"}': "l",
        '{"message":null,"log":"l"}': "l",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", normalize_line("raw").alias("line")).collect()
    assert {r["raw"]: r["line"] for r in rows} == cases


def test_bodies(spark):
    bodies = spark.createDataFrame([(json.dumps(["a", "", "x\ny"]),), ('{"no": 1}',), ("[1",)], "body string")
    assert [r[0] for r in from_array_body(bodies).collect()] == ["a", "", "x\ny"]
    grams = spark.createDataFrame([(bytearray(b"udp_gamma line\r\n\nudp_delta \xff line\r\r\n"),)], "payload binary")
    assert [r[0] for r in from_datagrams(grams).collect()] == ["udp_gamma line", "udp_delta � line"]
    text = spark.createDataFrame([("a\n\nb",)], "payload string")
    assert [r[0] for r in from_datagrams(text).select(F.col("line")).collect()] == ["a", "b"]
