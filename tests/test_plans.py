import random

from pyspark.sql import functions as F

from sievelog.functions.text import tokens
from sievelog.operators.blocks import assign_blocks, block_metadata, number_lines
from sievelog.operators.postings import block_lists, coded_size, deltas, dictionary, postings, undelta
from sievelog.operators.search import SearchResult, matching, response, term_count, term_lines
from sievelog.plans import compile
from sievelog.plans.compile import from_lists, from_postings, predicate
from sievelog.plans.query import And, Not, Or, Term, matches


def tree(rng, depth=3):
    kind = rng.choice("tttaon") if depth else "t"
    if kind == "t":
        return Term(rng.choice(["a", "b", "c", "d", "zzz", ""]))
    if kind == "n":
        return Not(tree(rng, depth - 1))
    return (And if kind == "a" else Or)(tuple(tree(rng, depth - 1) for _ in range(rng.randrange(4))))


def test_three_plans_agree_with_sets(spark):
    """Random queries over random lines: tokenizing, stored tokens, postings and a model in plain sets."""
    rng = random.Random(4)
    held = [{w for w in "abcd" if rng.random() < 0.4} for _ in range(200)] + [set()] * 5
    lines = spark.createDataFrame([(0, i, " ".join(sorted(t)).upper()) for i, t in enumerate(held)], "block_id long, line_id int, line string")
    stored = lines.withColumn("tokens", tokens("line")).cache()
    index = postings(stored, ["block_id", "line_id"]).cache()
    lists = block_lists(stored).cache()
    ids = lambda df: sorted(r["line_id"] for r in df.select("line_id").collect())
    for _ in range(25):
        q = tree(rng)
        want = [i for i, t in enumerate(held) if matches(q, t)]
        assert ids(matching(lines, q)) == ids(stored.filter(predicate(q, F.col("tokens")))) == ids(from_postings(q, index, stored)) == want, str(q)
        assert sorted(i for r in from_lists(q, lists).collect() for i in r["ids"]) == want, str(q)


def test_deep_queries_run_as_programs(spark, monkeypatch):
    """The machine for trees of any depth, on trees that the plain way can check."""
    monkeypatch.setattr(compile, "DEEP", 1)
    rng = random.Random(5)
    held = [{w for w in "abcd" if rng.random() < 0.4} for _ in range(60)] + [set()]
    stored = spark.createDataFrame([(i % 2, i // 2, " ".join(sorted(t))) for i, t in enumerate(held)], "block_id long, line_id int, line string").withColumn("tokens", tokens("line")).cache()
    lists = block_lists(stored).cache()
    for _ in range(10):
        q = tree(rng)
        want = sorted((i % 2, i // 2) for i, t in enumerate(held) if matches(q, t))
        got = lambda df: sorted((r["block_id"], r["line_id"]) for r in df.collect())
        assert got(matching(stored, q)) == got(stored.filter(predicate(q, F.col("tokens")))) == want, str(q)
        assert sorted((r["block_id"], i) for r in from_lists(q, lists).collect() for i in r["ids"]) == want, str(q)


def test_terms_are_tokenized_once(spark):
    lines = spark.createDataFrame([(0, 0, "a b")], "block_id long, line_id int, line string")
    plan = postings(lines.withColumn("tokens", tokens("line")), ["block_id", "line_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1, plan


def test_pushdown(spark, tmp_path):
    spark.createDataFrame([("a", 0, 1), ("b", 0, 2)], "term string, block_id long, line_id int").write.parquet(str(tmp_path / "p"))
    index = spark.read.parquet(str(tmp_path / "p"))
    plan = from_postings(And((Term("a"), Term("b"))), index, index.select("block_id", "line_id"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [a,b])" in plan.replace("IsNotNull(term), ", "")


def test_blocks(spark):
    lines = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("line")).repartition(7)
    placed = assign_blocks(number_lines(lines, ["k"]), 300, 100)
    rows = {r["k"]: (r["block_id"], r["line_id"], r["pack_id"]) for r in placed.collect()}
    assert rows == {k: (k // 300, k % 300, k % 300 // 100) for k in range(1000)}
    meta = {r["block_id"]: (r["num_lines"], r["num_packs"]) for r in block_metadata(placed, 100).collect()}
    assert meta == {0: (300, 3), 1: (300, 3), 2: (300, 3), 3: (100, 1)}
    assert block_metadata(placed, 100).agg(F.sum("data_size")).head()[0] == sum(len(f"é{k}".encode()) for k in range(1000))
    assert number_lines(lines.limit(0), ["k"]).count() == 0


def test_posting_codes(spark):
    index = spark.createDataFrame([("one", 42)] + [("two", 2 * i) for i in range(130)] + [("three", 3 * i + 1) for i in range(500)], "term string, id long")
    entries = {r["term"]: (r["num_ids"], r["num_chunks"]) for r in dictionary(index, []).collect()}
    assert entries == {"one": (1, 1), "two": (130, 2), "three": (500, 4)}
    coded = deltas(index, ["term"], "id").withColumnRenamed("id", "place")
    assert undelta(coded, ["term"], "place").select("term", "id").exceptAll(index).count() == 0
    sizes = {r["term"]: r["bytes"] for r in coded_size(index, ["term"], "id").collect()}
    # A byte and sixteen for each bit of a full chunk's largest delta; a byte, a count of four and varints for the rest.
    assert sizes == {"one": 5 + 1, "two": (1 + 16 * 2) + (5 + 2), "three": 3 * (1 + 16 * 2) + (5 + 116)}
    assert coded_size(spark.createDataFrame([("x", 127), ("x", 127 + 128)], "term string, id long"), ["term"], "id").head()["bytes"] == 5 + 3
    assert coded_size(spark.createDataFrame([("x", i) for i in range(127)] + [("x", 5000)], "term string, id long"), ["term"], "id").head()["bytes"] == 1 + 16 * 13


def test_response(spark):
    lines = spark.createDataFrame([(i, f"error line {i}") for i in range(1, 11)] + [(11, "fine")], "n long, line string")
    found = SearchResult(matching(lines, "error"), ["n"], 3)
    assert found.total == 10 and found.lines() == ["error line 1", "error line 2", "error line 3"]
    assert response(found, "error").head().asDict() == {"query": "error", "count": 3, "total": 10, "results": found.lines()}
    held = lines.withColumn("tokens", tokens("line"))
    assert term_count(held, "error", F.col("tokens")).head()[0] == 10
    assert term_lines(held, "error", F.col("tokens"), ["n"], 2).lines() == ["error line 1", "error line 2"]
    none = response(SearchResult(matching(lines, "nothing"), ["n"], 3), "nothing").head()
    assert (none["count"], none["total"], none["results"]) == (0, 0, [])
