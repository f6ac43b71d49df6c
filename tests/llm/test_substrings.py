import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelog.llm import common, substrings as ss


def brute(rows):
    """doc_id, n_words, n_removed, digest of each row, window by window."""
    first, words = {}, [(t or "").encode().split() for _, t in rows]
    order = [ss.LAST if i is None else i for i, _ in rows]
    for i, w in zip(order, words):
        for a in range(len(w) - 49):
            k = tuple(w[a : a + 50])
            first[k] = min(first.get(k, i), i)
    out = []
    for (doc, _), i, w in zip(rows, order, words):
        gone = [False] * len(w)
        for a in range(len(w) - 49):
            if first[tuple(w[a : a + 50])] < i:
                gone[a : a + 50] = [True] * 50
        out.append((doc, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


def corpus(rng, n=300):
    def some(k, v):
        return [f"w{rng.randrange(v)}" for _ in range(k)]

    passages, base, rows = [some(rng.choice([50, 51, 60, 80, 200]), 1000) for _ in range(8)], some(400, 50), []
    for i in range(n):
        t = []
        for _ in range(rng.randrange(4)):
            q = rng.choice(passages)
            t += some(rng.randrange(80), 1000) + (q if rng.random() < 0.6 else q[rng.randrange(20) :])
        if rng.random() < 0.3:
            edited = list(base)
            edited[rng.randrange(400)] = "x"
            t += edited
        if rng.random() < 0.1:
            t += ["again"] * rng.randrange(200)
        rows.append((i * 7 % (n + 1), rng.choice([" ", "\n", "  "]).join(t)))
    return rows


@pytest.mark.parametrize("crowded", [64, 2, 1])
def test_against_windows(spark, monkeypatch, crowded):
    monkeypatch.setattr(ss, "MAX_VARIANTS", crowded)
    rows = corpus(random.Random(crowded))
    want = brute(rows)
    assert found(ss.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), digest=True)) == want
    assert 0 < sum(r[2] for r in want) < sum(r[1] for r in want)


def test_automata_alone_give_the_whole_result(spark, tables, monkeypatch):
    """With every cell streamed for itself nothing changes; with automata that find nothing, nothing is removed."""
    rows = corpus(random.Random(9), 150) + [(r["doc_id"] + 1000, r["text"]) for r in common.table(spark, tables, "documents").collect()]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute(rows)
    assert found(ss.dedup_substrings(docs, digest=True, once=False)) == want
    empty = ss._SPANS.empty_table().to_batches()
    monkeypatch.setattr(ss, "_shards", lambda batches: (x for b in batches for x in empty))
    assert sum(r[2] for r in found(ss.dedup_substrings(docs, digest=True))) == 0


def test_texts_whose_short_hashes_agree(spark):
    """Two rows without an id whose 32-bit hashes are the same: each keeps its own words."""
    texts = spark.range(400_000).selectExpr("concat('t', id, ' ', repeat('same words go here ', 15)) AS t").selectExpr("t", "hash(xxhash64(t)) AS h")
    twins = texts.groupBy("h").agg({"t": "collect_list"}).toDF("h", "ts").filter("size(ts) = 2").head()["ts"]
    plain = "one " + " ".join(f"w{i}" for i in range(60))
    rows = [(1, twins[0]), (None, twins[0]), (None, twins[1] + ""), (None, plain), (2, "a " + plain[4:])]
    assert found(ss.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), digest=True)) == brute(rows)


def test_equal_rows_give_equal_results(spark):
    rows = [(1, "x " * 60)] + [(5, "x " * 60 + " y" * 70)] * 40 + [(None, "y " * 55)] * 30
    assert found(ss.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), digest=True)) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=6), st.lists(st.integers(0, 2), max_size=40), st.integers(1, 8))
def test_matching_statistics(references, text, least):
    automaton = ss.Automaton()
    for r in references:
        automaton.add(r)
    covered = set()
    for a in range(len(text) - least + 1):
        if any(text[a : a + least] == r[i : i + least] for r in references for i in range(len(r) - least + 1)):
            covered |= set(range(a, a + least))
    assert {i for a, b in automaton.spans(text, least) for i in range(a, b)} == covered


def test_query(spark, tables):
    docs = [(r["doc_id"], r["text"]) for r in common.table(spark, tables, "documents").collect()]
    assert found(ss.op7_substrings(spark, tables).withColumnRenamed("kept_sha256", "kept")) == brute(docs)


def test_odd_rows(spark, odd_docs, no_docs):
    assert found(ss.dedup_substrings(odd_docs, digest=True)) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert ss.dedup_substrings(no_docs).count() == 0
    long = "a b c d e " * 20
    docs = odd_docs.unionByName(odd_docs.sparkSession.createDataFrame([(200, long), (201, "Z " + long + "\n y"), (None, long)], "doc_id long, text string"), allowMissingColumns=True)
    kept = ss.remove_substrings(docs)
    assert kept.dtypes == docs.dtypes and kept.count() == docs.count()
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.filter("doc_id > 100 or doc_id = 8").collect()}
    assert texts[200] == (long, len(long)) and texts[201] == ("Z y", 3) and texts[8][0] == "the same text twice over"
    assert kept.filter("doc_id is null and text = ''").count() == 1
    assert ss.remove_substrings(no_docs).count() == 0
