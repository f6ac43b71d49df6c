import base64
import random

import duckdb
import public_tokenizers
import pytest
import tiktoken

from sievelog.llm import common, rollup

VERSIONS = {"byte_bpe_50k": public_tokenizers.path("byte_bpe_50k.tiktoken"), "words": ""}


def counters():
    with open(VERSIONS["byte_bpe_50k"], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {"byte_bpe_50k": lambda t: len(coding.encode_ordinary(t or "")), "words": lambda t: len((t or "").encode().split())}


def totals(state, loose=()):
    out = {}
    for version, count in counters().items():
        for text, source, lang in [*state.values(), *loose]:
            k = (source, lang, version)
            docs, tokens = out.get(k, (0, 0))
            out[k] = (docs + 1, tokens + count(text))
    return out


def read(r):
    return {(x["source"], x["lang"], x["tokenizer"]): (x["docs"], x["tokens"]) for x in r.totals().collect() if x["docs"]}


SCHEMA = "doc_id long, text string, source string, lang string"


@pytest.mark.parametrize("every", [8, 1, 2])
def test_batches_of_changes(spark, tmp_path, every):
    """Inserts, revisions, deletes and repeated deliveries, against counting what is there."""
    rng, state = random.Random(1), {}
    r = rollup.TokenRollup(spark, f"file://{tmp_path}/counts", VERSIONS, buckets=3, snapshot_every=every)
    text = lambda: rng.choice([None, "", "one two", "The quick brown fox! " * rng.randrange(5), "É 中文"])
    for b in range(4):
        new = [(i, text(), rng.choice(["s1", "s2", None]), rng.choice(["en", None])) for i in rng.sample(range(30), 12)]
        gone = [(i,) for i in rng.sample(range(40), 5) if i not in {n[0] for n in new}]
        up, down = spark.createDataFrame(new, SCHEMA), spark.createDataFrame(gone, "doc_id long")
        assert r.apply(f"b{b}", up, down)
        state.update({n[0]: n[1:] for n in new})
        for (i,) in gone:
            state.pop(i, None)
        want = totals(state)
        assert read(r) == want
        assert not r.apply(f"b{b}", up, down) and read(r) == want
    assert len(r._standing()) <= every + 1 and len(r._names("snapshots")) == {8: 0, 1: 3, 2: 1}[every]
    assert r.batches() == ["b0", "b1", "b2", "b3"]
    with pytest.raises(ValueError):
        r.apply("a/b", up)
    again = rollup.TokenRollup(spark, f"file://{tmp_path}/counts", VERSIONS)
    assert read(again) == totals(state)


def test_only_touched_buckets_are_read(spark, tmp_path):
    r = rollup.TokenRollup(spark, f"file://{tmp_path}/counts", {"words": ""}, buckets=8)
    r.apply("all", spark.createDataFrame([(i, "a b", "s", "en") for i in range(100)], SCHEMA))
    r.apply("one", spark.createDataFrame([(5, "a b c", "s", "en")], SCHEMA))
    files = [f for f in r._ledger([int(n.rpartition("=")[2]) for n in (p.name for p in (tmp_path / "counts" / "batches" / "00000001-one" / "ledger").iterdir()) if n.startswith("bucket")]).inputFiles()]
    assert len({f.rpartition("/")[0].rpartition("/")[2] for f in files}) == 1 and r.totals().head()["tokens"] == 201
    assert r.snapshot() and r.totals().head()["tokens"] == 201 and r.apply("two", deletes=spark.createDataFrame([(5,), (999,)], "doc_id long"))
    assert r.totals().select("docs", "tokens", "docs_removed").head()[:] == (99, 198, 2)


def test_a_failed_batch_counts_nothing(spark, tmp_path, monkeypatch):
    r = rollup.TokenRollup(spark, f"file://{tmp_path}/counts", {"words": ""})
    rows = spark.createDataFrame([(1, "a b", "s", "en")], SCHEMA)
    bad = rollup.TokenRollup(spark, f"file://{tmp_path}/counts", {"none": "/no/such/file"})
    with pytest.raises(Exception):
        bad.apply("b", rows)
    assert r.batches() == [] and r.totals().count() == 0
    assert r.apply("b", rows) and r.totals().head()["tokens"] == 2


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    r = rollup.TokenRollup(spark, f"file://{tmp_path}/counts", VERSIONS)
    assert r.apply("empty", no_docs) and r.totals().count() == 0
    assert r.apply("odd", odd_docs) and r.apply("gone", deletes=no_docs)
    rows = [(x["doc_id"], x["text"], x["source"], x["lang"]) for x in odd_docs.collect()]
    assert read(r) == totals({x[0]: x[1:] for x in rows if x[0] is not None}, [x[1:] for x in rows if x[0] is None])


def test_queries(spark, tables):
    docs = {x["doc_id"]: (x["text"], x["source"], x["lang"]) for x in common.table(spark, tables, "documents").collect()}
    for i in [i for i in docs if i % 7 == 0]:
        text, source, lang = docs[i]
        docs[i] = (None if text is None else text + "\nsecond edition", None if source is None else source + " (revised)", None if i % 14 == 0 else lang)
    for x in common.table(spark, tables, "labels").filter("toxic = 1").collect():
        docs.pop(x["doc_id"], None)
    got = {(x["source"], x["lang"], x["tokenizer"]): (x["docs"], x["tokens"]) for x in rollup.op9_token_rollup(spark, tables).collect() if x["docs"]}
    assert got == totals(docs)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS FROM '{tables}/{t}.parquet'")
    mine = rollup.word_rollup(spark, tables)
    assert sorted(map(tuple, mine.collect())) == sorted(con.sql(f"SELECT {', '.join(mine.columns)} FROM ({rollup.ORACLE})").fetchall())
