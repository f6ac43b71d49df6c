import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sievelog.llm import common, simhash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Smallest member of each one's component at three bits, by comparing all with all."""
    label = np.arange(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    while True:
        new = np.where(near, label[None, :], len(prints)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_query(spark, tables):
    docs = {r["doc_id"]: r["text"] for r in common.table(spark, tables, "documents").collect()}
    rows = {r["doc_id"]: r for r in simhash.op5_simhash(spark, tables).collect()}
    ids = sorted(docs)
    prints = np.array([fingerprint(docs[i]) for i in ids], np.uint64)
    assert [rows[i]["fingerprint"] for i in ids] == [f"{p:016x}" for p in prints.tolist()]
    assert [rows[i]["component_id"] for i in ids] == [ids[c] for c in classes(prints)]


def crowd(rng, n):
    """Fingerprints in tight heaps and chains, among others."""
    out = []
    for _ in range(n):
        out.append(rng.getrandbits(64) if not out or rng.random() < 0.2 else rng.choice(out) ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 5))}))
    return sorted(set(out))


def test_linking_loses_nothing(spark, monkeypatch):
    rng = random.Random(9)
    for chunk, visitors in ((2048, 1 << 15), (3, 1 << 15), (2, 5), (100, 4)):  # small ones make nearly every anchor crowded
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        monkeypatch.setattr(simhash, "VISITORS", visitors)
        prints = np.array(crowd(rng, 400), np.uint64)
        df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
        common.ship(spark)
        linked = {r["node"]: r["root"] for r in simhash.link(df, common.Scratch(spark, "t")).collect()}
        label = classes(prints)
        own = [linked.get(int(p), int(p)) for p in prints.view(np.int64)]
        for i in range(len(own)):
            assert all((own[i] == own[j]) == (label[i] == label[j]) for j in range(i))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    empty = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert {r["component_id"] for r in empty} == {0} and {r["doc_id"] for r in empty} == {0, 1, 2, None}
    assert {r["component_id"] for r in rows if r["doc_id"] in (8, 9)} == {8}
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 9 not in ids and 1 not in ids and {0, 3, 8, None} <= set(ids)
    assert [r["text"] for r in kept.filter("doc_id is null").collect()] == ["no id"]
    loose = odd_docs.withColumn("doc_id", F.lit(None).cast("long"))
    texts = [fingerprint(r["text"]) for r in simhash.keep_one(loose).collect()]
    assert len(set(texts)) == len(texts) == len({r["fingerprint"] for r in rows})
