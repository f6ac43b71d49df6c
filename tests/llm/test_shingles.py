import random

import numpy as np
import pytest

from sievelog.llm import shingles, simhash

WORDS = [f"w{i}" for i in range(400)]


def shingle_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(texts):
    """The first of each one's component at a Jaccard similarity of 0.8, by comparing all with all."""
    made, label = [shingle_set(t) for t in texts], list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(made):
        for j in range(i):
            b = made[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((top(i), top(j)))
                label[y] = x
    return [top(i) for i in range(len(texts))]


def family(rng, n):
    """Texts with a few words changed each, so that similarities lie on both sides of 0.8, and exact copies."""
    base, out = rng.choices(WORDS, k=rng.randrange(60, 200)), []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [shingles.BLOCK, 300])
def test_keep_one_finds_what_all_pairs_show(spark, monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    rng = random.Random(5)
    texts = [t for n in (60, 20, *[2] * 30, *[1] * 20) for t in family(rng, n)] + ["a b", "A  b", "a b c d", "a b c d e", "", None, " ", "x"]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [i for i, c in enumerate(brute(texts)) if i == c]
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == want
    bits = [r["doc_id"] for r in simhash.near_duplicates(docs).filter("doc_id = component_id").collect()]
    assert len(bits) > len(want)  # three bits of 64 leave near-duplicates


@pytest.mark.parametrize("slab, cells", [(shingles.SLAB, shingles.CELLS), (150, 400)])
def test_matrices_count_like_sets(monkeypatch, slab, cells):
    monkeypatch.setattr(shingles, "SLAB", slab)
    monkeypatch.setattr(shingles, "CELLS", cells)
    rng = random.Random(8)
    made = [{hash(s) for s in shingle_set(t)} for n in (25, 10, 1, 1) for t in family(rng, n)] + [{7}, {7}, {8}]
    sizes = np.array([len(s) for s in made])
    x, first = np.concatenate([np.array(sorted(s), np.int64) for s in made]), np.cumsum(sizes) - sizes
    rows, others = np.arange(0, len(made), 2), np.arange(0, len(made), 3)
    found = {(int(u), int(v)) for a, b in shingles.near(x, first, sizes, rows, others) for u, v in zip(a, b)}
    assert found == {(u, v) for u in rows.tolist() for v in others.tolist() if u != v and 5 * len(made[u] & made[v]) >= 4 * len(made[u] | made[v])}


def test_similarity_of_exactly_four_fifths(spark):
    base = [f"v{i}" for i in range(13)]  # 9 shingles; 10 with one word more, of which 8 to 9 are shared
    texts = [" ".join(base), " ".join(base[1:] + ["z"]), " ".join(base[:-1] + ["y", "u"])]
    assert [len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b)) for a, b in ((texts[0], texts[1]), (texts[0], texts[2]))] == [0.8, 8 / 11]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [0, 2]


def test_query_tables(spark, tables):
    """Components of the smallest tables, some of whose near-duplicates differ in 7 and 11 bits."""
    from sievelog.llm import common

    docs = common.table(spark, tables, "documents")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = [rows[i][0] for i, c in enumerate(brute([t for _, t in rows])) if i == c]
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == want
