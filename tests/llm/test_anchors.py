"""The near-duplicate stage takes its candidates from SimHash fingerprints by anchors."""

import random

import numpy as np
import pytest

import corpus_pipeline as cp
from sievelog.llm import shingles
from test_shingles import brute, family


def made_sets(rng, pairs):
    """Sets one after the other, of (size, size, common) each two."""
    out = []
    for a, b, both in pairs:
        values = rng.integers(0, 1 << 64, a + b - both, np.uint64)
        out += [values[:a], np.concatenate([values[:both], values[a:]])]
    return np.concatenate(out), np.array([len(v) for v in out])


def test_votes_and_homes_by_definition():
    x, sizes = made_sets(np.random.default_rng(1), [(3, 4, 2), (40, 30, 20)])
    counted = shingles.votes(x, sizes, 5)
    odd = int(np.random.default_rng([shingles.SEED, 5]).integers(0, 1 << 64, dtype=np.uint64)) | 1
    at = 0
    for i, n in enumerate(sizes.tolist()):
        hashed = [int(v) * odd % (1 << 64) for v in x[at : at + n]]
        at += n
        for b in range(0, shingles.BITS, 37):
            ones = sum((h >> 53 & 1) ^ ((h >> 54 & b).bit_count() & 1) for h in hashed)
            assert counted[i, b // shingles.HALF, b % shingles.HALF] == n - 2 * ones
    moved = (shingles._MOVED < 0).tolist()
    words = [[(b & j).bit_count() & 1 ^ moved[b] ^ flip for b in range(shingles.HALF)] for j in range(shingles.HALF) for flip in (1, 0)]
    for half, home in zip(counted.reshape(-1, shingles.HALF)[::5], shingles.homes(counted).ravel()[::5]):
        agree = [sum(-v if bit else v for v, bit in zip(half.tolist(), word)) for word in words]
        assert agree[home] == max(agree)


@pytest.mark.parametrize("pair", [(4, 5, 4), (9, 9, 8), (8, 10, 8), (180, 180, 160)])
def test_texts_at_four_fifths_meet(pair):
    x, sizes = made_sets(np.random.default_rng(2), [pair] * 300)
    n_tables, bits = shingles.tables(1000)
    anchors = shingles.fingerprints(x, sizes, n_tables, bits)
    same = anchors[0::2] == anchors[1::2]
    assert 0.15 < same.mean() and (1 - same.mean()) ** n_tables < 1e-5 and same.any(axis=1).all()
    check = shingles.checking(x, sizes)
    assert (np.bitwise_count((check[0::2] ^ check[1::2]).view(np.uint64)).sum(axis=1) <= shingles.DIFFER).mean() > 0.99


def test_more_texts_have_more_fingerprints_of_finer_anchors():
    assert shingles.tables(1) == shingles.tables(1 << 22) == (72, 0)
    n_tables, bits = shingles.tables(1 << 24)
    assert bits == 2 and n_tables > 72
    x, sizes = made_sets(np.random.default_rng(3), [(90, 90, 80)] * 100)
    same = shingles.fingerprints(x, sizes, n_tables, bits)
    assert (same[0::2] == same[1::2]).any(axis=1).all()


def test_groups_at_anchors(monkeypatch):
    rng = np.random.default_rng(4)
    spot, check = rng.integers(0, 40, 400), rng.integers(0, 1 << 63, (400, 2))
    check[200:] = check[:200] ^ 1
    spot[200:] = spot[:200]
    for crowd in (2048, 12):
        monkeypatch.setattr(shingles, "CROWD", crowd)
        own, key = shingles.meet(spot, np.arange(400), check)
        groups = {}
        for o, k in zip(own.tolist(), key.tolist()):
            groups.setdefault(k, set()).add(o)
        together = {frozenset(g) for g in groups.values()}
        want = {frozenset([i, i + 200]) if (spot == spot[i]).sum() <= crowd else frozenset(np.flatnonzero(spot == spot[i]).tolist()) for i in range(200)}
        assert together == want


def test_stage_goes_by_anchors(spark, tables, monkeypatch):
    """The stage keeps one of each component, also where all anchors are crowded; where nothing meets, it only sees equal sets."""
    rng = random.Random(6)
    texts = [t for n in (12, 6, *[2] * 8) for t in family(rng, n)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = lambda: sorted(r["doc_id"] for r in cp.simhash_stage(spark, docs, tables).collect())
    want = [i for i, c in enumerate(brute(texts)) if i == c]
    assert kept() == want
    plain = shingles._meet

    def crowded(batches):
        before, shingles.CROWD = shingles.CROWD, 1
        yield from plain(batches)
        shingles.CROWD = before

    def nothing(batches):
        for batch in batches:
            yield batch.slice(0, 0).select(["own", "spot"]).rename_columns(["own", "key"])

    monkeypatch.setattr(shingles, "_meet", crowded)
    assert kept() == want
    monkeypatch.setattr(shingles, "_meet", nothing)
    assert len(kept()) == len(set(texts)) > len(want)
