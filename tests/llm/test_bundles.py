"""Texts of a family that meet at many fingerprints are compared as one bundle, and no pair of theirs is left out."""

import random

import numpy as np
import pytest

import corpus_pipeline as cp
from sievelog.llm import common, shingles
from test_shingles import brute, family


def test_groups_add_to_the_bundle_with_most_members():
    groups = {11: [1, 2, 3], 12: [1, 4, 5, 6], 13: [6, 7], 14: [1, 2]}
    bundle = {1: -50, 2: -50, 4: 60, 5: 60}
    rows = sorted((k, o) for k, g in groups.items() for o in g)
    key, own = np.array(rows).T
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    of = np.array([bundle.get(o, 0) for o in own.tolist()])
    own, key = shingles.beside(own, key, start, np.diff(np.append(start, len(key))), of)
    assert sorted(zip(own.tolist(), key.tolist())) == [(1, 60), (3, -50), (6, 13), (6, 60), (7, 13)]


@pytest.mark.parametrize("few, small, wider, fine", [(8, 64, 4, 200), (8, 64, 1e9, 1 << 15), (8, 0, 0, 1 << 15), (1, 2, 1e9, 200)])
def test_a_family_is_few_rows(spark, tables, monkeypatch, few, small, wider, fine):
    for name, value in (("FEW", few), ("SMALL", small), ("WIDER", wider), ("FINE", fine)):
        monkeypatch.setattr(shingles, name, value)
    rng = random.Random(12)
    texts = [t for n in (150, 20, *[2] * 10, *[1] * 10) for t in family(rng, n)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, plain = {}, common.Scratch.save

    def save(self, df, name):
        out = plain(self, df, name)
        made[name] = out.count() if name in ("spots", "left") else 0
        return out

    monkeypatch.setattr(common.Scratch, "save", save)
    assert sorted(r["doc_id"] for r in cp.simhash_stage(spark, docs, tables).collect()) == [i for i, c in enumerate(brute(texts)) if i == c]
    if wider and few > 1:
        assert made["spots"] < 2 * len(texts) and made.get("left", 0) < 2 * len(texts)
    if not wider:
        assert made["spots"] > 10 * len(texts)
