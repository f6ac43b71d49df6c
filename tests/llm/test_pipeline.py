import re
import sys
from pathlib import Path

import public_tokenizers
import sentencepiece

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as cp  # noqa: E402
from sievelog.llm import common, mixing, quality, substrings  # noqa: E402


def one_of_each(texts):
    """The least id of each group at five-word similarity 0.8, by comparing all texts with all."""
    sets = {}
    for i, text in texts.items():
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets[i] = {tuple(words[a : a + 5]) for a in range(max(1, len(words) - 4))} if words else set()
    label = {i: i for i in texts}
    links = [(i, j) for i in texts for j in texts if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0)]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return sorted(i for i in texts if label[i] == i)


def test_stages(spark, tables):
    """Each stage by the whole-table operator it stands for, and the last by the library."""
    docs = common.table(spark, tables, "documents")
    scratch = common.Scratch(spark, "t")
    labels = common.table(spark, tables, "labels")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "simhash", "substring", "mixing", "sentencepiece"]
    now = {"": docs}
    at = docs
    for name, stage in cp.STAGES:
        at = now[name] = scratch.save(stage(spark, at, tables), name)
        if name != names[-1]:
            assert at.dtypes == docs.dtypes
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    good = [r["doc_id"] for r in quality.score(docs, labels).filter("predicted = 1").collect()]
    assert ids(now["quality"]) == sorted(good) and 0 < len(good) < docs.count()
    assert ids(now["simhash"]) == one_of_each({r["doc_id"]: r["text"] for r in now["quality"].collect()})
    kept = {r["doc_id"]: r for r in substrings.dedup_substrings(now["simhash"]).collect()}
    before = {r["doc_id"]: r["text"] for r in now["simhash"].collect()}
    for r in now["substring"].collect():
        assert r["text"] == (kept[r["doc_id"]]["kept"] if kept[r["doc_id"]]["n_removed"] else before[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    assert ids(now["substring"]) == ids(now["simhash"])
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(now["substring"]).collect()}
    assert ids(now["mixing"]) == sorted(i for i, n in copies.items() for _ in range(n))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in now["substring"].collect()}
    for r in now["sentencepiece"].collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


def test_run(spark, tables):
    rows = cp.run(spark, tables)
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and rows.count() > 100


def test_odd_rows(spark, odd_docs, no_docs, tables):
    docs = common.table(spark, tables, "documents")
    for extra in (odd_docs.select(docs.columns), no_docs.select(docs.columns)):
        at = docs.filter("doc_id >= 100").unionByName(extra)
        for name, stage in cp.STAGES:
            at = common.Scratch(spark, "t").save(stage(spark, at, tables), name)
        assert at.count() > 0
    at = no_docs.select(docs.columns)
    for name, stage in cp.STAGES:
        at = common.Scratch(spark, "t").save(stage(spark, at, tables), name)
    assert at.count() == 0
