import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from sievelog.llm import common, pieces

ROOT = Path(__file__).resolve().parents[2]
FILE = public_tokenizers.path("piece_bpe_32k.model")


def test_as_the_library():
    encoder, library = pieces.Encoder(FILE), sentencepiece.SentencePieceProcessor(model_file=FILE)
    rng = random.Random(2)
    parts = [*"abcAZ09.,'!-<|>& \t\n\r\0 ", "the", "ing", " of", "  ", "▁", "é", "中", "한", "\U0001f600", "<s>", "<0x0A>", "<unk>", "　", "ａ", "const", "......", "-----", ");\r"]
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(20)] + [None]
        ids, counts = encoder.encode(texts)
        for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
            assert own.tolist() == (library.encode(text) if text else [])
        assert encoder.decode(ids, counts) == [(t or "").replace("▁", " ") for t in texts]


def test_long_segments():
    encoder, library = pieces.Encoder(FILE), sentencepiece.SentencePieceProcessor(model_file=FILE)
    rng = random.Random(3)
    parts = ["a", "b", "the", "ing", "é", "中", "xx", ".", "-", "ation", "q"]
    texts = ["".join(rng.choice(parts) for _ in range(n)) for n in (30, 40, 300, 3000)] + [" " * 1000, "a" * 5000, "=" * 777]
    ids, counts = encoder.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t) for t in texts]


def test_windows_of_long_segments(monkeypatch):
    """Cut where no piece leads across, or not at all: as the library encodes the whole."""
    model, library = pieces.Model(FILE), sentencepiece.SentencePieceProcessor(model_file=FILE)
    rng = random.Random(4)
    parts = ["a", "b", "the", "ing", "é", "\U0001f600", "xx", ".", "ation", "q", "한"]
    for window in (8, 20, 100):
        monkeypatch.setattr(pieces, "WHOLE", window)
        for n in (1, 7, 60, 400):
            text = "".join(rng.choice(parts) for _ in range(n))
            assert pieces.encode_long(pieces.MARK + text, model).tolist() == library.encode(text)
    monkeypatch.setattr(pieces, "WHOLE", 30)
    monkeypatch.setattr(pieces, "TOGETHER", 50)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(50)]
    ids, counts = pieces.encode_all([pieces.MARK + t for t in texts], model)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1]) if len(x) > 1] == [library.encode(t) for t in texts if len(library.encode(t)) > 1]


def test_memory_of_a_long_segment():
    """Two million characters without a space, in a process of its own: bounded bytes a character, and as the library has it."""
    code = f"""
import resource, sentencepiece
from sievelog.llm import pieces
e = pieces.Encoder({FILE!r}); e.encode(["warm up"])
text = "unbroken" * 125_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
ids, _ = e.encode([text])
used = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
assert ids.tolist() == sentencepiece.SentencePieceProcessor(model_file={FILE!r}).encode(text)
print(used * 1024 // len(text))
"""
    ran = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert ran.returncode == 0 and int(ran.stdout) < 320, ran.stdout + ran.stderr


def test_codes_forget_long_words_and_rare_ones():
    """Whatever is forgotten, codes stay right; long words are never kept."""
    rng, codes = random.Random(1), common.Codes(50, np.int32)
    learn = lambda ws: (np.array([b for w in ws for b in w], np.int32), np.array(list(map(len, ws)), np.int64))
    for _ in range(200):
        words = [bytes(rng.choice(b"abc") for _ in range(rng.choice([1, 2, 3, 64, 65, 200]))) for _ in range(rng.randrange(30))]
        ids, lengths = codes.look_up(words, learn)
        assert ids.tolist() == [b for w in words for b in w] and lengths.tolist() == list(map(len, words))
        assert all(len(w) <= codes.LONGEST for w in codes.numbers) and len(codes.uses) == len(codes.numbers)
    assert len(codes.ids) < 1 << 18


def test_models_of_another_kind_are_refused():
    from sievelog.llm import token_files

    assert token_files.splits_at_space(public_tokenizers.path("word_bpe_49k.json")) and not token_files.splits_at_space(public_tokenizers.path("byte_bpe_50k.json"))
    other, library = token_files.WordEncoder(public_tokenizers.path("byte_bpe_50k.json")), __import__("tokenizers").Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Two  WORDS", "", "é!"]
    raw = [t.encode() for t in texts]
    ids, counts = other.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, raw)))]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_occurrences():
    """All places of all pieces, against plain search."""
    rng = random.Random(5)
    text = "".join(rng.choice("abc\0") for _ in range(300))
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6))) for _ in range(80)})
    grid = np.zeros((len(words), 5), np.uint32)
    for i, w in enumerate(words):
        grid[i, : len(w)] = [ord(c) for c in w]
    row, place = pieces.occurrences(np.array([ord(c) for c in text], np.uint32), grid, np.array([len(w) for w in words]))
    want = {(i, p) for i, w in enumerate(words) for p in range(len(text)) if text.startswith(w, p)}
    assert set(zip(row.tolist(), place.tolist())) == want and len(row) == len(want)


def test_query(spark, tables):
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    texts = {r["doc_id"]: r["text"] for r in common.table(spark, tables, "documents").collect()}
    rows = pieces.op10_sentencepiece(spark, tables).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(library.encode(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_crc32"], r["decoded_chars"], r["round_trip"]) == (len(ids), zlib.crc32(ids.tobytes()), len(texts[r["doc_id"]]), True)


def test_odd_rows(spark, odd_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    docs = odd_docs.withColumn("decoded", F.lit("other"))  # ids and decoded are replaced
    coded = pieces.encode(docs, FILE)
    again = pieces.decode(coded, FILE)
    assert sorted(again.columns) == sorted(docs.columns)
    rows = again.collect()
    assert len(rows) == odd_docs.count() and set(odd_docs.columns) <= set(coded.columns)
    for r in rows:
        if r["text"] is None:
            assert r["ids"] is None and r["decoded"] is None
        else:
            assert r["ids"] == library.encode(r["text"]) and r["decoded"] == r["text"].replace("▁", " ")
    assert pieces.encode(no_docs, FILE).count() == 0
