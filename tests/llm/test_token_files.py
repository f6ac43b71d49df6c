import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievelog.llm import common, token_files as tf

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 5, 255, 256, 257, 5000])
@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 2**40, 2**52 + 1, 2**62, 2**64 - 1])
def test_round_trip(n, high):
    values = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64, endpoint=True)
    words, blocks = tf.pack(values)
    assert (tf.unpack(words) == values).all() and len(blocks) == -(-n // tf.BLOCK)
    for i in range(0, len(blocks), 7):
        assert (tf.unpack_blocks(words, blocks, i, i + 1) == values[i * tf.BLOCK : (i + 1) * tf.BLOCK]).all()


def test_mixed_sizes():
    rng = np.random.default_rng(3)
    values = (rng.integers(0, 2**64 - 1, 4000, dtype=np.uint64) >> rng.integers(0, 64, 4000).astype(np.uint64)).astype(np.uint64)
    values[rng.random(4000) < 0.3] = 0
    assert (tf.unpack(tf.pack(values)[0]) == values).all()


def test_words_encode_as_whole_texts():
    """Splitting at white space and simplifying change no id, whatever the characters."""
    encoder, whole = tf.WordEncoder(FILE), Tokenizer.from_file(FILE)
    rng = random.Random(1)
    parts = ["\x01", *"abAZ09.,'!-<|>& \t\n", "'s", "'T", "<|endoftext|>", "<|startoftext|>", "é", "É", "ß", "İ", "Σ", "́", "̱", "…", "¡", "中", "한", "\xa0", " ", "K", "ǅ", "x̸", "≮", "H̱", "T̈"]
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(20)]
        raw = [t.encode() for t in texts]
        ids, counts = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
            assert whole.encode(text, add_special_tokens=False).ids == own.tolist()


def brute(rows):
    whole, at, out = Tokenizer.from_file(FILE), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_query(spark, tables):
    docs = common.table(spark, tables, "documents")
    assert found(tf.op2_token_files(spark, tables)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    path = f"file://{tmp_path}/files"
    tf.write_token_files(odd_docs, path, FILE)
    assert found(tf.digest_token_files(spark, path)) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    back = {r["doc_id"]: r["ids"] for r in tf.read_token_files(spark, path).collect()}
    assert back[1] == [2] and back[3][-1] == 2
    tf.write_token_files(no_docs, path + "0", FILE)
    assert found(tf.digest_token_files(spark, path + "0")) == []


def test_codes_forget_and_learn_again():
    """However few words are remembered, the codes are the same."""
    rng = random.Random(6)
    learnt = []

    def learn(words):
        learnt.extend(words)
        return np.array([c for w in words for c in w], np.uint32), np.array(list(map(len, words)), np.int64)

    codes = common.Codes(40, np.uint32)
    for _ in range(60):
        words = [b"w%d" % int(rng.paretovariate(0.7)) if rng.random() < 0.9 else b"" for _ in range(rng.randrange(50))]
        ids, lengths = codes.look_up(words, learn)
        assert ids.tolist() == [c for w in words for c in w] and lengths.tolist() == list(map(len, words))
    assert len(codes.numbers) <= 90 and learnt.count(b"w1") == 1 and len(learnt) > len(set(learnt))
