"""Token-id files: documents encoded whole, ids packed by Simple-8b into 64-bit words.

File format (version 1). A file set is a folder of Parquet containers, written by Spark's committer, so that a
lost or repeated task leaves no partial file and any store Spark can write to will do. Files are in ascending
doc_id order, and so are the rows in them. A row is a *pack* of whole documents:

    shard int, pack int      place of the pack: shards ascend, packs ascend within a shard
    doc_ids array<long>      documents in the pack, ascending
    n_tokens array<int>      ids of each document, its end id included
    block_words array<int>   word at which each block of BLOCK ids begins
    words binary             little-endian 64-bit words

A word's high four bits select (count, bits) of SELECTORS and the rest holds `count` ids of `bits` bits, first id
lowest. Selector 0 is the escape: the next word is one raw 64-bit value, for values of over 60 bits. Every block
begins at a word of its own, so blocks decode apart from each other, and all words of a pack decode at once.

Null and empty texts hold the end id alone. A very long text is encoded whole and makes a pack by itself. Rows that share
a doc_id are all kept, ordered by their texts; a null doc_id comes first. Equal rows give equal entries. An empty table
gives an empty file set. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the format: ids a word holds and the bits of each, by selector; 0 is the escape.
SELECTORS = [(1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
BLOCK = 256
END_ID = 2
#: Words whose ids a Python worker remembers, over tasks.
MEMORY = 400_000

_COUNT = np.array([c for c, _ in SELECTORS], np.int64)
_BITS = np.array([b for _, b in SELECTORS], np.uint64)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    if len(values) and values.max() >= 1 << 52:
        return sum(((values >> np.uint64(b)) > 0).astype(np.uint8) for b in range(64))
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words and the first word of each block. The selector that holds most is taken, in all blocks side by side."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    bits = np.concatenate([_bit_lengths(values), np.zeros(int(_COUNT.max()), np.uint8)])
    at = np.arange(0, n, block, dtype=np.int64)
    ends = np.minimum(at + block, n)
    owner = np.arange(len(at))
    begun, chosen, owners = [], [], []
    while len(at):
        choice = np.zeros(len(at), np.int64)
        lane, top, seen = np.arange(len(at)), np.zeros(len(at), np.uint8), 0
        for s in range(len(SELECTORS) - 1, 0, -1):  # what fits a selector fits those that hold less
            count, width = SELECTORS[s]
            for j in range(seen, count):
                top = np.maximum(top, bits[at[lane] + j])
            seen = count
            fits = (top <= width) & (at[lane] + count <= ends[lane])
            lane, top = lane[fits], top[fits]
            if not len(lane):
                break
            choice[lane] = s
        begun.append(at)
        chosen.append(choice)
        owners.append(owner)
        at = at + _COUNT[choice]
        left = at < ends
        at, ends, owner = at[left], ends[left], owner[left]
    begun, chosen, owners = map(np.concatenate, (begun, chosen, owners))
    order = np.argsort(begun, kind="stable")
    begun, chosen, owners = begun[order], chosen[order], owners[order]
    size = np.where(chosen == 0, 2, 1)
    where = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[where] = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(1, len(SELECTORS)):
        mine = chosen == s
        if mine.any() and SELECTORS[s][1]:
            i, w = begun[mine], where[mine]
            for j in range(SELECTORS[s][0]):
                words[w] |= values[i + j] << np.uint64(j * SELECTORS[s][1])
    raw = chosen == 0
    words[where[raw] + 1] = values[begun[raw]]
    first = np.concatenate([[True], owners[1:] != owners[:-1]])
    return words, where[first].astype(np.int32)


def unpack(words: np.ndarray) -> np.ndarray:
    """All values of a run of words. The words must begin at a block's first word."""
    words = np.ascontiguousarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == 0):  # raw words look like anything, so escapes are read in order
        if not raw[i] and i + 1 < len(words):
            raw[i + 1] = True
    kept = ~raw
    counts = _COUNT[selector[kept]]
    source = np.repeat(np.flatnonzero(kept), counts)
    slot = common.ragged(np.zeros(len(counts), np.int64), counts).astype(np.uint64)
    width = _BITS[selector[source]]
    escaped = selector[source] == 0
    width = np.where(escaped, np.uint64(0), width)
    out = (words[source] >> (slot * width)) & ((np.uint64(1) << width) - np.uint64(1))
    if escaped.any():
        out[escaped] = words[source[escaped] + 1]
    return out


def unpack_blocks(words: np.ndarray, block_words: np.ndarray, first: int, last: int) -> np.ndarray:
    """The values of blocks first to last (excluded) of a pack, without reading the others."""
    end = block_words[last] if last < len(block_words) else len(words)
    return unpack(words[block_words[first] : end])


#: ASCII by how it splits: letters 1, symbols 2, all else (digits, white space, the apostrophe, other bytes) 0.
MARK = "\x01"
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 2
_CLASS[[39, *range(48, 58)]] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def simplify(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with the same ids and fewer distinct words: A-Z in lower case, a space between ASCII letters and symbols.

    The tokenizer does both itself. Left as they are: texts with a combining mark (lead bytes CC and CD), as marks may
    compose with small letters only, and texts with "<|", which may begin a special token.
    """
    kinds = _CLASS[data]
    odd = (data == 0xCC) | (data == 0xCD)
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    if odd.any():
        for row in np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1):
            kinds[offsets[row] : offsets[row + 1]] = 0
    data = np.where(kinds == 1, _LOWER[data], data)
    cut = np.flatnonzero(kinds[:-1] + kinds[1:] == 3) + 1
    cut = cut[(kinds[cut] > 0) & (kinds[cut - 1] > 0)]
    return np.insert(data, cut, np.uint8(32)), offsets + np.searchsorted(cut, offsets, side="right")


#: What a tokenizer file must say of its normaliser and its splitter for words to be encoded one by one.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_space(tokenizer_file: str) -> bool:
    """Whether the file's normaliser and splitter are those that never look across white space and make capitals small."""
    with open(tokenizer_file, encoding="utf-8") as f:
        held = json.load(f)
    normalizers = (held.get("normalizer") or {}).get("normalizers") or []
    splitters = (held.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    replace = next((n for n in normalizers if n.get("type") == "Replace"), {})
    split = splitters[0]
    return [n.get("type") for n in normalizers] == _NORMALIZERS and (replace["pattern"], replace["content"]) == ({"Regex": r"\s+"}, " ") and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": _SPLIT}, "Removed", True)


class WordEncoder:
    """ids of whole texts through the tokenizers library, each distinct word encoded once.

    Where the file's normaliser and splitter never look across ASCII white space, a text's ids are those of its words
    one after the other. With any other file (`splits_at_space`), whole texts are encoded.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.whole = not splits_at_space(tokenizer_file)
        if self.whole:
            return
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        if len(mark) != 1:
            raise ValueError("this tokenizer has no token for the mark between words")
        self.mark = mark[0]
        self.codes = common.Codes(MEMORY, np.uint32)

    def _learn(self, fresh: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode words, many in one text, between marks that no word holds."""
        fresh = [w.decode() for w in fresh]
        if any(MARK in w for w in fresh):
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)]
            return np.concatenate(found), np.array(list(map(len, found)), np.int64)
        texts = [f" {MARK} ".join(fresh[i : i + 256]) + f" {MARK}" for i in range(0, len(fresh), 256)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(ids == self.mark)
        return ids[ids != self.mark], np.diff(ends, prepend=-1) - 1

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after the other, and the number of each row's."""
        if self.whole:
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.array(list(map(len, found)), np.int64)
        data, offsets = simplify(data, offsets)
        raw = data.tobytes()
        words = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        ids, lengths = self.codes.look_up([w for ws in words for w in ws], self._learn)
        return ids, common.per_row(words, lengths)


_encoders: dict[str, WordEncoder] = {}


def encoder(tokenizer_file: str) -> WordEncoder:
    """This worker's encoder; one at a time is kept, from task to task."""
    if tokenizer_file not in _encoders:
        _encoders.clear()
        _encoders[tokenizer_file] = WordEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


_PACK = pa.schema([("shard", pa.int32()), ("pack", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("block_words", pa.list_(pa.int32())), ("words", pa.binary())])
_PACK_DDL = "shard int, pack int, doc_ids array<long>, n_tokens array<int>, block_words array<int>, words binary"


def _write_packs(batches, tokenizer_file: str, end_id: int):
    number = 0
    for part in common.chunks(batches):
        ids, counts = encoder(tokenizer_file).encode(*common.utf8(part.column("text")))
        after = np.cumsum(counts)
        ids = np.insert(ids, after, np.uint32(end_id))
        words, block_words = pack(ids)
        yield pa.RecordBatch.from_pylist([{"shard": part.column("shard")[0].as_py(), "pack": number, "doc_ids": part.column("doc_id").to_pylist(), "n_tokens": (counts + 1).tolist(), "block_words": block_words.tolist(), "words": words.astype("<u8").tobytes()}], schema=_PACK)
        number += 1


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID) -> None:
    """Encode `text` of all rows and write the file set at `path`, in ascending doc_id order."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(2 * common.spread(rows), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt = dealt.withColumn("shard", F.spark_partition_id())
    packs = dealt.mapInArrow(lambda batches: _write_packs(batches, tokenizer_file, end_id), _PACK_DDL)
    packs.write.mode("overwrite").option("compression", "none").parquet(path)


def _digest(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(np.frombuffer(row["words"], "<u8")).astype("<u4")
            n = np.array(row["n_tokens"], np.int64)
            ends = np.cumsum(n)
            raw = ids.tobytes()
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([row["shard"]] * len(n), pa.int32()),
                    "pack": pa.array([row["pack"]] * len(n), pa.int32()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "in_pack": pa.array(ends - n, pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())], pa.int64()),
                }
            )


def _ids(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(np.frombuffer(row["words"], "<u8")).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(row["n_tokens"])]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))})


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document of a file set."""
    common.ship(spark)
    return spark.read.schema(_PACK_DDL).parquet(path).select("doc_ids", "n_tokens", "words").mapInArrow(_ids, "doc_id long, ids array<int>")


def digest_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, read from the files: doc_id, start, n_tokens, ids_crc32.

    Packs are laid end to end: a running sum over packs inside each shard, and one over shards (a row for each file).
    """
    common.ship(spark)
    packs = spark.read.schema(_PACK_DDL).parquet(path)
    from pyspark.sql import Window

    sizes = packs.select("shard", "pack", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inner = Window.partitionBy("shard").orderBy("pack")
    starts = sizes.select("shard", "pack", (F.sum("n").over(inner) - F.col("n")).alias("pack_start")).join(shards, "shard")
    rows = packs.select("shard", "pack", "doc_ids", "n_tokens", "words").mapInArrow(_digest, "shard int, pack int, doc_id long, in_pack long, n_tokens long, ids_crc32 long")
    found = rows.join(starts, ["shard", "pack"])
    return found.select("doc_id", (F.col("shard_start") + F.col("pack_start") + F.col("in_pack")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents through word_bpe_49k into a file set, and its digest as read back."""
    import public_tokenizers

    scratch = common.Scratch(spark, "tokens")
    write_token_files(common.table(spark, sf_dir, "documents"), scratch.path("files"), public_tokenizers.path("word_bpe_49k.json"))
    return digest_token_files(spark, scratch.path("files"))
