"""Shared pieces of the training-data operators: scratch tables, code shipping, text buffers and hashes."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import shared_dir

#: A word, as the contracts define it: a maximal run of bytes other than space and 0x09-0x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Text bytes handled at a time inside a Python task; bounds its memory whatever the Arrow batch holds.
CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


_gathering: list[list["Scratch"]] = []


@contextmanager
def gathered():
    """Tables that operators make inside are dropped at the end, once what they return has been written elsewhere."""
    held: list[Scratch] = []
    _gathering.append(held)
    try:
        yield
    finally:
        _gathering.remove(held)
        for scratch in held:
            scratch.drop()
            atexit.unregister(scratch._quietly_drop_all)


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A lost executor costs no more than the tasks that read them. drop() removes one as soon as nothing
    reads it; what a returned DataFrame still reads goes when the driver ends, or with `gathered`.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/sievelog-{name}-{uuid.uuid4().hex[:12]}"
        for held in _gathering:
            held.append(self)
        atexit.register(self._quietly_drop_all)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name, df)

    def apart(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """Save what was grouped by the key of a join to come. Spark splits a skewed side of a join only if each side
        comes straight from an exchange, which a table read again does and an aggregate in the same stage doesn't. `files`: for tables of few rows.
        """
        return self.save(df if files is None else df.coalesce(files), name)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def _quietly_drop_all(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self.drop()
        except Exception:  # noqa: BLE001  the session may be gone by then
            pass


def in_order(df: DataFrame) -> DataFrame:
    """A table as read from its files, sorted as it was written: files by their number, rows by their place. What isn't
    read from files keeps the order it has. Spark itself deals files to tasks by size.
    """
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long")
    try:
        placed = df.select("*", number.alias("__file"), name.alias("__name"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return df
    return placed.orderBy("__file", "__name", "__row").drop("__file", "__name", "__row")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python tasks can import it anywhere."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * CHUNK_BYTES))  # texts are long; a batch of 10,000 needn't fit a worker
    if getattr(sc, "_sievelog_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="sievelog-"), "sievelog_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(target)
    sc._sievelog_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *cols: str) -> int:
    """Partitions for an exchange this module deals out itself: the session's own setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches, column: str = "text", limit: int = CHUNK_BYTES):
    """Slices of record batches whose texts hold about `limit` bytes; a longer text comes alone and whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    begins = inside[1:-1].astype(bool) & (inside[:-2] == 0)
    ends = inside[1:-1].astype(bool) & (inside[2:] == 0)
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = inside[1:-1][cut] == 1
    ends[cut - 1] = inside[1:-1][cut - 1] == 1
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(20, (n - 1).bit_length())
        have = np.full(size, base & _MASK, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


class Spans:
    """Hashes of any spans of a sequence, all at once: polynomial sums modulo 2**64, then mixed."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=self.sums[1:])
        self.back = _power(_BASE_INVERSE, n + 1)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        whole = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(whole + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of every span, one span after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


class WordIds(dict):
    """Numbers words as they come; `fresh` lists those seen since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word):
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


class Codes:
    """The codes of words met so far, at most about `limit` words: beyond it those used once since the last time go, and
    of the others the more used half of the limit stays. Words of over LONGEST bytes are never remembered, so that memory
    is bounded by bytes too."""

    LONGEST = 64

    def __init__(self, limit: int, kind: type):
        self.limit, self.numbers = limit, WordIds()
        self.ids, self.starts, self.lengths, self.uses = np.zeros(1 << 16, kind), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look_up(self, words: list[bytes], learn) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words one after the other, and the number of each word's. learn: words to the same, for new ones."""
        if len(self.numbers) > self.limit:
            self._forget()
        numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        fresh, first_long = self.numbers.fresh, None
        if fresh:
            if max(map(len, fresh)) > self.LONGEST:  # long words last, so that they can be dropped
                place = [i for i, w in enumerate(fresh) if len(w) <= self.LONGEST]
                first_long, known = len(place), len(self.numbers) - len(fresh)
                place += [i for i, w in enumerate(fresh) if len(w) > self.LONGEST]
                moved = np.empty(len(fresh), np.int64)
                moved[place] = np.arange(len(fresh))
                new = numbers >= known
                numbers[new] = known + moved[numbers[new] - known]
                fresh = [fresh[i] for i in place]
                for i, w in enumerate(fresh[:first_long]):
                    self.numbers[w] = known + i
            self.numbers.fresh = []
            ids, lengths = learn(fresh)
            used = int(self.lengths.sum())
            need = used + len(ids)
            if need > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(need, 2 * len(self.ids)) - len(self.ids), self.ids.dtype)])
            self.ids[used:need] = ids
            self.starts = np.concatenate([self.starts, used + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.uses = np.concatenate([self.uses, np.zeros(len(lengths), np.int64)])
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        lengths = self.lengths[numbers]
        out = self.ids[ragged(self.starts[numbers], lengths)]
        if first_long is not None:
            for w in fresh[first_long:]:
                del self.numbers[w]
            n = len(self.numbers)
            self.starts, self.lengths, self.uses = self.starts[:n].copy(), self.lengths[:n].copy(), self.uses[:n].copy()
            used = int(self.lengths.sum())
            if len(self.ids) > 2 * used + (1 << 20):
                self.ids = np.concatenate([self.ids[:used], np.zeros(1 << 16, self.ids.dtype)])
        return out, lengths

    def _forget(self) -> None:
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > self.limit // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: self.limit // 2]])
        words = [b""] * len(self.numbers)
        for word, number in self.numbers.items():
            words[number] = word
        self.numbers = WordIds()
        for i in kept.tolist():
            self.numbers[words[i]] = len(self.numbers)
        lengths = self.lengths[kept]
        ids = self.ids[ragged(self.starts[kept], lengths)]
        self.ids = np.concatenate([ids, np.zeros(1 << 16, ids.dtype)])
        self.starts, self.lengths, self.uses = np.cumsum(lengths) - lengths, lengths, np.zeros(len(kept), np.int64)


def per_row(words: list[list], lengths: np.ndarray) -> np.ndarray:
    """The number of codes of each row, from its words and the number of each word's."""
    before = np.concatenate([[0], np.cumsum(lengths)])
    edge = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
    return before[edge[1:]] - before[edge[:-1]]


def unsigned_crc32(text_column) -> "F.Column":
    return F.crc32(F.encode(text_column.cast("string"), "UTF-8"))
