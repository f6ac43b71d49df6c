"""SentencePiece (BPE with byte fallback) encoding by suffix-array matching, and decoding.

No piece of the models meant here holds a word mark (U+2581) after any other character, so a text falls into
segments - a run of spaces and the run of other characters behind it, or a tab or line break - that never share a piece.
A task numbers its distinct segments; those not met before are encoded together:

1. They are laid end to end, as code points with separators between, and the suffixes are sorted to the depth of the
   longest piece, by prefix doubling.
2. All pieces are looked up at once: character by character, two binary searches narrow every piece's range of
   suffixes. A range holds all places where the piece occurs: the edges.
3. Edges are laid out by position and length.
4. They are relaxed as the model does: in every round each segment takes its best edge (highest score, then leftmost)
   that joins two adjacent symbols, until none is left. What is no piece in the end falls back to its bytes.

A segment of over WHOLE characters is cut where no piece leads across, window by window, so that memory follows the
longest stretch that pieces tie together; what is left of one is relaxed whole, which is exact at any length.

The model file's own normalisation must be the identity but for the mark in front of a text and marks for spaces, and
its encoding that of byte-pair merges: a model is asked about a probe, and refused if it does anything else. Null text
gives null ids; the empty text has none. Very long texts are encoded whole. Edges of equal score are taken from the
left. Rows are judged one by one, so repeated ids or rows need no care; empty tables give no rows; other columns pass
through, but a column named like the one that is added is replaced.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MARK = "\u2581"
#: Segments whose ids a Python worker remembers, over tasks.
MEMORY = 250_000
#: Characters encoded together; bounds the table of edges.
TOGETHER = 1 << 19
#: Characters of a segment from which on it is cut into windows of as many.
WHOLE = 1 << 18
#: Characters of a segment from which on it is relaxed by a heap.
LONG = 64
#: What a model is asked about before it is used: capitals, spaces, accents, a ligature, full-width and rare characters.
PROBE = "The  quick brown\tfoxes' unbelievable ﬁnery: été ＡＢ 42.50 \U0001f9a9 "
_SEGMENT = re.compile(rb" *[^ \t\n\x0b\x0c]+|[\t\n\x0b\x0c]| +")


class Model:
    """The pieces of a model file."""

    def __init__(self, file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=file)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(len(pieces))]
        is_byte = [sp.is_byte(i) for i in range(len(pieces))]
        self.byte_ids = np.array([i for i, b in enumerate(is_byte) if b], np.int32)
        if len(self.byte_ids) != 256:
            raise ValueError("a model with byte fallback is needed")
        plain = [i for i in range(len(pieces)) if not special[i] and not is_byte[i]]
        if any(MARK in pieces[i].lstrip(MARK) or len(pieces[i]) > 1 and re.search(r"[\t\n\x0b\x0c]", pieces[i]) for i in plain):
            raise ValueError("a piece of this model spans words")
        self.ids = np.array(plain, np.int32)
        self.lengths = np.array([len(pieces[i]) for i in plain], np.int64)
        self.depth = int(self.lengths.max())
        self.characters = np.zeros((len(plain), self.depth), np.uint32)
        for row, i in enumerate(plain):
            self.characters[row, : len(pieces[i])] = np.frombuffer(pieces[i].encode("utf-32-le"), np.uint32)
        scores = np.array([sp.get_score(i) for i in range(len(pieces))])
        self.rank = np.unique(scores, return_inverse=True)[1].astype(np.int64)
        self.falling = (self.rank.max() - self.rank).tolist()
        raw = [b"" if special[i] else bytes([int(pieces[i][1:-1], 16)]) if is_byte[i] else pieces[i].replace(MARK, " ").encode() for i in range(len(pieces))]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_lengths = np.array(list(map(len, raw)), np.int64)
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths
        probe = PROBE
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("this model normalises texts")
        segments = [s.decode().replace(" ", MARK) for s in _SEGMENT.findall(b" " + probe.encode())]
        if encode_segments(segments, self)[0].tolist() != sp.encode(probe):
            raise ValueError("this model does not encode by byte-pair merges")


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of `text` in the order of the suffixes that begin there, as far as `depth` characters tell."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while width < depth:
        behind = np.zeros_like(rank)
        behind[:-width] = rank[width:]
        key = rank * (int(rank.max()) + 1) + behind
        width *= 2
        if width >= depth:
            return np.argsort(key, kind="stable")
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
    return np.argsort(rank, kind="stable")


def occurrences(text: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of `pieces`, place in `text`) of all occurrences of all pieces."""
    order = suffix_array(text, pieces.shape[1])
    padded = np.concatenate([text, np.zeros(pieces.shape[1] + 1, text.dtype)])
    known = np.zeros(int(max(text.max(initial=0), pieces.max(initial=0))) + 1, bool)
    known[text] = True
    known[0] = True
    rows = np.flatnonzero(known[pieces].all(axis=1))
    low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(text), np.int64)
    done_rows, done_low, done_high = [], [], []
    for d in range(pieces.shape[1]):
        want = pieces[rows, d]
        for side in (0, 1):  # the first suffix whose character is not below, and the first above
            a, b = low.copy(), high.copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                seen = padded[order[np.minimum(mid, len(text) - 1)] + d]
                right = (seen < want if side == 0 else seen <= want) & open_
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            if side == 0:
                start = a
            else:
                low, high = start, a
        ends = (lengths[rows] == d + 1) & (low < high)
        done_rows.append(rows[ends])
        done_low.append(low[ends])
        done_high.append(high[ends])
        go = (lengths[rows] > d + 1) & (low < high)
        rows, low, high = rows[go], low[go], high[go]
        if not len(rows):
            break
    rows, low, high = map(np.concatenate, (done_rows, done_low, done_high))
    return np.repeat(rows, high - low), order[common.ragged(low, high - low)]


def _relax(start: int, stop: int, edge: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of one segment, begins and ends: the best edge first, from a heap; an edge that no longer joins two neighbours is passed over."""
    n, depth, width = stop - start, model.depth, edge.shape[1]
    end, before, alive = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), bytearray(b"\1") * n
    table, rank = memoryview(edge[start:stop]).cast("B").cast("i"), model.falling
    heap: list[int] = []  # rank, place and length of an edge in one number

    def offer(a: int) -> None:
        """The edge that joins the symbol at a and the one behind it."""
        b = end[a]
        if b < n and end[b] - a <= depth and (piece := table[a * width + end[b] - a]) >= 0:
            heapq.heappush(heap, (rank[piece] << 40 | a) << 8 | end[b] - a)

    for a in range(n):
        offer(a)
    while heap:
        key = heapq.heappop(heap)
        a = key >> 8 & (1 << 40) - 1
        stop_at, b = a + (key & 255), end[a]
        if not alive[a] or b >= n or end[b] != stop_at:
            continue
        alive[b] = 0
        end[a] = stop_at
        if stop_at < n:
            before[stop_at] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    begins = np.flatnonzero(np.frombuffer(alive, np.uint8))
    return begins + start, np.frombuffer(end, np.int64)[begins] + start


def _edges(text: np.ndarray, model: Model) -> np.ndarray:
    """For every place and length the piece that stands there, or -1. Long texts are indexed in windows that overlap by a piece."""
    edge = np.full((len(text), model.depth + 1), -1, np.int32)
    for at in range(0, len(text), WHOLE):
        part = text[at : at + WHOLE + model.depth]
        row, place = occurrences(part, model.characters, model.lengths)
        edge[at + place, model.lengths[row]] = model.ids[row]
    return edge


def _ids(text: np.ndarray, edge: np.ndarray, begin: np.ndarray, end: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Ids of symbols in their order, and the number of each one's: what is no piece falls back to its bytes."""
    ids = edge[begin, end - begin]
    known = ids >= 0
    counts = np.ones(len(ids), np.int64)
    raw = [chr(c).encode() for c in text[begin[~known]].tolist()]
    counts[~known] = list(map(len, raw))
    out = np.repeat(ids, counts)
    out[np.repeat(~known, counts)] = model.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    return out.astype(np.int32), counts


def encode_long(segment: str, model: Model, window: int = 0) -> np.ndarray:
    """Ids of one segment, read in windows: what lies before the last place that no piece crosses is done with."""
    window = window or WHOLE
    out, left, at = [], np.zeros(0, np.uint32), 0
    while at < len(segment) or len(left):
        # Where nothing can be cut the window grows with what is left, so that no character is indexed more than a few times.
        step = max(window, len(left))
        left = np.concatenate([left, np.frombuffer(segment[at : at + step].encode("utf-32-le"), np.uint32)])
        at += step
        edge = _edges(left, model)
        cut = len(left)
        if at < len(segment):
            place, size = np.nonzero(edge[:, 2:] >= 0)
            crossed = np.zeros(len(left) + 1, np.int64)
            np.add.at(crossed, place + 1, 1)
            np.add.at(crossed, place + size + 2, -1)
            free = np.flatnonzero(np.cumsum(crossed)[: max(0, len(left) - model.depth + 1)] == 0)
            cut = int(free[-1]) if len(free) else 0
        if cut:
            begin, end = _relax(0, cut, edge, model)
            out.append(_ids(left, edge, begin, end, model)[0])
            left = left[cut:].copy()
    return np.concatenate([np.zeros(0, np.int32), *out])


def encode_segments(segments: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments one after the other, and the number of each one's."""
    joined = "\0".join(segments) + "\0"
    text = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    starts = np.cumsum(sizes + 1) - sizes - 1
    edge = _edges(text, model)
    # Symbols: where they begin and end, and the segment they are in. At first each character is one.
    # Long segments are relaxed one by one, by a heap; the others side by side, a round at a time.
    done: list[tuple] = []
    for i in np.flatnonzero(sizes > LONG).tolist():
        begin, end = _relax(starts[i], starts[i] + sizes[i], edge, model)
        done.append((begin, end, np.full(len(begin), i)))
    side = np.where(sizes > LONG, 0, sizes)
    begin = common.ragged(starts, side)
    end = begin + 1
    owner = np.repeat(np.arange(len(segments)), side)
    far = 1 << 32
    while len(begin):
        size = end[1:] - begin[:-1]
        fits = (owner[1:] == owner[:-1]) & (size <= model.depth)
        piece = np.where(fits, edge[begin[:-1], np.minimum(size, model.depth)], -1)
        key = np.where(piece >= 0, model.rank[piece] * far + (far - 1 - begin[:-1]), -1)
        key = np.append(key, -1)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        best = np.maximum.reduceat(key, first)
        runs = np.diff(np.append(first, len(owner)))
        ended = np.repeat(best < 0, runs)
        if ended.any():
            done.append((begin[ended], end[ended], owner[ended]))
        chosen = (key == np.repeat(best, runs)) & ~ended
        left = np.flatnonzero(chosen)
        end[left] = end[left + 1]
        keep = ~ended
        keep[left + 1] = False
        begin, end, owner = begin[keep], end[keep], owner[keep]
    if not done:
        return np.zeros(0, np.int32), sizes
    begin, end, owner = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(begin, kind="stable")
    begin, end, owner = begin[order], end[order], owner[order]
    ids, counts = _ids(text, edge, begin, end, model)
    return ids, np.bincount(owner, weights=counts, minlength=len(segments)).astype(np.int64)


def encode_all(segments: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The same for any number of segments of any length, in bounded groups."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    out, at = [], 0
    total = np.cumsum(sizes)
    while at < len(segments):
        if sizes[at] > WHOLE:
            ids = encode_long(segments[at], model)
            out.append((ids, np.array([len(ids)])))
            at += 1
            continue
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TOGETHER, side="right")))
        over = np.flatnonzero(sizes[at:stop] > WHOLE)
        stop = at + int(over[0]) if len(over) else stop
        out.append(encode_segments(segments[at:stop], model))
        at = stop
    ids, counts = (np.concatenate(x) for x in zip((np.zeros(0, np.int32), np.zeros(0, np.int64)), *out))
    return ids, counts


class Encoder:
    def __init__(self, file: str):
        self.model = Model(file)
        self.codes = common.Codes(MEMORY, np.int32)

    def _learn(self, fresh: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        fresh = [s.decode().replace(" ", MARK) for s in fresh]
        # The separator is no character of a segment: a text's NUL is a segment of its own and falls back to its byte.
        plain = [s if "\0" not in s else "" for s in fresh]
        ids, counts = encode_all(plain, self.model)
        if plain == fresh:
            return ids, counts
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i, s in enumerate(fresh):
            if "\0" in s:
                pieces = []
                for j, sub in enumerate(s.split("\0")):
                    pieces += [np.array([self.model.byte_ids[0]], np.int32)] * (j > 0) + ([encode_all([sub], self.model)[0]] if sub else [])
                parts[i] = np.concatenate(pieces)
        return np.concatenate(parts), np.array(list(map(len, parts)), np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each one's."""
        split = [_SEGMENT.findall(b" " + t.replace(MARK, " ").encode()) if t else [] for t in texts]
        ids, lengths = self.codes.look_up([s for ss in split for s in ss], self._learn)
        return ids, common.per_row(split, lengths)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts that ids stand for; bytes that are no UTF-8 become replacement characters."""
        lengths = self.model.raw_lengths[ids]
        raw = self.model.raw[common.ragged(self.model.raw_starts[ids], lengths)].tobytes()
        before = np.concatenate([[0], np.cumsum(lengths)])
        edge = before[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [(raw[a + 1 : b] if raw[a : a + 1] == b" " else raw[a:b]).decode("utf-8", "replace") for a, b in zip(edge, edge[1:])]


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """This worker's encoder; one at a time is kept, from task to task."""
    if file not in _encoders:
        _encoders.clear()
        _encoders[file] = Encoder(file)
    return _encoders[file]


def _encode(batches, file: str, text: str):
    for part in common.chunks(batches, text):
        column = part.column(text)
        ids, counts = encoder(file).encode(column.to_pylist())
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
        if column.null_count:
            lists = pc.if_else(pc.is_valid(column), lists, pa.scalar(None, lists.type))
        names = [n for n in part.schema.names if n != "ids"]
        yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), lists], [*names, "ids"])


def _decode(batches, file: str):
    for batch in batches:
        ids = batch.column("ids")
        counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(ids).to_numpy(zero_copy_only=False)
        texts = pa.array(encoder(file).decode(flat, counts), pa.string())
        texts = pc.if_else(pc.is_valid(ids), texts, pa.scalar(None, pa.string()))
        names = [n for n in batch.schema.names if n != "decoded"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), texts], [*names, "decoded"])


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in schema.fields if f.name != name), T.StructField(name, kind)])


def encode(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """docs with `ids array<int>`, in the place of a column of that name if there is one."""
    common.ship(docs.sparkSession)
    return docs.mapInArrow(lambda b: _encode(b, model_file, text), _with(docs.schema, "ids", T.ArrayType(T.IntegerType())))


def decode(rows: DataFrame, model_file: str) -> DataFrame:
    """rows, which have `ids array<int>`, with `decoded string`, in the place of a column of that name if there is one."""
    common.ship(rows.sparkSession)
    return rows.mapInArrow(lambda b: _decode(b, model_file), _with(rows.schema, "decoded", T.StringType()))


def _digest(batches, file: str):
    for part in common.chunks(batches):
        texts = part.column("text").to_pylist()
        ids, counts = encoder(file).encode(texts)
        back = encoder(file).decode(ids, counts)
        raw = ids.astype("<u4").tobytes()
        ends = np.cumsum(counts)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": part.column("doc_id"),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist())], pa.int64()),
                "decoded_chars": pa.array([len(t) for t in back], pa.int64()),
                "round_trip": pa.array([t is None or t.replace(MARK, " ") == b for t, b in zip(texts, back)], pa.bool_()),
            }
        )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents through piece_bpe_32k and back: doc_id, n_tokens, ids_crc32 (unsigned 32-bit ids), decoded_chars, round_trip."""
    import public_tokenizers

    common.ship(spark)
    file = public_tokenizers.path("piece_bpe_32k.model")
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda b: _digest(b, file), "doc_id long, n_tokens long, ids_crc32 long, decoded_chars long, round_trip boolean")
