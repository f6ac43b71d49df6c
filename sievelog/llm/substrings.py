"""Exact substring dedup: every word covered by a 50-word window that also starts in a document with a smaller doc_id.

Words are runs of `[^\\x20\\x09-\\x0D]+`, compared through 64-bit hashes. The work follows what is shared:

1. Routing. The key of a window is the least hash of the GRAM-word grams in it (winnowing), so equal windows have equal
   keys wherever they stand. Consecutive windows of one key form a *cell*: a key, a place and the words from the first
   window's start to the last one's end. Keys found in one document only are dropped; nothing of them can be shared.
2. Variants. Cells with the same key and words are one variant, which belongs to the smallest doc_id that has it and
   is held once, however many cells there are.
3. Reference shards. Variants are dealt to shards by key; a shard is bounded and holds a suffix automaton of the words
   of its variants. Documents are streamed through it in ascending doc_id for their matching statistics: a variant
   runs through the automaton of all smaller documents, then joins it, and if larger documents have it as well it runs
   through once more as one of theirs. Spans of 50 words or more are what is removed, of every cell of the variant.
   No word is removed that an automaton didn't find. With `once` off, every cell is streamed for itself.
4. Crowded keys. A key with over MAX_VARIANTS variants (a passage that thousands of documents embed in different
   text) would make an unbounded shard. Its variants are dealt to shards one by one, which settles what larger
   documents have of each, and cut again by the least hash of longer grams (GRAMS), which sets the passage itself, one
   variant by then, apart from what surrounds it; steps 2 to 4 repeat on the finer cells. The last gram is a whole
   window, whose cells have one variant each, so nothing is left over.

What documents share has no bound, so shards are not broadcast: their documents are routed to them by key.

Windows are judged on the input. Null text has no words; empty and short texts lose nothing. A null doc_id counts as
larger than all. Rows that share a doc_id, or have none, do not remove each other's words; each is judged on its own
text, told apart by 64 bits of it, and equal rows get equal results. Windows that tie in a key are cells of it each. Very
long texts are read whole. Empty tables give empty results. Other columns are ignored by `dedup_substrings` and pass
through `remove_substrings`, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 50
#: Words in the grams that route windows: the first for all windows, the others for those of crowded keys.
GRAMS = (16, 40, 48, WINDOW)
#: Variants of a key that one shard compares; beyond it the variants are cut finer.
MAX_VARIANTS = 64
#: Variants in a shard, about.
SHARD = 1500
LAST = (1 << 63) - 1


class Automaton:
    """A suffix automaton of several sequences of integers."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link = self.next, self.link
        clone = self._state(self.length[p] + 1, dict(nxt[q]), link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def add(self, sequence) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                continue
            p, cur = last, self._state(length[last] + 1, {}, 0)
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = cur

    def spans(self, sequence, least: int) -> list[tuple[int, int]]:
        """Maximal spans of `sequence` of at least `least` symbols that occur in what was added."""
        nxt, link, length = self.next, self.link, self.length
        out: list[tuple[int, int]] = []
        state = have = 0
        for i, c in enumerate(sequence):
            while state and c not in nxt[state]:
                state = link[state]
                have = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                have += 1
            if have >= least:
                start = i + 1 - have
                if out and start <= out[-1][0]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((start, i + 1))
        return _joined(out)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, with those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _slide_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def cells(words: np.ndarray, first: np.ndarray, gram: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """Key, hash of all words, row, first word in its row and number of windows of every cell. words: hashes; first: of each row its first word."""
    n = len(words)
    empty = np.zeros(0, np.int64)
    if n < WINDOW:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    spans = common.Spans(words)
    at = np.arange(n - gram + 1)
    keys = _slide_min(spans.hash(at, at + gram), WINDOW - gram + 1)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)[: len(keys)]
    whole = np.arange(len(keys)) + WINDOW <= first[1:][row]
    begins = whole.copy()
    if gram < WINDOW:  # else every window is a cell, also where a text repeats itself
        begins[1:] &= ~whole[:-1] | (keys[1:] != keys[:-1])
    begin = np.flatnonzero(begins)
    ends = whole.copy()
    ends[:-1] &= ~whole[1:] | begins[1:]
    end = np.flatnonzero(ends) + 1
    return keys[begin], spans.hash(begin, end + WINDOW - 1), row[begin], begin - first[row[begin]], end - begin


def _hashed(part) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = common.utf8(part.column("text"))
    starts, ends, first = common.word_bounds(data, offsets)
    return common.Spans(data).hash(starts, ends), first, data, starts, ends


def _cells(batches):
    for part in common.chunks(batches):
        words, first, *_ = _hashed(part)
        key, same, row, at, count = cells(words, first)
        index = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(same.view(np.int64)), part.column("doc").take(index), part.column("tag").take(index), pa.array(at, pa.int32()), pa.array(count, pa.int32())],
            ["key", "same", "doc", "tag", "at", "count"],
        )


def _cut(batches):
    """The words of the cells asked for, as hashes."""
    schema = pa.schema([("key", pa.int64()), ("same", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("at", pa.int32()), ("words", pa.binary())])
    for part in common.chunks(batches):
        words, first, *_ = _hashed(part)
        rows: dict[str, list] = {name: [] for name in schema.names}
        for i, (doc, tag, wanted) in enumerate(zip(part.column("doc").to_pylist(), part.column("tag").to_pylist(), part.column("wanted").to_pylist())):
            for w in wanted:
                begin = first[i] + w["at"]
                for name, value in (("key", w["key"]), ("same", w["same"]), ("doc", doc), ("tag", tag), ("at", w["at"]), ("words", words[begin : begin + w["count"] + WINDOW - 1].tobytes())):
                    rows[name].append(value)
        yield pa.RecordBatch.from_pydict(rows, schema=schema)


def shard_spans(rows: list[tuple]):
    """(doc, key, same, copied, words) of a shard's variants to (key, same, owner, copy, begin, end): what smaller documents
    of the shard have of a variant, for its own document and, if it is copied, for larger ones that have it too."""
    automaton, waiting, now = Automaton(), [], None

    def join():
        for key, same, copied, seq in waiting:
            automaton.add(seq)
        for key, same, copied, seq in waiting:
            if copied:
                for a, b in automaton.spans(seq, WINDOW):
                    yield key, same, now, True, a, b

    for doc, key, same, copied, raw in sorted(rows):
        if doc != now:
            yield from join()
            waiting, now = [], doc
        seq = np.frombuffer(raw, np.uint64).tolist()
        for a, b in automaton.spans(seq, WINDOW):
            yield key, same, doc, False, a, b
        waiting.append((key, same, copied, seq))
    yield from join()


_SPANS = pa.schema([("key", pa.int64()), ("same", pa.int64()), ("owner", pa.int64()), ("copy", pa.bool_()), ("begin", pa.int32()), ("end", pa.int32())])
_SPANS_DDL = "key long, same long, owner long, copy boolean, begin int, end int"


def _shards(batches):
    """A task's rows, group by group in bounded shards."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).sort_by("group")
    groups = rows.column("group").to_numpy()
    edges = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]]))
    at = 0
    while at < len(edges) - 1:
        end = max(at + 1, int(np.searchsorted(edges, edges[at] + SHARD, side="right")) - 1)
        part = rows.slice(edges[at], edges[end] - edges[at])
        found = list(shard_spans(list(zip(*(part.column(c).to_pylist() for c in ("doc", "key", "same", "copied", "words"))))))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), _SPANS.types)], schema=_SPANS)
        at = end


def _streamed(batches):
    """The same with every cell for itself: (key, doc, tag, at, words) to (doc, tag, begin, end), one automaton a key."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).to_pylist()
    rows.sort(key=lambda r: (r["key"], r["doc"]))
    out, automaton, waiting, now = [], Automaton(), [], (None, None)
    for r in rows:
        if (r["key"], r["doc"]) != now:
            automaton = Automaton() if r["key"] != now[0] else automaton
            for seq in waiting if r["key"] == now[0] else ():
                automaton.add(seq)
            waiting, now = [], (r["key"], r["doc"])
        seq = np.frombuffer(r["words"], np.uint64).tolist()
        out += [{"doc": r["doc"], "tag": r["tag"], "begin": r["at"] + a, "end": r["at"] + b} for a, b in automaton.spans(seq, WINDOW)]
        waiting.append(seq)
    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())]))


def _finer(batches, gram: int):
    """The cells of variants by longer grams, each with its words."""
    for batch in batches:
        for sub in range(0, batch.num_rows, 2048):
            part = batch.slice(sub, 2048)
            raw = part.column("words").to_pylist()
            first = np.concatenate([[0], np.cumsum([len(r) // 8 for r in raw])])
            key, same, row, at, count = cells(np.frombuffer(b"".join(raw), np.uint64), first, gram)
            words = [raw[r][8 * a : 8 * (a + n + WINDOW - 1)] for r, a, n in zip(row.tolist(), at.tolist(), count.tolist())]
            place = part.column("at").to_numpy(zero_copy_only=False)[row] + at
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(same.view(np.int64)), part.column("doc").take(index), part.column("tag").take(index), pa.array(place, pa.int32()), pa.array(count, pa.int32()), pa.array(words, pa.binary())],
                ["key", "same", "doc", "tag", "at", "count", "words"],
            )


def _shared(found: DataFrame, scratch: common.Scratch, level: int) -> DataFrame:
    """The cells of keys that several documents have."""
    found = scratch.save(found, f"cells{level}")
    keys = found.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("key")
    found = scratch.save(found.join(scratch.apart(keys, f"keys{level}"), "key", "left_semi"), f"shared{level}")
    scratch.drop(f"cells{level}", f"keys{level}")
    return found


def _words_of(docs: DataFrame, cells: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """(key, same, doc, tag, at, words) of cells of docs. Rows that share doc and tag have the same words, and give them once."""
    wanted = cells.groupBy("doc", "tag").agg(F.collect_set(F.struct("key", "same", "at", "count")).alias("wanted"))
    held = docs.join(wanted.hint("shuffle_hash"), ["doc", "tag"]).select("doc", "tag", "text", "wanted")
    cut = scratch.save(held.mapInArrow(_cut, "key long, same long, doc long, tag long, at int, words binary"), name)
    repeated = cut.groupBy("key", "same", "doc", "tag", "at").count().filter("count > 1").head(1)
    return cut.dropDuplicates(["key", "same", "doc", "tag", "at"]) if repeated else cut


def spans(docs: DataFrame, scratch: common.Scratch, once: bool = True) -> DataFrame:
    """(doc, tag, begin, end): words of rows that smaller documents' windows cover; docs: (doc, tag, text).

    `once`: cells of the same words are settled by one run through an automaton. Off, each runs for itself, which gives
    the same spans and takes a shard for all cells of a key: for tests.
    """
    found = docs.mapInArrow(_cells, "key long, same long, doc long, tag long, at int, count int")
    if not once:
        every = _words_of(docs, _shared(found, scratch, 0), scratch, "cut0")
        return every.repartition(common.spread(docs), "key").mapInArrow(_streamed, "doc long, tag long, begin int, end int")
    out = None
    for level, gram in enumerate(GRAMS):
        if level:
            found = crowded.mapInArrow(lambda b, gram=gram: _finer(b, gram), "key long, same long, doc long, tag long, at int, count int, words binary")
        found = _shared(found, scratch, level)
        owner = F.min(F.struct("doc", "tag", "at", "count")).alias("first")
        variants = found.groupBy("key", "same").agg(owner, (F.max("doc") > F.min("doc")).alias("copied"))
        variants = scratch.apart(variants.select("key", "same", "copied", *(F.col(f"first.{c}").alias(c) for c in ("doc", "tag", "at", "count"))), f"variants{level}")
        counts = scratch.apart(variants.groupBy("key").agg(F.count("*").alias("variants")).filter(F.col("variants") > MAX_VARIANTS).select("key"), f"counts{level}")
        if level:  # finer cells bring their words along
            held = found.select("key", "same", "doc", "tag", "at", "words").join(variants.select("key", "same", "doc", "tag", "at", "copied"), ["key", "same", "doc", "tag", "at"])
            held = held.dropDuplicates(["key", "same"])
        else:
            held = _words_of(docs, variants, scratch, "cut0").join(variants.select("key", "same", "copied"), ["key", "same"])
        split = counts.head(1) is not None
        group = F.col("key")
        if split:
            held = held.join(counts.withColumn("crowded", F.lit(True)), "key", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
            held = scratch.save(held, f"held{level}")
            # Wherever its owner has a crowded variant, it is cut finer.
            own = held.filter("crowded").select("key", "same", F.col("doc").alias("owner"), "words")
            crowded = found.select("key", "same", "doc", "tag", "at").join(own, ["key", "same"]).filter("doc = owner").select("doc", "tag", "at", "words")
            group = F.when(F.col("crowded"), F.xxhash64("key", "same")).otherwise(F.col("key"))
            # Of a crowded variant that nobody else has in whole, nothing can be settled here.
            held = held.filter("copied or not crowded")
        shards = max(common.spread(docs), -(-variants.count() // 20_000))
        held = held.select(group.alias("group"), "doc", "key", "same", "copied", "words").repartition(shards, "group")
        settled = scratch.save(held.mapInArrow(_shards, _SPANS_DDL), f"settled{level}")
        # What a shard found of a variant holds for all its cells: for its owner's own, and for those of larger documents.
        here = found.select("key", "same", "doc", "tag", "at").join(settled, ["key", "same"]).filter((F.col("doc") > F.col("owner")) == F.col("copy"))
        here = scratch.save(here.select("doc", "tag", (F.col("at") + F.col("begin")).alias("begin"), (F.col("at") + F.col("end")).alias("end")), f"spans{level}")
        scratch.drop(f"variants{level}", f"counts{level}", f"settled{level}", "cut0", *(f"{name}{level - 1}" for name in ("shared", "held")))
        out = here if out is None else out.unionByName(here)
        if not split:
            break
    return out


def _apply(batches, digest: bool):
    for part in common.chunks(batches):
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": []}
        for text, removed in zip(part.column("text").to_pylist(), part.column("removed").to_pylist()):
            words = (text or "").encode().split()
            n = len(words)
            gone = 0
            if removed:
                kept, at = [], 0
                for a, b in _joined([(r["begin"], r["end"]) for r in removed]):
                    kept += words[at:a]
                    gone += b - a
                    at = b
                words = kept + words[at:]
            kept = b" ".join(words)
            out["n_words"].append(n)
            out["n_removed"].append(gone)
            out["kept"].append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
        yield pa.RecordBatch.from_arrays(
            [c for name, c in zip(part.schema.names, part.columns) if name not in ("text", "removed")] + [pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string())],
            [name for name in part.schema.names if name not in ("text", "removed")] + ["n_words", "n_removed", "kept"],
        )


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """docs with doc and tag, by which rows are told apart: the id, and some bits of the text."""
    return docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "tag": F.xxhash64(text)})


def _removed(docs: DataFrame, once: bool = True) -> DataFrame:
    """(doc, tag, removed) of the rows of docs (doc_id, text) that lose words: spans, each once."""
    scratch = common.Scratch(docs.sparkSession, "substrings")
    found = spans(_keyed(docs, "text").select("doc", "tag", "text"), scratch, once)
    return found.groupBy("doc", "tag").agg(F.collect_set(F.struct("begin", "end")).alias("removed"))


def dedup_substrings(docs: DataFrame, digest: bool = False, once: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words left, joined by a space, or with `digest` their SHA-256."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    removed = _removed(rows, once)
    rows = _keyed(rows, "text").join(removed.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc_id", "text", "removed")
    return rows.mapInArrow(lambda batches: _apply(batches, digest), "doc_id long, n_words long, n_removed long, kept string")


def _shorten(batches):
    """Texts without the words of their spans; other texts as they are."""
    for part in common.chunks(batches):
        names = [n for n in part.schema.names if n != "__removed"]
        texts = part.column("text").to_pylist()
        for i, removed in enumerate(part.column("__removed").to_pylist()):
            if removed:
                words, kept, at = texts[i].encode().split(), [], 0
                for a, b in _joined([(r["begin"], r["end"]) for r in removed]):
                    kept += words[at:a]
                    at = b
                texts[i] = b" ".join(kept + words[at:]).decode()
        own = {"text": pa.array(texts, pa.string())}
        if "n_chars" in names:
            own["n_chars"] = pa.array([None if t is None else len(t) for t in texts], part.schema.field("n_chars").type)
        yield pa.RecordBatch.from_arrays([own.get(n, part.column(n)) for n in names], names)


def remove_substrings(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, with the texts (and n_chars, if there) that are left. A text that loses all its words becomes empty."""
    common.ship(docs.sparkSession)
    found = _removed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    removed = found.select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), F.col("removed").alias("__removed"))
    own = docs.withColumns({"__doc2": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "__tag2": F.xxhash64(F.col("text").cast("string"))})
    rows = own.join(removed.hint("shuffle_hash"), (F.col("__doc") == F.col("__doc2")) & (F.col("__tag") == F.col("__tag2")), "left").select(*docs.columns, "__removed")
    return rows.mapInArrow(_shorten, docs.schema)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(common.table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


ORACLE = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT h, min(doc_id) AS first FROM s GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM s JOIN m USING (h) WHERE first < doc_id),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1)::BIGINT AS k FROM d),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n FROM p ANTI JOIN g USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(t.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""
