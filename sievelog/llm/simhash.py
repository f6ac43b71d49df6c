"""SimHash near-duplicates by anchor-point covering.

Fingerprint: A-Z in lower case, words `[^\\x20\\x09-\\x0D]+`, three-word shingles (repeats included; fewer words: the
whole sequence; none: fingerprint zero), XXH64 with seed 42 of each, and for every bit the strict majority.

Linking at up to 3 differing bits. Of the two 32-bit halves, one differs in at most one bit. The anchors of a half
are the words of a covering code: the Hamming code on its low 31 bits, the last bit free; every half lies within one
bit (the covering radius) of an anchor, its home. A fingerprint is replicated to all anchors within 1 + 1 bits of its
half (at most 17 of 2**27), so whatever is within one bit of a half meets it at its home. Fingerprints are compared per
anchor, homes against visitors, and only a spanning forest of the links leaves a task. Nothing is capped: an anchor
that is home to many has its homes cut into chunks, one with many visitors these as well, and every chunk of homes
meets every chunk of visitors.

Equal fingerprints are one from the start. Null and empty texts have no words; long texts are read whole. A bit set in
exactly half of the shingles is 0. Null doc_ids are fingerprinted and linked but give no component its name unless it has
no other; rows that share a doc_id are kept as they are, and equal rows get equal results. Empty tables give empty
results; other columns are ignored by near_duplicates() and pass through keep_one(), where of rows that share the least
doc_id that with the least hash of its text stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles
from .components import Forest, components

SHINGLE = 3
SEED = 42
THRESHOLD = 3
#: Homes of an anchor in one chunk.
CHUNK = 2048
#: Fingerprints at an anchor in one chunk of visitors.
VISITORS = 1 << 15
#: Pairs compared at a time.
PAIRS = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER = _LOWER.tobytes()


def fingerprints(texts: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.translate(_LOWER).split()
        if not words:
            continue
        line = b" ".join(words)
        if len(words) <= SHINGLE:
            hashes.append(xxh64_intdigest(line, SEED))
            counts[i] = 1
            continue
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = [0, *(spaces[: len(words) - SHINGLE] + 1).tolist()]
        ends = [*spaces[SHINGLE - 1 :].tolist(), len(line)]
        hashes += [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends)]
        counts[i] = len(starts)
    if not hashes:
        return out
    bits = np.unpackbits(np.array(hashes, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = np.flatnonzero(counts)
    first = (np.cumsum(counts) - counts)[some]
    totals = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    major = (2 * totals > counts[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(major, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _fingerprint(batches):
    for part in common.chunks(batches):
        texts = ["" if t is None else t for t in part.column("text").to_pylist()]
        prints = fingerprints([t.encode() for t in texts])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), pa.array(prints.view(np.int64))], ["doc_id", "tag", "fp"])


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Of the low and the high 16 bits of a half: the sum of the positions (from 1) of the set bits among the low 31."""
    low, high = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint32)
    for bit in range(16):
        on = (np.arange(1 << 16) >> bit & 1).astype(bool)
        low[on] ^= bit + 1
        if bit < 15:
            high[on] ^= bit + 17
    return low, high


#: For each syndrome, the masks that lead from a half to every anchor within two bits; unused places repeat the first.
def _masks() -> list[np.ndarray]:
    out = []
    for s in range(32):
        flip = lambda i: 1 << (i - 1)
        if s == 0:
            near = [0, 1 << 31]
        else:
            near = [flip(s), flip(s) | 1 << 31] + [flip(i) | flip(i ^ s) for i in range(1, 32) if i < i ^ s]
        out.append(np.array(near, np.uint32))
    return out


def _anchors(batches):
    low, high = _syndromes()
    masks = _masks()
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for half in (0, 1):
            part = (prints >> np.uint64(32 * half)).astype(np.uint32)
            syndrome = low[part & np.uint32(0xFFFF)] ^ high[part >> np.uint32(16)]
            for s in range(32):
                mine = syndrome == s
                if not mine.any():
                    continue
                anchors = (part[mine][:, None] ^ masks[s][None, :]).astype(np.int64) | half << 32
                home = np.zeros(anchors.shape, bool)
                home[:, 0] = True  # the first mask leads to the nearest anchor
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors.ravel()), pa.array(np.repeat(prints[mine].view(np.int64), anchors.shape[1])), pa.array(home.ravel())], ["anchor", "fp", "home"]
                )


def compare(anchor: np.ndarray, chunk: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links that a task's rows show: every home against every row of its anchor and chunk."""
    order = np.lexsort((fp, chunk, anchor))
    anchor, chunk, fp, home = anchor[order], chunk[order], fp[order], home[order]
    new = np.ones(len(fp), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (chunk[1:] != chunk[:-1])
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(fp)))
    homes = np.flatnonzero(home & (size[group] > 1))
    found = Forest()
    work = np.cumsum(size[group[homes]])
    at = 0
    while at < len(homes):
        end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + PAIRS)))
        mine = homes[at:end]
        n = size[group[mine]]
        a, b = np.repeat(fp[mine], n), fp[common.ragged(start[group[mine]], n)]
        near = (np.bitwise_count((a ^ b).view(np.uint64)) <= threshold) & (a != b)
        found.add(a[near], b[near])
        at = end
    return found.fold()


def _compare(batches):
    held = [b for b in batches if b.num_rows]
    if held:
        columns = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("anchor", "chunk", "fp", "home")]
        u, v = compare(*columns)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def link(prints: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Distinct fingerprints (fp) to (node, root): the components at up to THRESHOLD differing bits, without the roots."""
    spots = scratch.save(prints.mapInArrow(_anchors, "anchor long, fp long, home boolean"), "spots")
    counts = spots.groupBy("anchor").agg(F.count_if("home").alias("homes"), F.count("*").alias("n"))
    crowded = counts.filter((F.col("homes") > CHUNK) | (F.col("homes") > 0) & (F.col("n") > VISITORS))
    crowded = scratch.save(crowded.select("anchor", F.ceil(F.col("homes") / CHUNK).cast("int").alias("rows"), F.ceil(F.col("n") / VISITORS).cast("int").alias("columns")), "crowded")
    if crowded.head(1):
        # A grid of chunks: a home is in all of its row, anyone in all of its column.
        spots = spots.join(crowded, "anchor", "left").withColumns({"rows": F.coalesce("rows", F.lit(1)), "columns": F.coalesce("columns", F.lit(1))})
        row, column = F.pmod(F.hash("fp"), F.col("rows")), F.pmod(F.xxhash64("fp"), F.col("columns")).cast("int")
        along = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct((i * F.col("columns") + column).alias("chunk"), (F.col("home") & (i == row)).alias("home")))
        across = F.transform(F.filter(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: F.col("home") & (j != column)), lambda j: F.struct((row * F.col("columns") + j).alias("chunk"), F.lit(True).alias("home")))
        spots = spots.select("anchor", "fp", F.explode(F.concat(along, across)).alias("s")).select("anchor", "s.chunk", "fp", "s.home")
    else:
        spots = spots.select("anchor", F.lit(0).alias("chunk"), "fp", "home")
    parts = max(common.spread(prints), -(-prints.count() * 34 // 400_000))
    edges = spots.repartition(parts, "anchor", "chunk").mapInArrow(_compare, "u long, v long")
    return components(edges, scratch)


def _linked(docs: DataFrame, scratch: common.Scratch) -> DataFrame:
    """doc_id, tag (a hash of the text), fp, root (a fingerprint of the component) and component_id of every row."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tag", F.xxhash64("text")).mapInArrow(_fingerprint, "doc_id long, tag long, fp long")
    rows = scratch.save(rows, "prints")
    classes = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    linked = link(classes.select("fp"), scratch)
    named = classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = scratch.save(named, "rooted")
    several = scratch.apart(named.groupBy("root").agg(F.min("least").alias("component_id")), "several")
    named = scratch.save(named.join(several, "root").select(F.col("fp").alias("_fp"), "root", "component_id"), "named")
    scratch.drop("spots", "crowded")
    return rows.join(named, rows["fp"] == named["_fp"]).drop("_fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id (smallest doc_id reachable) of every row."""
    found = _linked(docs, common.Scratch(docs.sparkSession, "simhash"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest doc_id, with all its columns; a row without an id stays if none has one.

    Components are those of five-word shingles with a similarity of 0.8 or more (`shingles.py`), not those of near_duplicates().
    """
    scratch = common.Scratch(docs.sparkSession, "simhash")
    found = shingles.linked(docs, scratch)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    first = found.groupBy("root").agg(F.min(order).alias("f")).select(F.col("f.doc_id").alias("__first_id"), F.col("f.tag").alias("__first_tag"))
    first = scratch.save(first, "first")
    repeated = found.groupBy("doc_id", "tag").count().filter("count > 1").head(1)
    rows = docs.withColumn("__tag", F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__first_id")) & (F.col("__tag") == F.col("__first_tag"))
    kept = rows.join(first.hint("shuffle_hash"), same, "left_semi")
    return (kept.dropDuplicates(["doc_id", "__tag"]) if repeated else kept).drop("__tag")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
