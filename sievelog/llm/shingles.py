"""Near-duplicate texts by the similarity of their sets of five-word shingles.

Words and lower case are SimHash's (`simhash.py`); fewer than five words make one shingle of all, none an empty set.
Two texts are linked if their sets' Jaccard similarity is at least 0.8, checked over the whole sets (of 64-bit hashes).

Candidates come from SimHash by anchor-point covering, with fingerprints wide enough for that similarity, at which a bit
differs with a chance of 0.152. A bit is set if more of the shingles' hashes have it than not. A text has tables()
fingerprints of two halves of HALF bits. Bit b of a shingle's hash is the parity of b and a number of BITS different ones,
and a sign, so that votes() counts all bits by a Hadamard transform. The anchors of a half are the 2 * HALF words of a
first-order Reed-Muller code, moved by a fixed word; balls of 56 bits around them cover all halves. A half's home is the
anchor that most of its votes are for, so that a bit counts by its majority. Texts meet where both halves of a fingerprint
have the same homes, and are compared there by one more fingerprint of 128 bits, of which DIFFER may differ. Measured, halves
of texts at 0.8 share a home with a chance of 0.40 to 0.42, so that two such texts meet at none of 72 fingerprints with one of
1e-6 to 2.5e-6, and at higher similarity with less. That over DIFFER bits differ was seen for one of 100,000 pairs of 4 and
5 shingles with 4 in common, and for none of as many larger ones.

Texts of equal sets are one class from the start. What is close by fingerprints at an anchor is a group, by the hash of its
members; an anchor of over CROWD texts is a group as it is, with no fingerprints compared. A family of many texts close to each
other would be in a group for each fingerprint, with much the same members. What is close by the first FEW fingerprints is
therefore one bundle, unless all its pairs are over WIDER times those that its groups would have by all fingerprints, and a group
at an anchor of the others only adds those of its members to a bundle that are not in it: no pair of a group is left out. In each
group, bundle or not, all are compared
over whole sets with its least member first, a number of pairs linear in the rows; then those of a group that are not in one
component yet are compared with each other. No pairs are written for that: a group is cut into
blocks of about BLOCK shingles, every two blocks meet in one task, whose counts of common shingles are products of 0-1
matrices, and a forest of the links leaves it. A group with much of all shingles is cut finer, for more tasks. Groups of the
same members are compared once, and none is cut short.
Sets are made again from the texts for candidates only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import Forest, components

WORDS = 5
#: Bits of half a fingerprint; votes counted at a time; differing bits of checking fingerprints that are compared further.
HALF, BITS, DIFFER = 128, 1024, 44
#: The chance that texts at the similarity are missed, that two of their halves have one home, and that a bit is the same.
MISSED, SAME_HOME, SAME_BIT = 3e-6, 0.41, 0.848
#: Texts at an anchor that are compared there; pairs compared at a time; rows of a task; texts fingerprinted at a time.
CROWD, PAIRS, SPOTS, TEXTS = 2048, 1 << 19, 400_000, 1024
#: Fingerprints that bundles are made by; texts that are a bundle at any rate; times the pairs of its groups a larger one may have.
FEW, SMALL, WIDER = 8, 64, 4
#: Shingles of a group in one block, about; the least that are worth one; and blocks of a group with nearly all shingles.
BLOCK, FINE, FINER = 1 << 19, 1 << 15, 16
#: Shingles that one task compares, about; of a slab of its rows; and cells of a matrix.
TASK, SLAB, CELLS = 1 << 21, 1 << 15, 1 << 22
SEED = 29

_ODD = np.random.default_rng(SEED).integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text in ascending order, one text after the other, and their numbers."""
    data, offsets = common.utf8(texts)
    data = _LOWER[data]
    starts, ends, first = common.word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    hashes = common.Spans(data).hash(starts, ends)
    count = np.diff(first)
    # Words beyond a short text's end add nothing; a text of WORDS or more has no such shingle.
    shingles = np.maximum(count - WORDS + 1, np.minimum(count, 1))
    at = common.ragged(first[:-1], shingles)
    text = np.repeat(np.arange(len(texts)), shingles)
    end = first[1:][text]
    total = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        inside = at + k < end
        total[inside] += hashes[at[inside] + k] * _ODD[k]
    total = common.mix(total)
    order = np.lexsort((total, text))
    total, text = total[order], text[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (text[1:] != text[:-1])
    return total[new], np.bincount(text[new], minlength=len(texts))


def _hadamard(n: int) -> np.ndarray:
    out = np.ones((1, 1), np.float32)
    while len(out) < n:
        out = np.block([[out, out], [out, -out]])
    return out


_INNER, _OUTER = _hadamard(HALF), _hadamard(BITS // HALF)
#: The word that moves the code, as signs.
_MOVED = np.random.default_rng(SEED + 1).choice(np.array([-1, 1], np.float32), HALF)


def tables(n: int) -> tuple[int, int]:
    """The number of fingerprints for n texts, and of bits that anchors have besides: 16 bits are fine for four million texts."""
    bits = max(0, (n - 1).bit_length() - 22)
    meet = SAME_HOME**2 * SAME_BIT**bits
    each = BITS // (2 * HALF)
    return each * int(np.ceil(np.log(MISSED) / np.log1p(-meet) / each)), bits


def votes(x: np.ndarray, sizes: np.ndarray, turn: int) -> np.ndarray:
    """For each set and each of BITS bits, by how much the shingles whose hash has the bit outnumber the others."""
    odd = np.random.default_rng([SEED, turn]).integers(0, 1 << 64, dtype=np.uint64) | np.uint64(1)
    hashed = x * odd
    place = np.repeat(np.arange(len(sizes)) * BITS, sizes) + (hashed >> np.uint64(54)).astype(np.int64)
    sign = 1.0 - 2.0 * (hashed >> np.uint64(53) & np.uint64(1)).astype(np.float64)
    heaps = np.bincount(place, sign, len(sizes) * BITS).astype(np.float32).reshape(-1, HALF)
    return _OUTER @ (heaps @ _INNER).reshape(len(sizes), BITS // HALF, HALF)


def homes(counted: np.ndarray) -> np.ndarray:
    """The number of the anchor that most of each half's votes are for."""
    agree = (counted * _MOVED).reshape(-1, HALF) @ _INNER
    best = np.abs(agree).argmax(axis=1)
    return (2 * best + (agree[np.arange(len(best)), best] > 0)).reshape(counted.shape[:-1])


def checking(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each set's checking fingerprint, as two words; every bit of a shingle's hash is its own, as small sets need."""
    out, some = np.zeros((len(sizes), 2), np.uint64), np.flatnonzero(sizes)
    if len(some):
        first = (np.cumsum(sizes) - sizes)[some]
        for word in (0, 1):
            bits = np.unpackbits(common.mix(x ^ _ODD[1 + word]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            major = 2 * np.add.reduceat(bits, first, axis=0, dtype=np.int32) > sizes[some][:, None]
            out[some, word] = np.packbits(major, axis=1, bitorder="little").view("<u8")[:, 0]
    return out.view(np.int64)


def fingerprints(x: np.ndarray, sizes: np.ndarray, n_tables: int, bits: int) -> np.ndarray:
    """The anchor of each of a set's n_tables fingerprints."""
    anchors = np.empty((len(sizes), n_tables), np.int32)
    each = BITS // (2 * HALF)
    for at in range(0, n_tables, each):
        counted = votes(x, sizes, at)
        home = homes(counted)
        anchor = home[:, 0::2] * (2 * HALF) + home[:, 1::2]
        for bit in range(bits):
            anchor = 2 * anchor + (counted[:, 0::2, bit] > 0)
        anchors[:, at : at + each] = anchor
    return anchors


def meet(spot: np.ndarray, own: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own, key) of those that are close to another at their anchor, by the key of their group. check: two words of each."""
    order = np.argsort(spot, kind="stable")
    spot, own, check = spot[order], own[order], check[order]
    start = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
    size = np.diff(np.append(start, len(spot)))
    crowded = np.flatnonzero(np.repeat(size > CROWD, size))
    end = np.repeat(start + size, size)
    rows = np.flatnonzero(np.repeat((size > 1) & (size <= CROWD), size))
    after = end[rows] - rows - 1
    work, at, found = np.cumsum(after), 0, Forest()
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + PAIRS)))
        a, b = np.repeat(rows[at:upto], after[at:upto]), common.ragged(rows[at:upto] + 1, after[at:upto])
        near = np.bitwise_count((check[a] ^ check[b]).view(np.uint64)).sum(axis=1, dtype=np.uint8) <= DIFFER
        found.add(a[near], b[near])
        at = upto
    node, root = found.fold()
    top = np.unique(root)
    node, root = np.concatenate([node, top]), np.concatenate([root, top])
    place, total = np.searchsorted(top, root), np.zeros(len(top), np.uint64)
    np.add.at(total, place, common.mix(own[node].view(np.uint64)))
    key = common.mix(total)[place].view(np.int64)
    return np.concatenate([own[node], own[crowded]]), np.concatenate([key, spot[crowded]])


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _sketch(batches, n_tables: int, bits: int):
    for part in (p.slice(i, TEXTS) for p in common.chunks(batches) for i in range(0, p.num_rows, TEXTS)):
        x, sizes = sets(part.column("text"))
        first = np.cumsum(sizes) - sizes
        own, some = np.zeros(len(sizes), np.uint64), np.flatnonzero(sizes)
        if len(some):
            own[some] = common.mix(np.add.reduceat(common.mix(x ^ _ODD[0]), first[some]) + sizes[some].astype(np.uint64))
        check, anchors = checking(x, sizes), fingerprints(x, sizes, n_tables, bits)
        offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, n_tables, 0))]).astype(np.int32)
        spots = pa.ListArray.from_arrays(pa.array(offsets), pa.array(anchors[some].ravel()))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("tag"), pa.array(own.view(np.int64)), pa.array(sizes.astype(np.int64)), pa.array(check[:, 0].copy()), pa.array(check[:, 1].copy()), spots],
            ["doc_id", "tag", "own", "size", "low", "high", "anchors"],
        )


def _meet(batches):
    held = [b for b in batches if b.num_rows]
    if held:
        spot, own, low, high = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("spot", "own", "low", "high"))
        own, key = meet(spot, own, np.stack([low, high], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(key)], ["own", "key"])


def _groups(batches, meeting):
    """A task's batches, (own, key) of what meets in it by `meeting`, in order and each once, and where groups begin and their sizes."""
    held = [b for b in batches if b.num_rows]
    met = [b for b in meeting(held) if b.num_rows]
    own, key = (np.concatenate([b.column(c).to_numpy() for b in met] or [np.zeros(0, np.int64)]) for c in ("own", "key"))
    order = np.lexsort((own, key))
    own, key = own[order], key[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
    own, key = own[new], key[new]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    return held, own, key, start, np.diff(np.append(start, len(key)))


def _led(batches, meeting):
    """What meets, with the least member and the size of its group."""
    _, own, key, start, size = _groups(batches, meeting)
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(key), pa.array(np.repeat(own[start], size)), pa.array(np.repeat(size, size))], ["own", "key", "lead", "n"])


def beside(own: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray, bundle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own, key) of groups, where a group with members of bundles (0: none) is those it adds to the bundle that has most of them."""
    group = np.repeat(np.arange(len(start)), size)
    inside = np.flatnonzero(bundle)
    inside = inside[np.lexsort((bundle[inside], group[inside]))]
    new = np.ones(len(inside), bool)
    new[1:] = (group[inside][1:] != group[inside][:-1]) | (bundle[inside][1:] != bundle[inside][:-1])
    first = np.flatnonzero(new)
    first = inside[first[np.argsort(np.diff(np.append(first, len(inside))), kind="stable")]]
    main = np.zeros(len(start), np.int64)
    main[group[first]] = bundle[first]  # the last of a group counts, which has the most
    main = main[group]
    adds = (main == 0) | (bundle != main)
    return own[adds], np.where(main == 0, key, main)[adds]


def _beside(batches, meeting):
    held, own, key, start, size = _groups(batches, meeting)
    if len(own):
        ids, bundles = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("own", "bundle"))
        ids, at = np.unique(ids, return_index=True)
        own, key = beside(own, key, start, size, bundles[at][np.searchsorted(ids, own)])
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(key)], ["own", "key"])


def _sets(batches):
    for part in common.chunks(batches):
        yield pa.RecordBatch.from_arrays([part.column("own"), _lists(*sets(part.column("text")))], ["own", "set"])


def _similar(batches):
    for batch in batches:
        sides = []
        for c in ("a", "b"):
            column = batch.column(c)
            sides.append((column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])))
        (x, i), (y, j) = sides
        keep = np.zeros(batch.num_rows, bool)
        for k in range(batch.num_rows):
            a, b = x[i[k] : i[k + 1]], y[j[k] : j[k + 1]]
            keep[k] = 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))  # Jaccard >= 4 / 5
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep))


def _has(x: np.ndarray, first: np.ndarray, sizes: np.ndarray, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A matrix of which of `words` each of the rows has."""
    values = x[common.ragged(first[rows], sizes[rows])]
    place = np.minimum(np.searchsorted(words, values), len(words) - 1)
    here = words[place] == values
    out = np.zeros((len(rows), len(words)), np.float32)
    out[np.repeat(np.arange(len(rows)), sizes[rows])[here], place[here]] = 1
    return out


def near(x: np.ndarray, first: np.ndarray, sizes: np.ndarray, rows: np.ndarray, others: np.ndarray):
    """Pairs of one of `rows` and another of `others` with the similarity. x, first, sizes: sets, where each begins, its size."""
    every = np.union1d(rows, others)
    shared, times = np.unique(x[common.ragged(first[every], sizes[every])], return_counts=True)
    shared = shared[times > 1]
    rows = rows[np.argsort(sizes[rows], kind="stable")]
    ends, at = np.cumsum(sizes[rows]), 0
    while at < len(rows):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLAB, side="right"))
        mine = rows[at : min(max(at + 1, upto), at + 256)]
        at += len(mine)
        words = np.intersect1d(x[common.ragged(first[mine], sizes[mine])], shared)
        if not len(words):
            continue
        close = others[(5 * sizes[others] >= 4 * sizes[mine].min()) & (4 * sizes[others] <= 5 * sizes[mine].max())]
        own, step = _has(x, first, sizes, mine, words), max(1, CELLS // len(words))
        for k in range(0, len(close), step):
            part = close[k : k + step]
            both = (own @ _has(x, first, sizes, part, words).T).astype(np.int64)
            u, v = np.nonzero(9 * both >= 4 * (sizes[mine][:, None] + sizes[part][None, :]))
            u, v = mine[u], part[v]
            yield u[u != v], v[u != v]


def _blocks(batches):
    """A forest of the links between the two blocks of every place (key, i, j) of a task."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    key, i, j, block, own = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("key", "i", "j", "block", "own"))
    sizes = np.concatenate([b.column("set").value_lengths().to_numpy() for b in held]).astype(np.int64)
    x = np.concatenate([b.column("set").flatten().to_numpy() for b in held])
    first = np.cumsum(sizes) - sizes
    order = np.lexsort((own, j, i, key))
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = np.any([c[order][1:] != c[order][:-1] for c in (key, i, j)], axis=0)
    edges, found = np.flatnonzero(new), Forest()
    for a, b in zip(edges, edges[1:]):
        mine = order[a:b]
        for u, v in near(x, first, sizes, mine[block[mine] == i[mine]], mine[block[mine] == j[mine]]):
            found.add(own[u], own[v])
    u, v = found.fold()
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _alike(a: str, b: str):
    """Whether sizes allow the similarity."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _candidates(classes: DataFrame, n: int, n_tables: int, scratch: common.Scratch) -> DataFrame:
    """(own, key) of all groups of two or more that are to be compared: bundles with what is close to them, and the other groups."""
    meeting = _meet

    def met(rows: DataFrame, at: int, upto: int, task, schema: str) -> DataFrame:
        spots = rows.select("*", F.posexplode(F.slice("anchors", at + 1, upto - at)).alias("i", "anchor"))
        spots = spots.withColumn("spot", F.shiftleft(F.col("i").cast("long"), 32) + F.col("anchor")).drop("i", "anchor", "anchors")
        spots = spots.repartition(max(common.spread(classes), -(-n * (upto - at) // SPOTS)), "spot")
        return spots.mapInArrow(lambda b: task(b, meeting), schema).distinct()

    rows = classes.select("own", "low", "high", "anchors")
    led = scratch.save(met(rows, 0, FEW, _led, "own long, key long, lead long, n long"), "led")
    near_ones = components(led.select(F.col("own").alias("u"), F.col("lead").alias("v")), scratch, "close")
    close = led.groupBy("own").agg(F.sum("n").alias("work")).join(near_ones, F.col("own") == F.col("node"), "left")
    close = scratch.save(close.select("own", F.coalesce("root", "own").alias("root"), "work"), "near")
    sums = close.groupBy("root").agg(F.count("*").cast("double").alias("m"), F.sum("work").alias("work"))
    bundles = sums.filter((F.col("m") <= SMALL) | (F.col("m") * F.col("m") * FEW <= F.col("work") * WIDER * n_tables))
    bundles = scratch.apart(bundles.select("root", F.xxhash64(F.lit("bundle"), "root").alias("bundle")), "bundles")
    bundled = scratch.save(close.join(bundles, "root").select("own", "bundle"), "bundled")
    rows = rows.join(bundled, "own", "left").withColumn("bundle", F.coalesce("bundle", F.lit(0).cast("long")))
    groups = met(rows, FEW, n_tables, _beside, "own long, key long").union(led.join(bundled, "own", "left_anti").select("own", "key"))
    return groups.distinct().union(bundled)


def linked(docs: DataFrame, scratch: common.Scratch) -> DataFrame:
    """doc_id, tag (a hash of the text) and root (a number of the component) of every row."""
    common.ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    n = docs.count()
    n_tables, bits = tables(n)
    made = texts.mapInArrow(lambda b: _sketch(b, n_tables, bits), "doc_id long, tag long, own long, size long, low long, high long, anchors array<int>")
    rows = scratch.save(made, "sketches")
    firsts = (F.first(c).alias(c) for c in ("size", "low", "high", "anchors"))
    classes = scratch.save(rows.groupBy("own").agg(F.min("tag").alias("tag"), *firsts), "classes")
    met = scratch.save(_candidates(classes, n, n_tables, scratch), "met")
    spots = met.join(classes.select("own", "size"), "own")
    groups = spots.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("own", "size")).alias("lead")).filter("n > 1")
    groups = scratch.save(groups.select("key", "n", F.col("lead.own").alias("lead"), F.col("lead.size").alias("lead_size")), "groups")
    spots = scratch.save(spots.join(groups, "key"), "spots")
    pairs = spots.filter(F.col("own") != F.col("lead")).filter(_alike("size", "lead_size"))
    pairs = scratch.save(pairs.select(F.col("own").alias("u"), F.col("lead").alias("v")).distinct(), "pairs")
    wanted = scratch.save(spots.select("own").distinct().join(classes.select("own", "tag"), "own"), "wanted")
    own = texts.select("tag", "text").join(wanted, "tag").dropDuplicates(["own"])
    made = scratch.save(own.mapInArrow(_sets, "own long, set array<long>"), "sets")
    half = pairs.join(made.select(F.col("own").alias("u"), F.col("set").alias("a")), "u")
    both = half.join(made.select(F.col("own").alias("v"), F.col("set").alias("b")), "v").select("u", "v", "a", "b")
    edges = scratch.save(both.mapInArrow(_similar, "u long, v long"), "links")
    found = scratch.save(components(edges, scratch), "found")
    labelled = spots.filter("n > 2").join(found, F.col("own") == F.col("node"), "left").withColumn("label", F.coalesce("root", "own"))
    labelled = scratch.save(labelled.select("key", "n", "own", "size", "lead", "label"), "labelled")
    followers = labelled.filter(F.col("own") != F.col("lead"))
    members = [F.count("*").alias("c"), F.bit_xor(F.xxhash64("own")).alias("h"), F.sum(F.xxhash64(F.lit(1), "own").cast("decimal(38,0)")).alias("s")]
    mixed = followers.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.sum("size").alias("shingles"), *members).filter("x < y")
    mixed = mixed.groupBy("c", "h", "s").agg(F.min(F.struct("key", "shingles")).alias("g"))  # of groups with the same members, one
    mixed = scratch.apart(mixed.select("g.key", "g.shingles"), "mixed")
    every = mixed.agg(F.sum("shingles")).first()[0] or 1
    finer = F.least(F.ceil(F.col("shingles") / FINE), F.ceil(F.col("shingles") / every * FINER))
    mixed = mixed.withColumn("blocks", F.greatest(F.ceil(F.col("shingles") / BLOCK), finer))
    moved = mixed.agg(F.sum(F.col("shingles") * F.col("blocks"))).first()[0]
    if moved:
        left = scratch.save(followers.join(mixed, "key").select("key", "own", "blocks", F.pmod(F.xxhash64("own"), F.col("blocks")).alias("block")), "left")
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
        met = left.select("key", "own", "block", other).select("key", "own", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        met = met.join(made, "own").repartitionByRange(max(common.spread(docs), -(-moved // TASK)), "key", "i", "j")  # as even as can be
        further = scratch.save(met.mapInArrow(_blocks, "u long, v long"), "further")
        found = components(edges.union(further), scratch, "all")
    named = scratch.save(classes.join(found, F.col("own") == F.col("node"), "left").select(F.col("own").alias("_own"), F.coalesce("root", "own").alias("root")), "named")
    scratch.drop("led", "near", "bundles", "bundled", "met", "spots", "groups", "pairs", "wanted", "sets", "labelled", "left")
    return rows.join(named, rows["own"] == named["_own"]).select("doc_id", "tag", "root")
