"""Near-duplicate embeddings by sorted projection passes.

Equal vectors are one class from the start, whatever their number; a class is represented by its smallest id. In each
pass the classes are ordered by the concatenated signs of their products with random directions (BITS
one-bit hashes to a 63-bit key; lexicographic order is numeric order). All passes are sorted at once by one range sort,
which carries the vectors, so a vector is moved once a pass. A task goes through its sorted rows in blocks of WINDOW and
compares each block with itself and with the one behind it, so a row meets at least its WINDOW next neighbours of each
pass; where two tasks' rows adjoin, their last and first WINDOW rows are written and compared after. Pairs are verified
by their cosine, in double precision; a task gives back a spanning forest of its links. The links of all passes are
united into components.

The number of passes follows from the table (`passes_needed`): PROBES sampled vectors get partners at exactly the
threshold, one in a random direction and one towards the nearest other probe, and how often a partner is within reach
in TRIALS orders is counted over the rows in between (a sample of about SAMPLE rows, scaled). There are as many passes,
at least PASSES, as the expected recall of all probes (RECALL) and of their poorest tenth (POOREST) takes. With `exact`,
there are no passes: every part of PART classes is compared with every other, which misses nothing and takes n²/2 pairs.

Then links are counted exactly inside each component: its members are dealt to parts of at most about PART rows, and
every pair of parts is compared by one task, which gives back counts and no pairs. So a group of any size is counted in
bounded pieces, and `n_links` misses a link only where the passes joined its ends by no path at all.

Vectors that are null, empty, zero or have null or non-finite components link with nothing: a component of their own.
Vectors of different lengths never link. Rows that share a vec_id are one vector each and linked to the other if they
are near. Rows without an id are left out. Keys that tie are ordered by a hash of the class. Empty tables give no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import Forest, components
from .vectors import matrix, normed, cosines, usable

THRESHOLD = 0.9
#: Passes at least.
PASSES = 12
PROBES, TRIALS, SAMPLE = 256, 64, 1 << 17
RECALL, POOREST = 0.99, 0.97
BITS = 60
WINDOW = 256
PART = 1024
SEED = 17
#: Cosines nearer to the threshold than this are computed again, pair by pair.
EPSILON = 1e-9


def directions(dim: int, passes: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, passes * bits))


def _keys(batches, passes: int, bits: int):
    made: dict[int, np.ndarray] = {}
    for batch in batches:
        sizes = pa.compute.list_value_length(batch.column("v")).to_numpy()
        for dim in np.unique(sizes):
            part = batch.filter(pa.array(sizes == dim))
            if dim not in made:
                made[dim] = directions(int(dim), passes, bits)
            x = matrix(part.column("v"))
            for at in range(0, len(x), 2048):
                signs = (normed(x[at : at + 2048]) @ made[dim] > 0).reshape(-1, passes, bits)
                keys = signs.astype(np.int64) @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))
                n = len(keys)
                some = part.slice(at, n)
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(np.ascontiguousarray(keys[:, p])), some.column("id"), some.column("v")], ["pass", "dim", "key", "id", "v"])


def near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have a cosine of at least `threshold`."""
    c = normed(x) @ normed(y).T
    out = c >= threshold
    i, j = np.nonzero(np.abs(c - threshold) < EPSILON)
    if len(i):
        out[i, j] = cosines(x[i], y[j]) >= threshold
    return out


_MET = pa.schema([("u", pa.int64()), ("w", pa.int64()), ("part", pa.int32()), ("head", pa.bool_()), ("place", pa.int32()), ("dim", pa.int32()), ("v", pa.list_(pa.float64()))])
_MET_DDL = "u long, w long, part int, head boolean, place int, dim int, v array<double>"


def _links(found: Forest, a: tuple, b: tuple, threshold: float) -> None:
    """Add the links between two blocks of (dims, ids, vectors by row)."""
    for dim in np.intersect1d(a[0], b[0]):
        p, q = a[0] == dim, b[0] == dim
        x, y = (np.array([v for v, own in zip(s[2], m) if own]).reshape(-1, dim) for s, m in ((a, p), (b, q)))
        i, j = np.nonzero(near(x, y, threshold))
        u, w = a[1][p][i], b[1][q][j]
        found.add(u[u != w], w[u != w])


def _blocks(batches, window: int):
    """Sorted rows as (part, dims, ids, vectors) of `window` rows, the last of fewer."""
    held, size = [], 0

    def cut(table: pa.Table):
        vectors = table.column("v").combine_chunks()
        flat, edges = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy())])
        return table.column("part")[0].as_py(), table.column("dim").to_numpy(), table.column("id").to_numpy(), [flat[x:y] for x, y in zip(edges, edges[1:])]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= window:
            table = pa.Table.from_batches(held)
            full = size // window * window
            for at in range(0, full, window):
                yield cut(table.slice(at, window))
            held, size = table.slice(full).to_batches(), size - full
    if size:
        yield cut(pa.Table.from_batches(held))


def _edge_rows(part: int, head: bool, block: tuple) -> pa.RecordBatch:
    dims, ids, vectors = block
    n = len(ids)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(n, pa.int64()), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, head)), pa.array(np.arange(n, dtype=np.int32)), pa.array(dims), pa.array(vectors, pa.list_(pa.float64()))], schema=_MET)


def _neighbours(batches, threshold: float, window: int):
    """A forest (u, w) of the links in a task's sorted rows, and its first and last `window` rows for the tasks beside it."""
    found, last, before, part = Forest(), None, None, 0
    for part, *block in _blocks(batches, window):
        if last is None:
            yield _edge_rows(part, True, block)
        else:
            _links(found, last, block, threshold)
        _links(found, block, block, threshold)
        before, last = last, block
    if last is None:
        return
    if before is not None:  # the last block may be short
        last = [np.concatenate([x, y])[-window:] for x, y in zip(before[:2], last[:2])] + [(before[2] + last[2])[-window:]]
    yield _edge_rows(part, False, last)
    u, w = found.fold()
    n = len(u)
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(w, pa.int64()), pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, bool)), *(pa.nulls(n, f.type) for f in list(_MET)[4:])], schema=_MET)


def _border(key, table: pa.Table, threshold: float) -> pa.Table:
    """Links between the last rows of one task and the first of the next."""
    found = Forest()
    sides = []
    for head in (False, True):
        rows = table.filter(pa.array(table.column("head").to_numpy(zero_copy_only=False) == head))
        sides.append((rows.column("dim").to_numpy(), rows.column("u").to_numpy(), [np.array(v, float) for v in rows.column("v").to_pylist()]))
    if len(sides[0][1]) and len(sides[1][1]):
        _links(found, *sides, threshold)
    u, v = found.fold()
    return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _pair(key, table: pa.Table, threshold: float) -> pa.Table:
    """Links of the first part's rows to the second's."""
    found = Forest()
    for dim in np.unique(table.column("dim").to_numpy()):
        part = table.filter(pa.compute.equal(table.column("dim"), int(dim)))
        first, second = part.column("first").to_numpy(), part.column("second").to_numpy()
        ids, x = part.column("id").to_numpy(), matrix(part.column("v"))
        if first.any() and second.any():
            i, j = np.nonzero(near(x[first], x[second], threshold))
            u, v = ids[first][i], ids[second][j]
            found.add(u[u != v], v[u != v])
    u, v = found.fold()
    return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _to_pairs(rows: DataFrame, both: bool) -> DataFrame:
    """rows (.., mine, parts), each sent to the pairs of parts it is in, as `a`, `b`, `first`, `second`. both: also (b, a) of (a, b)."""
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    mine = F.col("mine")
    ahead = F.transform(others if both else F.filter(others, lambda p: p >= mine), lambda p: F.struct(mine.alias("a"), p.alias("b"), F.lit(True).alias("first"), (p == mine).alias("second")))
    behind = F.transform(F.filter(others, lambda p: p != mine if both else p < mine), lambda p: F.struct(p.alias("a"), mine.alias("b"), F.lit(False).alias("first"), F.lit(True).alias("second")))
    return rows.withColumn("to", F.explode(F.flatten(F.array(ahead, behind))))


def _count(key, table: pa.Table, threshold: float) -> pa.Table:
    """Links of the first part's rows to the second's, as numbers of vectors."""
    dims = table.column("dim").to_numpy()
    first, second = table.column("first").to_numpy(), table.column("second").to_numpy()
    ids, n, roots = (table.column(c).to_numpy() for c in ("id", "n", "root"))
    out_ids, out = [], []
    for dim in np.unique(dims):
        own = dims == dim
        x = matrix(table.filter(pa.array(own)).column("v"))
        a, b = first[own], second[own]
        if a.any() and b.any():
            linked = near(x[a], x[b], threshold)
            out_ids.append(ids[own][a])
            linked &= (roots[own][a][:, None] == roots[own][b][None, :]) & (ids[own][a][:, None] != ids[own][b][None, :])
            out.append(linked @ n[own][b])
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64())])
    if not out:
        return schema.empty_table()
    return pa.table([pa.array(np.concatenate(out_ids)), pa.array(np.concatenate(out).astype(np.int64))], schema=schema)


def partners(x: np.ndarray, threshold: float) -> np.ndarray:
    """For each row two unit vectors at a cosine of `threshold` to it: in a random direction, and towards the nearest other row."""
    x = normed(x)
    c = x @ x.T
    np.fill_diagonal(c, -2)
    # Where the nearest is so near that nothing of it is left across the row, the random direction stands in.
    c[c >= 1 - EPSILON] = -2
    toward = [np.random.default_rng(SEED).standard_normal(x.shape), x[c.argmax(axis=1)]]
    out = []
    for z in toward:
        z = z - (z * x).sum(axis=1, keepdims=True) * x
        length = np.sqrt((z * z).sum(axis=1, keepdims=True))
        across = np.where(length > EPSILON, z / np.where(length > EPSILON, length, 1), 0)
        out.append(threshold * x + np.sqrt(1 - threshold**2) * across)
    return np.stack(out)


def _sorting_keys(x: np.ndarray, trials: int) -> np.ndarray:
    made = directions(x.shape[1], trials, BITS)
    return (x @ made > 0).reshape(len(x), trials, BITS).astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _between(batches, probes: dict, threshold: float):
    """For each probe, kind of partner and trial: how many rows lie between, but for those that the probe links with."""
    total = {dim: np.zeros((2, len(x), TRIALS), np.int64) for dim, (x, _, _) in probes.items()}
    for batch in batches:
        sizes = pa.compute.list_value_length(batch.column("v")).to_numpy()
        for dim in np.unique(sizes):
            if dim not in probes:
                continue
            x, low, high = probes[dim]
            rows = matrix(batch.filter(pa.array(sizes == dim)).column("v"))
            for at in range(0, len(rows), 2048):
                part = normed(rows[at : at + 2048])
                keys = _sorting_keys(part, TRIALS)
                order = np.sort(keys, axis=0)
                linked, who = np.nonzero(part @ x.T >= threshold)
                for t in range(TRIALS):
                    total[dim][:, :, t] += np.searchsorted(order[:, t], high[:, :, t], "left") - np.searchsorted(order[:, t], low[:, :, t], "right")
                for kind in (0, 1):
                    inside = (keys[linked] > low[kind][who]) & (keys[linked] < high[kind][who])
                    np.subtract.at(total[dim][kind], who, inside.astype(np.int64))
    for dim, counts in total.items():
        flat = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), dim, np.int32)), pa.array(flat), pa.array(counts.ravel()[flat])], ["dim", "place", "n"])


def passes_needed(classes: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW) -> int:
    """Passes that the expected recall of pairs at the threshold takes, for classes (id, v) of their number and density."""
    total = classes.count()
    picked = classes.select("v").orderBy(F.xxhash64("id", F.lit(SEED))).limit(PROBES).toPandas()["v"]
    probes, by_dim = {}, {}
    for v in picked:
        by_dim.setdefault(len(v), []).append(v)
    for dim, rows in by_dim.items():
        x = normed(np.array(rows, float))
        own, other = _sorting_keys(x, TRIALS)[None], np.stack([_sorting_keys(y, TRIALS) for y in partners(x, threshold)])
        probes[dim] = (x, np.minimum(own, other), np.maximum(own, other))
    if total <= 2 * window or not probes:
        return PASSES
    step = -(-total // SAMPLE)
    sample = classes.filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("v")
    counted = sample.mapInArrow(lambda b: _between(b, probes, threshold), "dim int, place long, n long").groupBy("dim", "place").agg(F.sum("n").alias("n")).toPandas()
    chances = []
    for dim, (x, _, _) in probes.items():
        counts = np.zeros(2 * len(x) * TRIALS)
        mine = counted[counted["dim"] == dim]
        counts[mine["place"].to_numpy()] = mine["n"].to_numpy()
        # A block meets itself and the next: always up to `window` rows away, never from twice that.
        reach = np.clip(2 - (counts * step + 1) / window, 0, 1).reshape(2, len(x), TRIALS)
        chances.append((reach.sum(axis=2) + 0.5) / (TRIALS + 1))
    chances = np.sort(np.concatenate(chances, axis=1), axis=1)
    passes = PASSES
    while True:
        recall = 1 - (1 - chances) ** passes
        if recall.mean(axis=1).min() >= RECALL and recall[:, : -(-recall.shape[1] // 10)].mean(axis=1).min() >= POOREST:
            return passes
        passes += 1


def _by_passes(classes: DataFrame, total: int, scratch: common.Scratch, threshold: float, passes: int, window: int) -> DataFrame:
    """(u, v): links that sorted projection passes over classes (id, v) find."""
    keys = classes.select("id", "v").mapInArrow(lambda b: _keys(b, passes, BITS), "pass int, dim int, key long, id long, v array<double>")
    parts = max(1, min(common.spread(keys), total * passes // (4 * window)))
    ordered = keys.repartitionByRange(parts, "pass", "dim", "key", "id").sortWithinPartitions("pass", "dim", "key", "id")
    ordered = ordered.select("id", "dim", "v", F.spark_partition_id().alias("part"))
    met = scratch.save(ordered.mapInArrow(lambda b: _neighbours(b, threshold, window), _MET_DDL), "met")
    inside = met.filter("w is not null").select("u", F.col("w").alias("v"))
    edge = met.filter("w is null").withColumn("border", F.col("part") - F.col("head").cast("int"))
    across = edge.select("border", "head", "u", "dim", "v").groupBy("border").applyInArrow(lambda key, t: _border(key, t, threshold), "u long, v long")
    return inside.unionByName(across)


def _by_all(classes: DataFrame, total: int, threshold: float) -> DataFrame:
    """(u, v): all links, by comparing every part with every other."""
    parts = max(1, -(-total // PART))
    dealt = classes.select("id", "dim", "v", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("mine"), F.lit(parts).alias("parts"))
    sent = _to_pairs(dealt, False).select("to.*", "id", "dim", "v")
    return sent.groupBy("a", "b").applyInArrow(lambda key, t: _pair(key, t, threshold), "u long, v long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, window: int = WINDOW, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row. passes: as many as the table needs, if not given; exact: all pairs instead."""
    spark = rows.sparkSession
    common.ship(spark)
    scratch = common.Scratch(spark, "vectors")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null")
    fit = scratch.save(rows.filter(usable(F.col("v"))), "fit")
    classes = scratch.save(fit.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).select(F.xxhash64("least", "v").alias("id"), "least", "n", F.size("v").alias("dim"), "v"), "classes")
    total = classes.count()
    if exact:
        edges = _by_all(classes, total, threshold)
    else:
        passes = passes_needed(classes, threshold, window) if passes is None else passes
        edges = _by_passes(classes, total, scratch, threshold, passes, window)
    linked = scratch.save(components(edges, scratch), "linked")
    scratch.drop("met")

    members = linked.union(linked.select(F.col("root").alias("node"), "root").distinct())
    members = scratch.save(members, "members")
    sizes = scratch.apart(members.groupBy("root").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "sizes")
    grouped = scratch.save(classes.join(members.join(sizes, "root"), F.col("id") == F.col("node")).select("id", "n", "least", "dim", "v", "root", "parts"), "grouped")
    grouped = grouped.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    sent = _to_pairs(grouped, True)
    # Small components share a task: a batch of them is compared as one, and only links inside a component count.
    batch = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("root"), F.lit(max(1, total // PART)))).otherwise(F.col("root"))
    sent = sent.select(batch.alias("batch"), (F.col("parts") > 1).alias("large"), "to.a", "to.b", "to.first", "to.second", "id", "n", "root", "dim", "v")
    counts = sent.groupBy("large", "batch", "a", "b").applyInArrow(lambda key, t: _count(key, t, threshold), "id long, links long")
    counts = counts.groupBy("id").agg(F.sum("links").alias("links"))
    named = scratch.apart(grouped.groupBy("root").agg(F.min("least").alias("component")), "named")
    found = scratch.read("grouped", grouped.drop("mine")).join(named, "root").join(counts, "id", "left").select(F.col("id").alias("_id"), "component", F.coalesce("links", F.lit(0)).alias("links"))
    per_class = scratch.save(classes.join(found, classes["id"] == found["_id"], "left").select("v", "n", "least", F.coalesce("component", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "result")
    scratch.drop("grouped", "linked")
    named = fit.join(per_class.withColumnRenamed("v", "w"), F.col("v") == F.col("w")).select("vec_id", "n_links", "component_id")
    rest = rows.filter(~F.coalesce(usable(F.col("v")), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


ORACLE = """WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u AS vec_id, min(v) AS component_id FROM r GROUP BY u),
n AS (SELECT u AS vec_id, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""
