"""Nearest neighbours by cosine through vantage-point trees, one for each shard of the vectors.

A node of a tree has a vantage point and the angle that halves its other points. Angles are a metric on directions, so
with r the angle within which the k nearest so far lie, the near side needs no visit if the query is farther than
mu + r from the vantage point, nor the far side if it is nearer than mu - r. `factor` relaxes the rule: r is divided by
it before it is compared. Factor 1 is exact search; with more, fewer nodes are visited and recall falls. (Where
vectors have no structure in many dimensions nearly all angles are alike, and an exact search visits nearly all; see
the README for figures.) All queries of a block walk a tree together, a leaf at a time, nearest leaves first.

Every vector is indexed, in one shard of about SHARD vectors, dealt by a hash of its id. A shard's tree is built once and
written to the shared folder as a row of arrays. Queries go through in blocks of about BLOCK, in two rounds: first each
query through the tree of one shard, which bounds how far its k nearest can be, then through all others, which are
pruned by that bound from the start. Each pair of a tree and a block is one task's work, which gives back at most k
candidates a query; a window over the candidates of a query (at most k for each shard) picks the k nearest. Scores are
the cosines of the original vectors, in double precision; ties go to the smaller vec_id. Equal vectors all compete,
whatever their number.

Rows whose vector is null, empty, zero or has null or non-finite components, and rows without an id, take no part; nor
do vectors of another dimension than a query's. Rows that share a vec_id are candidates each, but not for their own id.
Fewer than k candidates: all of them. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .vectors import cosines, matrix, normed, vectors

SHARD = 16384
BLOCK = 32768
LEAF = 128
#: Slack for rounding where bounds are compared.
EPSILON = 1e-9


class Tree:
    """Nodes as rows of arrays. `span`: the angles that the near and the far side span; `child`: nodes of the two sides,
    or for a leaf -1 and nothing; `place`: the vantage point, or where a leaf's points begin and end in `order`."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF, seed: int = 5, held: tuple | None = None):
        self.ids, self.x, self.unit = ids, x, normed(x)
        if held is not None:
            self.order, self.span, self.child, self.place = held
            return
        self.order, self.leaf, self.rng = np.arange(len(ids)), leaf, np.random.default_rng(seed)
        self._span, self._child, self._place = [], [], []
        self._build(0, len(ids))
        self.span, self.child, self.place = np.array(self._span, float), np.array(self._child, np.int64), np.array(self._place, np.int64)

    def _build(self, a: int, b: int) -> int:
        """The node of order[a:b]: a leaf, or a vantage point and its points halved by their angles to it."""
        node = len(self._place)
        self._span.append([0.0] * 4)
        self._child.append([-1, -1])
        self._place.append([a, b])
        if b - a <= self.leaf:
            return node
        own = self.order[a:b]
        point = own[self.rng.integers(len(own))]
        angle = np.arccos(np.clip(self.unit[own] @ self.unit[point], -1, 1))
        middle = (b - a) // 2
        split = np.argpartition(angle, middle)
        self.order[a:b] = own[split]
        near, far = angle[split[:middle]], angle[split[middle:]]
        self._span[node], self._place[node] = [near.min(), near.max(), far.min(), far.max()], [point, 0]
        self._child[node] = [self._build(a, a + middle), self._build(a + middle, b)]
        return node

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of queries, vec_id, score) of the k nearest of every query. least: cosines below which nothing is wanted."""
        unit = normed(queries)
        self.best = np.full((len(queries), k), -2.0)  # cosines, descending
        self.least = np.full(len(queries), -2.0) if least is None else least
        self.found = np.full((len(queries), k), -1, np.int64)  # rows of the tree
        self.visited = 0
        if len(self.ids):
            self._walk(0, np.arange(len(queries)), query_ids, queries, unit, k, factor)
        row, slot = np.nonzero(self.found >= 0)
        return row, self.ids[self.found[row, slot]], self.best[row, slot]

    def _walk(self, node, rows, query_ids, queries, unit, k, factor):
        if not len(rows):
            return
        if self.child[node, 0] < 0:
            self._scan(node, rows, query_ids, queries, unit, k)
            return
        span = self.span[node]
        angle = np.arccos(np.clip(unit[rows] @ self.unit[self.place[node, 0]], -1, 1))
        first_left = np.abs(angle - (span[0] + span[1]) / 2) <= np.abs(angle - (span[2] + span[3]) / 2)
        for side_first in (True, False):  # every query goes to its nearer side first
            for side, mine in ((0, first_left == side_first), (1, first_left != side_first)):
                go = rows[mine]
                bound = np.maximum(self.best[go, -1], self.least[go])
                reach = np.where(bound < -1, np.pi, np.arccos(np.clip(bound, -1, 1)) / factor + EPSILON)
                a = angle[mine]
                self._walk(self.child[node, side], go[(a >= span[2 * side] - reach) & (a <= span[2 * side + 1] + reach)], query_ids, queries, unit, k, factor)

    def _scan(self, node, rows, query_ids, queries, unit, k):
        own = self.order[self.place[node, 0] : self.place[node, 1]]
        self.visited += len(rows) * len(own)
        near = unit[rows] @ self.unit[own].T
        near[query_ids[rows][:, None] == self.ids[own][None, :]] = -3
        i, j = np.nonzero(near >= np.maximum(np.maximum(self.best[rows, -1], self.least[rows]), -1.5)[:, None] - EPSILON)
        if not len(i):
            return
        exact = cosines(queries[rows[i]], self.x[own[j]])
        have = self.found[rows] >= 0
        row = np.concatenate([i, np.nonzero(have)[0]])
        score = np.concatenate([exact, self.best[rows][have]])
        place = np.concatenate([own[j], self.found[rows][have]])
        order = np.lexsort((self.ids[place], -score, row))
        row, score, place = row[order], score[order], place[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        self.best[rows[row[keep]], rank[keep]] = score[keep]
        self.found[rows[row[keep]], rank[keep]] = place[keep]


_TREE = pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("order", pa.binary()), ("span", pa.binary()), ("child", pa.binary()), ("place", pa.binary())])
_TREE_DDL = "shard int, dim int, ids binary, x binary, order binary, span binary, child binary, place binary"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_FOUND_DDL = "query_id long, vec_id long, score double"


def _plant(key, table: pa.Table) -> pa.Table:
    """The tree of a shard's vectors of one length, as a row."""
    rows = table.sort_by([("vec_id", "ascending")])
    tree = Tree(rows.column("vec_id").to_numpy(), matrix(rows.column("v")))
    arrays = [tree.ids, tree.x, tree.order, tree.span, tree.child, tree.place]
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays)], schema=_TREE)


def grown(row: dict) -> Tree:
    """A tree from its row."""
    read = lambda name, kind: np.frombuffer(row[name], kind)
    held = read("order", np.int64), read("span", float).reshape(-1, 4), read("child", np.int64).reshape(-1, 2), read("place", np.int64).reshape(-1, 2)
    return Tree(read("ids", np.int64), read("x", float).reshape(-1, row["dim"]), held=held)


def _search(key, trees: pa.Table, queries: pa.Table, k: int, factor: float) -> pa.Table:
    out = []
    if len(queries):
        query_ids, x = queries.column("query_id").to_numpy(), matrix(queries.column("v"))
        least = queries.column("least").to_numpy()
        for row in trees.to_pylist():  # one
            at, vec_id, score = grown(row).search(query_ids, x, k, factor, least)
            out.append(pa.table([pa.array(query_ids[at]), pa.array(vec_id), pa.array(score)], schema=_FOUND))
    return pa.concat_tables(out) if out else _FOUND.empty_table()


def nearest(queries: DataFrame, rows: DataFrame, k: int, factor: float = 1.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows nearest to every query, other than rows of the query's own id."""
    common.ship(rows.sparkSession)
    scratch = common.Scratch(rows.sparkSession, "trees")
    dim = F.size("v").alias("dim")
    held = vectors(rows)
    asked = scratch.save(vectors(queries).distinct().select(F.col("vec_id").alias("query_id"), dim, "v"), "queries")
    shards, blocks = max(1, -(-held.count() // SHARD)), max(1, -(-asked.count() // BLOCK))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    planted = held.select(shard.alias("shard"), dim, "vec_id", "v").groupBy("shard", "dim").applyInArrow(lambda key, t: _plant(key, t), _TREE_DDL)
    trees = scratch.save(planted, "trees")
    every = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    block = F.pmod(F.xxhash64(F.lit(7), "query_id"), F.lit(blocks)).cast("int").alias("block")
    home = F.pmod(F.xxhash64(F.lit(9), "query_id"), F.lit(shards)).cast("int")

    def through(sent: DataFrame, name: str) -> DataFrame:
        """Queries (query_id, dim, v, least, shard) through the trees of their shards."""
        met = every.groupBy("shard", "dim", "block").cogroup(sent.select("*", block).groupBy("shard", "dim", "block"))
        return scratch.save(met.applyInArrow(lambda key, t, q: _search(key, t, q, k, factor), _FOUND_DDL), name)

    found = through(asked.select("*", F.lit(-2.0).alias("least"), home.alias("shard")), "first")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if shards > 1:
        # Only the k-th best of a query that has k candidates already says how near others must be.
        bound = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).select("query_id", "least")
        bound = bound.join(asked.groupBy("query_id").count().filter("count = 1").select("query_id"), "query_id")  # rows that share an id have a bound each
        others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != home)
        sent = asked.join(bound, "query_id", "left").select("query_id", "dim", "v", F.coalesce("least", F.lit(-2.0)).alias("least"), F.explode(others).alias("shard"))
        found = found.unionByName(through(sent, "others"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every row whose id 50 divides, among all other rows, exactly (factor 1)."""
    rows = common.table(spark, sf_dir, "embeddings")
    return nearest(rows.filter(F.col("vec_id") % 50 == 0), rows, 5, 1.0)


ORACLE = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.v, e.v) AS score FROM e AS q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""
