"""A store of log lines on any file system Spark can write: immutable segments under one versioned manifest.

    <root>/manifest/v<N>.json   what is there; the highest N holds. Written last, and only if no one else wrote it.
    <root>/segments/<id>/lines      block_id, line_id, pack_id, line, tokens; a page of a sealed file holds about a pack
    <root>/segments/<id>/lists      block_id, term, num_ids, ids; bucketed by block_id, sorted by term
    <root>/segments/<id>/blocks     what is known of each sealed block

Lines get a block_id and a line_id as they arrive and keep them. A block is in one of three tiers, which the manifest
alone decides, so every line is seen in exactly one of them: *active* (the last block, not yet full), *flushing* (full,
not yet indexed) and *sealed* (rewritten in order, with its lists). Lines of the first two lie in the segments of their
ingests, sealed ones in the segments of their seals. A reader holds one version of the manifest: segments never change.

A search of sealed blocks reads the lists of the query's terms, a few pages of each bucket, and combines them inside each
block; as a block lies in one bucket, nothing is shuffled for it. Its total is known from the lists alone. The lines of
the first `limit` matches are then fetched by block and pack, which prunes files to the pages that hold them.

The manifest has an entry for each segment, not for each block, and so grows with the number of ingests only; `compact`
merges sealed segments of about one size.

The manifest's rename must be atomic and must fail where the name is taken, as on HDFS and local disks; a store on an
object store needs one writer at a time.

Lines are on disk before an ingest returns, so the active block outlives its process. An ingest with a batch id that
was taken before changes nothing, so a stream that repeats a batch after a failure stores it once.
"""

from __future__ import annotations

import itertools
import json
import math
import threading
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.json_lines import normalize_line, prepare
from ..functions.text import tokens
from ..plans.compile import BLOCK, balanced, fetch, from_lists, predicate
from ..plans.query import Query
from .blocks import assign_blocks, block_metadata
from .postings import block_lists
from .search import SearchResult, as_query

_LINES = "block_id long, line_id int, pack_id int, line string, tokens array<string>"
_LISTS = "block_id long, term string, num_ids long, ids array<int>"
_BLOCKS = "block_id long, num_lines long, rows_per_pack int, num_packs int, data_size long, idx_entries long"
ORDER = ["tier", "block_id", "line_id"]
#: Order of the tiers in results.
ACTIVE, FLUSHING, SEALED = 0, 1, 2
#: Matches whose places are gathered in the driver to prune the fetch of their lines; for more the lines are joined.
PICKED = 2_000
#: Segments of about one size that compact() merges.
FAN_IN = 4


class Ingested(int):
    """The number of lines that an ingest stored, and the blocks that it filled."""

    flushed_blocks: range = range(0)


@dataclass
class Segment:
    """Blocks first to last (both included) of one write; sealed segments hold their blocks whole."""

    id: str
    first: int
    last: int
    lines: int
    #: Buckets of a sealed segment's lists.
    buckets: int = 1


@dataclass
class Manifest:
    version: int = 0
    active_block: int = 0
    active_lines: int = 0
    sealed_before: int = 0
    hot: list[Segment] = field(default_factory=list)
    sealed: list[Segment] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, text: str) -> "Manifest":
        held = json.loads(text)
        return cls(**{**held, "hot": [Segment(**s) for s in held["hot"]], "sealed": [Segment(**s) for s in held["sealed"]]})


class Conflict(RuntimeError):
    """Someone else wrote the same version of the manifest."""


class Store:
    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings or Settings.from_env()
        prepare(spark)
        self.manifest = self._latest()
        self._lock, self._sealing = threading.RLock(), threading.Lock()

    # Manifest

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _latest(self) -> Manifest:
        folder, fs = self._fs("manifest")
        if not fs.exists(folder):
            return Manifest()
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        versions = sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))
        if not versions:
            return Manifest()
        return Manifest.load(self.spark.read.option("wholetext", True).text(f"{self.root}/manifest/v{versions[-1]}.json").head()[0])

    def refresh(self) -> None:
        self.manifest = self._latest()

    def _commit(self, new: Manifest) -> None:
        """Make a manifest the current one. It is written apart and renamed, which fails if its version is taken."""
        new.version = self.manifest.version + 1
        target, fs = self._fs(f"manifest/v{new.version}.json")
        staged, _ = self._fs(f"manifest/.{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        out = fs.create(staged, False)
        out.write(json.dumps(asdict(new)).encode())
        out.close()
        if fs.exists(target) or not fs.rename(staged, target):
            fs.delete(staged, False)
            raise Conflict(f"version {new.version} of {self.root} was written by someone else")
        self.manifest = new

    def _copy(self) -> Manifest:
        return Manifest.load(json.dumps(asdict(self.manifest)))

    # Ingest

    def ingest(self, raw: DataFrame, line: str = "line", order: list[str] | None = None, source: str | None = None, batch_id: int | None = None) -> Ingested:
        """Store the lines of a DataFrame, normalized, and seal the blocks they fill. Gives the number of lines, and which
        blocks they filled.

        `order` names columns that put the lines in order; without it they keep the order in which Spark reads them.
        Null lines are left out. With `source` and `batch_id`, a batch at or below the source's last is left out whole.
        """
        stored = self.append(raw, line, order, source, batch_id)
        if self.manifest.sealed_before < self.manifest.active_block:
            self.seal()
        return stored

    def append(self, raw: DataFrame, line: str = "line", order: list[str] | None = None, source: str | None = None, batch_id: int | None = None) -> Ingested:
        """Store lines; full blocks are left in the flushing tier."""
        with self._lock:
            before = self.manifest.active_block
            stored = Ingested(self._append(raw, line, order, source, batch_id))
            stored.flushed_blocks = range(before, self.manifest.active_block)
            return stored

    def _append(self, raw: DataFrame, line: str, order: list[str] | None, source: str | None, batch_id: int | None) -> int:
        now = self._copy()
        if source is not None and now.batches.get(source, -1) >= batch_id:
            return 0
        lines = raw.filter(F.col(line).isNotNull())
        if order:
            lines = lines.repartitionByRange(*order).sortWithinPartitions(*order)
        lines = lines.select(normalize_line(line).alias("line")).withColumn("at", F.monotonically_increasing_id())
        # Written once, as the order of reading may not repeat; ids of rows then follow from one count a partition.
        name = uuid.uuid4().hex[:12]
        staged = f"{self.root}/staging/{name}"
        lines.write.parquet(staged)
        lines = self.spark.read.schema("line string, at long").parquet(staged)
        sizes = sorted((r["part"], r["count"]) for r in lines.groupBy(F.shiftright("at", 33).alias("part")).count().collect())
        count = sum(n for _, n in sizes)
        if count:
            starts, at = [], now.active_lines
            for part, n in sizes:
                starts.append((part, at))
                at += n
            starts = F.broadcast(self.spark.createDataFrame(starts, "part long, start long"))
            numbered = lines.withColumn("part", F.shiftright("at", 33)).join(starts, "part").select("line", (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("line_no"))
            placed = assign_blocks(numbered, self.settings.block_rows, self.settings.pack_rows, now.active_block)
            placed.withColumn("tokens", tokens("line")).select("block_id", "line_id", "pack_id", "line", "tokens").write.option("compression", "zstd").parquet(f"{self.root}/segments/{name}/lines")
            first = now.active_block
            now.active_block += (now.active_lines + count) // self.settings.block_rows
            now.active_lines = (now.active_lines + count) % self.settings.block_rows
            now.hot.append(Segment(name, first, now.active_block if now.active_lines else now.active_block - 1, count))
        path, fs = self._fs(f"staging/{name}")
        fs.delete(path, True)
        if source is not None:
            now.batches[source] = batch_id
        if count or source is not None:
            self._commit(now)
        return count

    def seal(self) -> int:
        """Move the flushing blocks to the sealed tier: ordered lines, lists and metadata. Gives the number of blocks.

        Lines may be appended meanwhile; only the change of the manifest waits for them.
        """
        with self._sealing:
            now = self._copy()
            first, last = now.sealed_before, now.active_block - 1
            if last < first:
                return 0
            segment = self._write_sealed(self._hot(now).filter(F.col("block_id").between(first, last)).drop("tier"), first, last)
            with self._lock:
                now = self._copy()
                now.sealed.append(segment)
                now.sealed_before = last + 1
                now.hot = [s for s in now.hot if s.last > last]
                self._commit(now)
            return last - first + 1

    def _write_sealed(self, lines: DataFrame, first: int, last: int, lists: DataFrame | None = None) -> Segment:
        name = uuid.uuid4().hex[:12]
        path = f"{self.root}/segments/{name}"
        ordered = lines.repartitionByRange("block_id", "line_id").sortWithinPartitions("block_id", "line_id")
        ordered.write.option("compression", "zstd").option("parquet.page.row.count.limit", str(self.settings.pack_rows)).parquet(f"{path}/lines")
        lines = self.spark.read.schema(_LINES).parquet(f"{path}/lines")
        buckets = max(1, min(last - first + 1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        lists = block_lists(lines) if lists is None else lists
        lists.repartition(buckets, "block_id").write.format("parquet").option("compression", "zstd").option("path", f"{path}/lists").bucketBy(buckets, "block_id").sortBy("term", "block_id").saveAsTable(_table(name))
        segment = Segment(name, first, last, 0, buckets)
        terms = self._lists(segment).filter(F.col("term") != BLOCK).groupBy("block_id").agg(F.count("*").alias("idx_entries"))
        known = block_metadata(lines, self.settings.pack_rows).join(terms, "block_id", "left").withColumn("idx_entries", F.coalesce("idx_entries", F.lit(0)))
        known.write.parquet(f"{path}/blocks")
        segment.lines = self.spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").agg(F.sum("num_lines")).head()[0]
        return segment

    def _lists(self, segment: Segment) -> DataFrame:
        """A sealed segment's lists, as a table that knows its buckets. Sessions that didn't write it enter it in their catalog."""
        name = _table(segment.id)
        if not self.spark.catalog.tableExists(name):
            place = f"{self.root}/segments/{segment.id}/lists".replace("'", "''")
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_LISTS}) USING parquet CLUSTERED BY (block_id) SORTED BY (term, block_id) INTO {segment.buckets} BUCKETS LOCATION '{place}'")
        return self.spark.table(name)

    def flush(self) -> bool:
        """Seal everything, the active block as well, however short; the next line begins a new block. False: nothing was open."""
        with self._lock:
            opened = self.manifest.active_lines > 0
            if opened:
                now = self._copy()
                now.active_block += 1
                now.active_lines = 0
                self._commit(now)
        return self.seal() > 0 or opened

    def compact(self, fan_in: int = FAN_IN, full: bool = False) -> int:
        """Merge runs of `fan_in` or more neighbouring sealed segments of one size tier, a tier being a factor of `fan_in`, so
        that a line is rewritten a number of times that grows with the logarithm of the store; `full`: all into one. Gives
        the number merged; files of old segments stay for their readers."""
        with self._sealing:
            now = self._copy()
            tier = lambda s: 0 if full else int(math.log(max(s.lines, 1), fan_in))
            runs = [list(run) for _, run in itertools.groupby(now.sealed, tier)]
            least, merged = 2 if full else fan_in, 0
            kept: list[Segment] = []
            for run in runs:
                if len(run) < least:
                    kept += run
                    continue
                lists = reduce(DataFrame.unionByName, map(self._lists, run))
                kept.append(self._write_sealed(self._read(run, "lines", _LINES), run[0].first, run[-1].last, lists))
                merged += len(run)
            if merged:
                with self._lock:
                    now = self._copy()
                    now.sealed = kept
                    self._commit(now)
            return merged

    def vacuum(self) -> int:
        """Delete segments that the manifest no longer names. Call it when no reader of an older version is left."""
        folder, fs = self._fs("segments")
        if not fs.exists(folder):
            return 0
        named = {s.id for s in (*self.manifest.hot, *self.manifest.sealed)}
        old = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in named]
        for path in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {_table(path.getName())}")
            fs.delete(path, True)
        return len(old)

    # Reading

    def _read(self, segments: list[Segment], table: str, schema: str) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/segments/{s.id}/{table}" for s in segments))

    def _hot(self, manifest: Manifest) -> DataFrame:
        """Lines not sealed. A segment may also hold blocks that were sealed since."""
        rows = self._read(manifest.hot, "lines", _LINES).filter(F.col("block_id") >= manifest.sealed_before)
        return rows.withColumn("tier", F.when(F.col("block_id") < manifest.active_block, FLUSHING).otherwise(ACTIVE))

    def _sealed(self, manifest: Manifest) -> DataFrame:
        return self._read(manifest.sealed, "lines", _LINES).withColumn("tier", F.lit(SEALED))

    def lines(self) -> DataFrame:
        """All lines of this version: block_id, line_id, pack_id, line, tokens, tier."""
        return self._hot(self.manifest).unionByName(self._sealed(self.manifest))

    def lists(self) -> DataFrame:
        """block_id, term, num_ids, ids of the sealed blocks."""
        found = [self._lists(s).filter(F.col("term") != BLOCK) for s in self.manifest.sealed]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], _LISTS)

    def postings(self) -> DataFrame:
        """term, block_id, line_id of the sealed blocks."""
        return self.lists().select("term", "block_id", F.explode("ids").alias("line_id"))

    def blocks(self) -> DataFrame:
        """block_id, num_lines, rows_per_pack, num_packs, data_size, tier, idx_entries (terms, in sealed blocks). What was
        sealed was counted then; only lines that are not are counted now."""
        tier = F.when(F.col("block_id") < self.manifest.active_block, "flushing").otherwise("active")
        hot = block_metadata(self._hot(self.manifest), self.settings.pack_rows).withColumns({"idx_entries": F.lit(0).cast("long"), "tier": tier})
        return hot.unionByName(self._read(self.manifest.sealed, "blocks", _BLOCKS).withColumn("tier", F.lit("sealed")))

    def block_ids(self) -> DataFrame:
        return self._read(self.manifest.sealed, "blocks", _BLOCKS).select("block_id").orderBy("block_id")

    def search(self, query: Query | str, limit: int | None = None, indexed: bool = True) -> SearchResult:
        """All tiers, as of this version. `indexed`: sealed blocks are searched through their lists, else by their tokens."""
        query = as_query(self.spark, query)
        if not indexed:
            return SearchResult(self.lines().filter(predicate(query, F.col("tokens"))).select(*ORDER, "line"), ORDER, limit)
        found = [from_lists(query, self._lists(s)) for s in self.manifest.sealed]
        found = reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], "block_id long, ids array<int>")
        hot = self._hot(self.manifest).filter(predicate(query, F.col("tokens"))).select(*ORDER, "line")
        return StoreResult(hot, found, self._sealed(self.manifest), ORDER, limit, pack_rows=self.settings.pack_rows)


def _table(segment: str) -> str:
    return f"sievelog_lists_{segment}"


class StoreResult(SearchResult):
    """What a search of a store finds: lines of open blocks, and places in sealed ones, whose lines are fetched as wanted."""

    def __init__(self, hot: DataFrame, found: DataFrame, sealed: DataFrame, order: list[str], limit: int | None, pack_rows: int):
        self.hot, self.found, self.sealed, self.order, self.limit, self.line, self.pack_rows = hot, found, sealed, order, limit, "line", pack_rows

    @property
    def total(self) -> int:
        """From the lists alone; no line of a sealed block is read."""
        return self.hot.count() + (self.found.agg(F.sum(F.size("ids"))).head()[0] or 0)

    @property
    def matches(self) -> DataFrame:
        keys = self.found.select("block_id", F.explode("ids").alias("line_id"))
        return self.hot.unionByName(fetch(self.sealed, keys).select(*self.order, "line"))

    @property
    def rows(self) -> DataFrame:
        if self.limit is None or self.limit > PICKED:
            ordered = self.matches.orderBy(*self.order)
            return ordered if self.limit is None else ordered.limit(self.limit)
        # At most `limit` places of each block go on, and of these `limit` to the driver.
        first = self.found.select("block_id", F.explode(F.slice("ids", 1, max(1, self.limit))).alias("line_id")).orderBy("block_id", "line_id").limit(self.limit)
        places: dict[tuple[int, int], list[int]] = {}
        for r in first.collect():
            places.setdefault((r["block_id"], r["line_id"] // self.pack_rows), []).append(r["line_id"])
        wanted = [(F.col("block_id") == b) & (F.col("pack_id") == p) & F.col("line_id").between(min(ids), max(ids)) & F.col("line_id").isin(ids) for (b, p), ids in places.items()]
        sealed = self.sealed.filter(balanced(Column.__or__, wanted) if wanted else F.lit(False)).select(*self.order, "line")
        return self.hot.orderBy(*self.order).limit(self.limit).unionByName(sealed).orderBy(*self.order).limit(self.limit)
