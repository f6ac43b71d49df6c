"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A rollup is a folder of committed batches. A batch brings documents that are new, revised or deleted; each is counted
once, where it is read, by every tokenizer version. A batch commits two tables:

    ledger  doc_id, tokenizer, live, source, lang, tokens   what it says of each of its documents, by bucket of the doc_id
    deltas  source, lang, tokenizer, docs_added, tokens_added, docs_removed, tokens_removed

A delta takes away what the ledger held of a batch's documents before and adds what holds now, so totals are plain sums
over all batches, whatever their order of reading. Only the buckets that a batch touches are read, in the last snapshot
and the batches since: every `snapshot_every` batches the ledger's last word of each document and the sums of the deltas
are written as a snapshot, so neither a batch nor the totals read the whole history.

A batch is staged apart and renamed into place by its id as its last act, and so is a snapshot: what failed half-way or
ran on a lost executor leaves nothing that counts, and a batch that is delivered again finds its id and changes nothing.
One writer at a time.

Documents are known by doc_id. Rows of one batch that share an id are one document, and that with most tokens counts (of
those, the last by source and language); rows without an id are counted each for itself and can't be revised. Null and
empty texts have no tokens but are documents; a null source or language is a group of its own. Long texts are counted
whole. Deleting what isn't there changes nothing; an id that a batch both brings and deletes is brought. Empty tables make
an empty batch. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Files of a batch's deltas, which are a row for each group and so few.
DELTA_FILES = 4
#: Buckets of the ledger by doc_id: a batch reads and writes those it touches.
BUCKETS = 16
#: Batches after which a snapshot is written.
SNAPSHOT_EVERY = 8
_COUNTS = ("docs_added", "tokens_added", "docs_removed", "tokens_removed")
_LEDGER_DDL = "doc_id long, tokenizer string, live boolean, source string, lang string, tokens long"
_DELTAS_DDL = "source string, lang string, tokenizer string, " + ", ".join(f"{c} long" for c in _COUNTS)

_counters: dict[tuple, object] = {}


def counter(version: str, file: str):
    """A function from texts to their numbers of tokens, kept by the worker. Versions: `words`, or a tiktoken rank file."""
    if (version, file) not in _counters:
        if version == "words":
            _counters[version, file] = lambda texts: [len(t.encode().split()) for t in texts]
        else:
            import public_tokenizers
            import tiktoken

            with open(file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            tokenizer = tiktoken.Encoding(version, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            _counters[version, file] = lambda texts: [len(tokenizer.encode_ordinary(t)) for t in texts]
    return _counters[version, file]


def _count(batches, versions: dict[str, str]):
    for part in common.chunks(batches):
        texts = ["" if t is None else t for t in part.column("text").to_pylist()]
        for version, file in versions.items():
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "source", "lang")), pa.array([version] * len(texts), pa.string()), pa.array(counter(version, file)(texts), pa.int64())],
                ["doc_id", "source", "lang", "tokenizer", "tokens"],
            )


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str, versions: dict[str, str], buckets: int = BUCKETS, snapshot_every: int = SNAPSHOT_EVERY):
        self.spark, self.path, self.versions, self.buckets, self.snapshot_every = spark, path, versions, buckets, snapshot_every

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str) -> list[str]:
        where, fs = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _commit(self, staged: str, target: str) -> bool:
        source, fs = self._fs(staged)
        place, _ = self._fs(target)
        fs.mkdirs(place.getParent())
        if fs.exists(place) or not fs.rename(source, place):
            fs.delete(source, True)
            return False
        return True

    def batches(self) -> list[str]:
        """Ids of the committed batches, in the order of their commits."""
        return [n.partition("-")[2] for n in self._names("batches")]

    def _standing(self) -> list[tuple[int, str]]:
        """(number, folder) of the last snapshot, which has all batches before its number, and of the batches since."""
        snapshots = self._names("snapshots")
        first = int(snapshots[-1]) if snapshots else 0
        later = [(int(n.partition("-")[0]), f"{self.path}/batches/{n}") for n in self._names("batches")]
        return [(first - 1, f"{self.path}/snapshots/{n}") for n in snapshots[-1:]] + [(n, folder) for n, folder in later if n >= first]

    def _ledger(self, buckets: list[int] | None = None) -> DataFrame | None:
        """What stands, with `seq`, the number of the batch that said so. buckets: only those of them that there are."""
        out = None
        for number, folder in self._standing():
            where, fs = self._fs(f"{folder}/ledger")
            there = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()] if fs.exists(where) else []
            there = [n for n in there if n.startswith("bucket=") and (buckets is None or int(n[7:]) in buckets)]
            if there:
                rows = self.spark.read.schema(_LEDGER_DDL).parquet(*(f"{folder}/ledger/{n}" for n in there)).withColumn("seq", F.lit(number))
                out = rows if out is None else out.unionByName(rows)
        return out

    def _latest(self, rows: DataFrame) -> DataFrame:
        said = rows.groupBy("doc_id", "tokenizer").agg(F.max_by(F.struct("live", "source", "lang", "tokens"), "seq").alias("s"))
        return said.filter("s.live").select("doc_id", "tokenizer", "s.*")

    def _write_ledger(self, rows: DataFrame, path: str) -> None:
        """By bucket, each dealt to several tasks where there are more tasks than buckets. Spark merges those of little."""
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")
        share = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(max(1, common.spread(rows) // self.buckets)))
        rows.withColumn("bucket", bucket).repartition("bucket", share).write.partitionBy("bucket").parquet(path)

    def _deltas(self) -> DataFrame | None:
        folders = [f"{folder}/deltas" for _, folder in self._standing()]
        return self.spark.read.schema(_DELTAS_DDL).parquet(*folders) if folders else None

    def _sums(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("source", "lang", "tokenizer").agg(*(F.sum(c).cast("long").alias(c) for c in _COUNTS))

    def apply(self, batch_id: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Commit a batch of documents (doc_id, text, source, lang) and of doc_ids to delete. False: it was there."""
        if not re.fullmatch(r"[\w.=-]+", batch_id, re.ASCII):
            raise ValueError("a batch id consists of letters, digits and _ . = -")
        done = self.batches()
        if batch_id in done:
            return False
        common.ship(self.spark)
        staged, spare = (f"{self.path}/staging/{uuid.uuid4().hex}" for _ in range(2))
        new, loose = self.spark.createDataFrame([], _LEDGER_DDL), None
        if upserts is not None:
            versions = self.versions
            rows = upserts.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")))
            counted = rows.mapInArrow(lambda b: _count(b, versions), "doc_id long, source string, lang string, tokenizer string, tokens long")
            counted.write.parquet(spare)  # texts are read and counted once
            counted = self.spark.read.schema(counted.schema).parquet(spare)
            said = counted.filter("doc_id is not null").groupBy("doc_id", "tokenizer").agg(F.max(F.struct("tokens", "source", "lang")).alias("s"))
            new = said.select("doc_id", "tokenizer", F.lit(True).alias("live"), "s.source", "s.lang", "s.tokens")
            loose = counted.filter("doc_id is null")
        if deletes is not None:
            gone = deletes.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
            every = F.explode(F.array(*map(F.lit, self.versions)))
            gone = gone.select("doc_id", every.alias("tokenizer"), F.lit(False).alias("live"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(0).cast("long").alias("tokens"))
            new = new.unionByName(gone.join(new.select("doc_id").distinct(), "doc_id", "left_anti")) if upserts is not None else gone
        self._write_ledger(new, f"{staged}/ledger")
        where, fs = self._fs(f"{staged}/ledger")
        touched = [int(s.getPath().getName()[7:]) for s in fs.listStatus(where) if s.getPath().getName().startswith("bucket=")]
        group = ["source", "lang", "tokenizer"]

        def signed(rows: DataFrame, sign: str) -> DataFrame:
            one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
            given = {f"docs_{sign}": one, f"tokens_{sign}": F.col("tokens")}
            return rows.select(*group, *(given.get(c, none).alias(c) for c in _COUNTS))

        changes = self.spark.createDataFrame([], _DELTAS_DDL)
        if touched:
            new = self.spark.read.schema(_LEDGER_DDL).parquet(*(f"{staged}/ledger/bucket={n}" for n in touched))
            changes = signed(new.filter("live"), "added")
            before = self._ledger(touched)
            if before is not None:
                changes = changes.unionByName(signed(self._latest(before.join(new.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")), "removed"))
        if loose is not None:
            changes = changes.unionByName(signed(loose, "added"))
        self._sums(changes).coalesce(DELTA_FILES).write.parquet(f"{staged}/deltas")
        kept = batch_id not in self.batches() and self._commit(staged, f"{self.path}/batches/{len(done):08d}-{batch_id}")
        counted, fs = self._fs(spare)
        fs.delete(counted, True)
        if kept and len(self._standing()) > self.snapshot_every:
            self.snapshot()
        return kept

    def snapshot(self) -> bool:
        """Write what stands as one table by bucket, and the sums of all deltas. Older folders stay for their readers."""
        names = self._names("batches")
        if not names:
            return False
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        ledger = self._ledger()
        if ledger is not None:
            self._write_ledger(self._latest(ledger), f"{staged}/ledger")
        self._sums(self._deltas()).coalesce(DELTA_FILES).write.parquet(f"{staged}/deltas")
        return self._commit(staged, f"{self.path}/snapshots/{len(names):08d}")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens as they stand, and what was ever added and removed."""
        deltas = self._deltas()
        sums = self._sums(self.spark.createDataFrame([], _DELTAS_DDL) if deltas is None else deltas)
        return sums.select("source", "lang", "tokenizer", (F.col("docs_added") - F.col("docs_removed")).alias("docs"), (F.col("tokens_added") - F.col("tokens_removed")).alias("tokens"), *_COUNTS)


#: Documents whose id this divides are revised in the queries: two words more, another source; every other of them loses its language.
REVISED = 7


def _load_revise_take_down(spark: SparkSession, sf_dir: str, versions: dict[str, str]) -> DataFrame:
    """All of documents, delivered twice; a batch that revises texts, sources and languages; one that deletes what labels call toxic."""
    rollup = TokenRollup(spark, common.Scratch(spark, "rollup").path("counts"), versions)
    docs = common.table(spark, sf_dir, "documents")
    for _ in range(2):
        rollup.apply("load", docs)
    revised = docs.filter(F.col("doc_id") % REVISED == 0).withColumns(
        {
            "text": F.concat("text", F.lit("\nsecond edition")),
            "source": F.concat("source", F.lit(" (revised)")),
            "lang": F.when(F.col("doc_id") % (2 * REVISED) == 0, F.lit(None)).otherwise(F.col("lang")),
        }
    )
    rollup.apply("revision", revised)
    rollup.apply("takedown", deletes=common.table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"))
    return rollup.totals()


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by byte_bpe_50k and by words."""
    import public_tokenizers

    return _load_revise_take_down(spark, sf_dir, {"byte_bpe_50k": public_tokenizers.path("byte_bpe_50k.tiktoken"), "words": ""})


def word_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by words alone, which SQL can count."""
    return _load_revise_take_down(spark, sf_dir, {"words": ""})


ORACLE = rf"""WITH d AS (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n, text IS NULL AS bare FROM documents),
r AS (SELECT doc_id, source || ' (revised)' AS source, CASE WHEN doc_id % {2 * REVISED} = 0 THEN NULL ELSE lang END AS lang, CASE WHEN bare THEN 0 ELSE n + 2 END AS n FROM d WHERE doc_id % {REVISED} = 0),
gone AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
last AS (SELECT doc_id, source, lang, n FROM r UNION ALL SELECT doc_id, source, lang, n FROM d WHERE doc_id % {REVISED} <> 0),
e AS (SELECT source, lang, n, 1 AS sign FROM d UNION ALL SELECT source, lang, n, 1 FROM r
  UNION ALL SELECT source, lang, n, -1 FROM d WHERE doc_id % {REVISED} = 0 UNION ALL SELECT source, lang, n, -1 FROM last JOIN gone USING (doc_id))
SELECT source, lang, 'words' AS tokenizer, sum(sign)::BIGINT AS docs, sum(sign * n)::BIGINT AS tokens,
  sum((sign > 0)::BIGINT)::BIGINT AS docs_added, sum(CASE WHEN sign > 0 THEN n ELSE 0 END)::BIGINT AS tokens_added,
  sum((sign < 0)::BIGINT)::BIGINT AS docs_removed, sum(CASE WHEN sign < 0 THEN n ELSE 0 END)::BIGINT AS tokens_removed
FROM e GROUP BY source, lang"""
