"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Targets. Sources, in code point order with null last, weigh 5, 2, 1, repeating. The words of all documents are shared
out by weight; a target stops at MAX_REPEATS times its source's words and the excess is reshared by weight until no
target is above (water filling: one sort of the sources by cap / weight finds the level).

Whole documents. A source whose target is r times its words takes each document floor(r) times. What is left of the
target goes to further copies of whole documents in a fixed shuffled order (by md5 of the doc_id and the text), until
one doesn't fit; documents that still fit into the gap follow in the same order, FILLS - 1 times. So a source never goes
over its target, and a gap that is left is smaller than the document at which the last round stopped.

Curriculum. Every source has a schedule: its share at equally spaced points of training, linear between them, which
is scaled to integrate to one. The copy that covers words c to c + size of a source's taken words is due where the
integrated schedule reaches the middle of that span; the inverse of a piecewise quadratic is closed. Documents are
range-sorted by that position.

Rows alike in source, doc_id and text are one class with a number of rows, whatever that number, before anything is
ordered or summed. Running sums never need a source in one task: a source is cut into buckets by its md5 order; bucket
totals give offsets, and classes are summed inside a bucket only.

Null and empty texts have size 0; long texts are counted whole. A source of size 0 has target 0 and takes nothing. Rows
that share a doc_id, or have none, are mixed each for itself; of rows alike in all that counts, which are taken once
more than others is of no effect on the result. Ties in the order fall to the smaller doc_id and size. Empty tables give
no rows. Other columns pass through curriculum(), where a column `mix_position` is replaced, and are ignored by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
FILLS = 3
#: Hex digits of the md5 that make a bucket: 4096 buckets for each source.
BUCKET_DIGITS = 3
#: Rows of a class that are given back at a time.
CHUNK = 4096
#: Shares over training by weight: heavy sources fade out, light ones come late.
SCHEDULES = {5: (1.25, 1.0, 0.75), 2: (1.0, 1.0, 1.0), 1: (0.5, 1.0, 1.5)}


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, src, weight, target). One row for each source goes to one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("src", F.row_number().over(by_name) - 1)
    picks = F.array(*map(F.lit, weights))
    ranked = ranked.withColumn("weight", F.element_at(picks, (F.col("src") % len(weights) + 1).cast("int")).cast("long"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    cap = max_repeats * F.col("source_size")
    level = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("all_words"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("below_words"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("below_weight"),
    )
    left = F.col("all_words") - max_repeats * F.col("below_words")
    level = level.withColumn("capped", cap * (F.col("all_weight") - F.col("below_weight")) < left * F.col("weight"))
    level = level.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(everything), F.lit(0)).alias("capped_words"),
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(everything), F.lit(0)).alias("capped_weight"),
    )
    share = (F.col("all_words") - max_repeats * F.col("capped_words")) * F.col("weight") / F.nullif(F.col("all_weight") - F.col("capped_weight"), F.lit(0))
    return level.select("source", "source_size", "src", "weight", F.when(F.col("capped"), cap.cast("double")).otherwise(share).alias("target"))


def running(rows: DataFrame, value: Column) -> DataFrame:
    """rows with `before`: the sum of `value` over a source's rows that come earlier in its order.

    Totals are summed on three levels, so that no task sees more of a source than the rows of one bucket, the 256
    buckets of one first digit, or its 16 first digits.
    """
    rows = rows.withColumn("_v", value)
    totals = rows.groupBy("src", "bucket").agg(F.sum("_v").alias("_t")).withColumn("_digit", F.substring("bucket", 1, 1))
    digits = totals.groupBy("src", "_digit").agg(F.sum("_t").alias("_t"))
    digits = digits.select("src", "_digit", (F.sum("_t").over(Window.partitionBy("src").orderBy("_digit")) - F.col("_t")).alias("_d"))
    buckets = Window.partitionBy("src", "_digit").orderBy("bucket")
    offsets = totals.withColumn("_w", F.sum("_t").over(buckets) - F.col("_t")).join(digits, ["src", "_digit"]).select("src", "bucket", (F.col("_w") + F.col("_d")).alias("_o"))
    inside = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size", "alike").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_b", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return summed.join(offsets, ["src", "bucket"]).withColumn("before", F.col("_b") + F.col("_o")).drop("_v", "_b", "_o")


def invert(schedule: tuple, u: Column) -> Column:
    """Where in training (0 to 1) the integral of a schedule, linear between equally spaced points, reaches u of its whole."""
    n = len(schedule) - 1
    whole = sum((a + b) / 2 for a, b in zip(schedule, schedule[1:])) / n
    out, done = None, 0.0
    for i, (a, b) in enumerate(zip(schedule, schedule[1:])):
        a, slope, area = a / whole, (b - a) / whole * n, (a + b) / 2 / whole / n
        need = u - F.lit(done)
        step = need / F.lit(a) if slope == 0 else (F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * need, F.lit(0.0))) - F.lit(a)) / F.lit(slope)
        here = F.lit(i / n) + step
        done += area
        out = F.when(u <= F.lit(done), here) if out is None else out.when(u <= F.lit(done), here) if i < n - 1 else out.otherwise(here)
    return out if n > 1 else here


def _keyed(docs: DataFrame) -> dict[str, Column]:
    """What tells classes of rows apart: doc_id, source, size, an md5 of id and text for the order, and a hash of all other columns."""

    def plain(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return plain(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(plain(f.dataType) for f in kind.fields)
        return not isinstance(kind, (T.MapType, T.VariantType))

    others = [f"`{f.name}`" for f in docs.schema.fields if f.name not in ("doc_id", "source", "text") and plain(f.dataType)]
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return {"doc_id": doc_id, "source": F.col("source").cast("string"), "size": words(text), "key": F.md5(F.encode(name, "UTF-8")), "alike": F.xxhash64(F.lit(1), *others)}


_CLASS = ["doc_id", "source", "size", "key", "alike"]


def _classes(docs: DataFrame, scratch: common.Scratch, weights: tuple, max_repeats: int) -> DataFrame:
    """One row for each class of n rows alike: how often the mix takes its rows, and where their copies lie.

    Each of the n rows is taken `base` times; in round i of the fills e<i> of them get one copy more. The rows' first
    copies begin at own_before, own_before + size, .. of the source's taken words, and later ones at source_size and its
    multiples from there; those of round i at s<i>, s<i> + size, ..
    """
    rows = docs.select(*(c.alias(n) for n, c in _keyed(docs).items())).groupBy(*_CLASS).agg(F.count("*").alias("n"))
    rows = scratch.save(rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)), "sizes")
    sources = scratch.apart(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, max_repeats), "sources", files=1)
    sources = sources.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumnRenamed("source", "name")
    rows = rows.join(sources, rows["source"].eqNullSafe(sources["name"])).drop("name")
    rows = running(rows, F.col("size") * F.col("n")).withColumnRenamed("before", "own_before")
    rows = rows.withColumn("extra", F.lit(0).cast("long"))
    room = F.col("target") - F.col("base") * F.col("source_size")
    for i in range(FILLS):
        if i:
            gaps = scratch.apart(rows.groupBy("src").agg(F.sum(F.col("extra") * F.col("size")).alias("given")), f"gaps{i}", files=1)
            rows = rows.join(gaps, "src")
            left = F.when((F.col("size") > 0) & (F.col("size") <= room - F.col("given")), F.col("n") - F.col("extra")).otherwise(0)
            rows = running(rows.withColumn("left", left), F.col("size") * F.col("left"))
        else:
            rows = rows.withColumns({"given": F.lit(0).cast("long"), "left": F.when(F.col("size") > 0, F.col("n")).otherwise(0), "before": F.col("own_before")})
        fits = F.floor((room - F.col("given") - F.col("before")) / F.nullif(F.col("size"), F.lit(0)))
        more = F.greatest(F.least(F.coalesce(fits, F.lit(0)), F.col("left")), F.lit(0)).cast("long")
        rows = rows.withColumns({f"e{i}": more, f"s{i}": F.col("base") * F.col("source_size") + F.col("given") + F.col("before")})
        rows = rows.withColumn("extra", F.col("extra") + F.col(f"e{i}")).drop("given", "left", "before")
        rows = scratch.save(rows, f"fill{i}")
        if i:
            scratch.drop(f"fill{i - 1}")
    scratch.drop("sizes")
    copies = F.when(F.col("size") > 0, F.col("base") * F.col("n") + F.col("extra")).otherwise(0)
    taken = scratch.apart(rows.groupBy("src").agg(F.sum(copies * F.col("size")).alias("source_taken")), "taken", files=1)
    return rows.join(taken, "src").withColumn("copies", copies)


def _counted(rows: DataFrame, number: Column, name: str) -> DataFrame:
    """Each row `number` times, with its place from 0 as `name`; in chunks, so that no array is long."""
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), (number - 1).cast("long"), F.lit(CHUNK).cast("long")))
    rows = rows.filter(number > 0).withColumn("_chunk", chunks)
    inside = F.explode(F.sequence(F.col("_chunk"), F.least(F.col("_chunk") + (CHUNK - 1), (number - 1).cast("long"))))
    return rows.withColumn(name, inside).drop("_chunk")


def _extra(row: Column, c=F.col) -> Column:
    """Where further copy number `row` of a class begins; null if there are fewer. c: column by name."""
    out, seen = None, F.lit(0)
    for i in range(FILLS):
        here = c(f"s{i}") + (row - seen) * c("size")
        upto = seen + c(f"e{i}")
        out = F.when(row < upto, here) if out is None else out.when(row < upto, here)
        seen = upto
    return out


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules: dict = SCHEDULES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, weight, target, taken, copies, first_position.

    `weights` repeat over the sources in code point order; `schedules`: for each weight its shares over training.
    """
    scratch = common.Scratch(docs.sparkSession, "mix")
    rows = _counted(_classes(docs, scratch, weights, max_repeats), F.col("n"), "row")
    rows = rows.withColumn("extra_before", _extra(F.col("row")))
    own = F.when(F.col("size") > 0, F.col("base") + F.col("extra_before").isNotNull().cast("long")).otherwise(0)
    first = F.when(F.col("base") > 0, F.col("own_before") + F.col("row") * F.col("size")).otherwise(F.col("extra_before"))
    return rows.select("doc_id", "source", "size", "source_size", "weight", "target", (own * F.col("size")).alias("taken"), own.alias("copies"), position(first, schedules).alias("first_position"))


def position(start: Column, schedules: dict = SCHEDULES, c=F.col) -> Column:
    """Position in training of the copy whose first word is number `start` of its source's taken words; null if there is none."""
    u = (start + c("size") / 2) / F.nullif(c("source_taken"), F.lit(0))
    out = None
    for weight, schedule in schedules.items():
        case = c("weight") == weight
        out = F.when(case, invert(schedule, u)) if out is None else out.when(case, invert(schedule, u))
    return F.when(c("size") > 0, out)


def curriculum(docs: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules: dict = SCHEDULES) -> DataFrame:
    """The documents as the mix takes them: a row for each copy, with its `mix_position`, range-sorted by that.

    Of rows alike in every column one is read, and given as often as the mix takes them together.
    """
    scratch = common.Scratch(docs.sparkSession, "mix")
    docs = docs.drop("mix_position")
    plan = _classes(docs, scratch, weights, max_repeats).filter("copies > 0").drop("bucket", "src", "extra", "target")
    plan = scratch.save(plan.select(*(F.col(name).alias(f"__mix_{name}") for name in plan.columns)), "plan")
    c = lambda name: F.col(f"__mix_{name}")
    key = [name for name in _CLASS if name != "size"]  # which follows from the text
    own = docs.withColumns({f"__own_{name}": column for name, column in _keyed(docs).items() if name in key})
    same = None
    for name in key:
        here = F.col(f"__own_{name}").eqNullSafe(c(name))
        same = here if same is None else same & here
    found = own.join(plan.hint("shuffle_hash"), same).drop(*(f"__own_{name}" for name in key))
    if plan.filter("__mix_n > 1").head(1):
        many = found.filter("__mix_n > 1").groupBy(*(f"__mix_{name}" for name in key)).agg(F.first(F.struct(*found.columns)).alias("__mix_one")).select("__mix_one.*")
        found = found.filter("__mix_n = 1").unionByName(many)
    found = _counted(found, c("copies"), "__mix_copy")
    layer, row, further = F.floor(c("copy") / c("n")), c("copy") % c("n"), c("copy") - c("base") * c("n")
    start = F.when(layer < c("base"), layer * c("source_size") + c("own_before") + row * c("size")).otherwise(_extra(further, c))
    return found.withColumn("mix_position", position(start, schedules, c)).select(*docs.columns, "mix_position").orderBy("mix_position", "doc_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, in training order."""
    docs = common.table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "first_position").orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


_FILL = """, g{i} AS (SELECT src, coalesce(sum(CASE WHEN extra THEN size ELSE 0 END), 0)::BIGINT AS given FROM f{p} GROUP BY src),
c{i} AS (SELECT f{p}.*, given, (NOT extra AND size > 0 AND size <= target - base * source_size - given) AS small FROM f{p} JOIN g{i} USING (src)),
r{i} AS (SELECT *, coalesce(sum(CASE WHEN small THEN size ELSE 0 END) OVER (PARTITION BY src ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b{i} FROM c{i}),
f{i} AS (SELECT doc_id, size, key, src, weight, source_size, target, base, own_before,
  extra OR (small AND b{i} + size <= target - base * source_size - given) AS extra,
  CASE WHEN small AND b{i} + size <= target - base * source_size - given THEN base * source_size + given + b{i} ELSE extra_before END AS extra_before FROM r{i})"""


def _sql_invert(schedule: tuple, u: str) -> str:
    n = len(schedule) - 1
    whole = sum((a + b) / 2 for a, b in zip(schedule, schedule[1:])) / n
    cases, done = [], 0.0
    for i, (a, b) in enumerate(zip(schedule, schedule[1:])):
        a, slope, area = a / whole, (b - a) / whole * n, (a + b) / 2 / whole / n
        step = f"({u} - {done!r}::DOUBLE) / {a!r}::DOUBLE" if slope == 0 else f"(sqrt(greatest({a * a!r}::DOUBLE + {2 * slope!r}::DOUBLE * ({u} - {done!r}::DOUBLE), 0)) - {a!r}::DOUBLE) / {slope!r}::DOUBLE"
        done += area
        cases.append((f"WHEN {u} <= {done!r}::DOUBLE THEN " if i < n - 1 else "ELSE ") + f"{i / n!r}::DOUBLE + {step}")
    return "CASE " + " ".join(cases) + " END"


ORACLE = (
    r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS src FROM s0),
s2 AS (SELECT *, [5, 2, 1][src % 3 + 1]::BIGINT AS weight FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS tw, (sum(weight) OVER ())::BIGINT AS tv,
  coalesce(sum(source_size) OVER o, 0)::BIGINT AS bw, coalesce(sum(weight) OVER o, 0)::BIGINT AS bv
  FROM s2 WINDOW o AS (ORDER BY source_size / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, 3 * source_size * (tv - bv) < (tw - 3 * bw) * weight AS capped FROM s3),
s5 AS (SELECT *, coalesce(sum(CASE WHEN capped THEN source_size END) OVER (), 0)::BIGINT AS cw, coalesce(sum(CASE WHEN capped THEN weight END) OVER (), 0)::BIGINT AS cv FROM s4),
s AS (SELECT source, src, source_size, weight, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE ((tw - 3 * cw) * weight)::DOUBLE / nullif(tv - cv, 0) END AS target FROM s5),
j AS (SELECT d.doc_id, d.size, d.key, s.src, s.weight, s.source_size, s.target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS base FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
r0 AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY src ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS own_before FROM j),
f0 AS (SELECT *, size > 0 AND own_before + size <= target - base * source_size AS extra, CASE WHEN size > 0 AND own_before + size <= target - base * source_size THEN base * source_size + own_before END AS extra_before FROM r0)"""
    + "".join(_FILL.format(i=i, p=i - 1) for i in range(1, FILLS))
    + f""", t AS (SELECT src, sum((base + extra::BIGINT) * size)::BIGINT AS source_taken FROM f{FILLS - 1} GROUP BY src),
u AS (SELECT *, (CASE WHEN base > 0 THEN own_before ELSE extra_before END + size / 2) / nullif(source_taken, 0) AS u FROM f{FILLS - 1} JOIN t USING (src))
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN (base + extra::BIGINT) * size ELSE 0 END AS taken,
  CASE WHEN size > 0 THEN CASE """
    + " ".join(f"WHEN weight = {w} THEN {_sql_invert(x, 'u')}" for w, x in SCHEDULES.items())
    + " END END AS first_position FROM u"
)
