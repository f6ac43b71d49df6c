import duckdb
import pytest
from pyspark.sql import functions as F

from sievelog.llm import mixing


def water_fill(sizes):
    """Targets by sharing out again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        whole = sum(weight[s] for s in open_)
        share = {s: target[s] + left * weight[s] / whole for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] = share[s]
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 30, None: 7}, {"a": 1, "b": 1, "c": 1, "d": 5000}, {"a": 0, "b": 9}, {None: 4}, {"a": 0}, {f"s{i:02}": i * i % 37 for i in range(25)}])
def test_targets(spark, sizes):
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = water_fill(sizes)
    for r in rows:
        assert abs((r["target"] or 0.0) - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])


def make(spark, n=600):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 90)), f"s{i % 7}" if i % 3 else "hot") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_taken_words_meet_the_targets(spark):
    rows = mixing.mix(make(spark)).collect()
    by = {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and r["taken"] % r["size"] == 0
        by.setdefault(r["source"], [r["target"], r["source_size"], 0])[2] += r["taken"]
    for target, size, taken in by.values():
        assert taken <= target + 1e-6 and taken >= 0.97 * target
    assert sum(t for t, _, _ in by.values()) == pytest.approx(sum(s for _, s, _ in by.values()))
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(make(spark).repartition(7)).collect()), key=str)


def test_schedules_integrate():
    """Inverting the integral at its own values gives the place back."""
    for schedule in [*mixing.SCHEDULES.values(), (0.0, 1.0, 0.2, 3.0)]:
        n, whole = len(schedule) - 1, sum((a + b) / 2 for a, b in zip(schedule, schedule[1:])) / (len(schedule) - 1)
        con = duckdb.connect()
        done = 0.0
        for i, (a, b) in enumerate(zip(schedule, schedule[1:])):
            for part in (0.25, 0.5, 1.0):
                area = done + (a * part + (b - a) * part * part / 2) / n / whole
                got = con.sql(f"SELECT {mixing._sql_invert(schedule, 'u')} FROM (SELECT {area!r}::DOUBLE AS u)").fetchall()[0][0]
                assert got == pytest.approx((i + part) / n, abs=1e-6)
            done += (a + b) / 2 / n / whole


def test_curriculum(spark):
    docs = make(spark)
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    rows = mixing.curriculum(docs).collect()
    assert [r["mix_position"] for r in rows] == sorted(r["mix_position"] for r in rows) and 0 <= rows[0]["mix_position"] and rows[-1]["mix_position"] <= 1
    counts = {}
    for r in rows:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert counts == {i: n for i, n in taken.items() if n}
    heavy = [r["mix_position"] for r in rows if r["source"] == "hot"]  # weight 5 fades out
    assert sum(heavy) / len(heavy) < 0.5


def test_same_as_sql(spark, tables):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tables}/documents.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken", "first_position"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({mixing.ORACLE})").fetchall()
    assert sorted(map(tuple, mixing.op8_mixing(spark, tables).select(*names).collect())) == sorted(want)


def test_no_python_in_the_plan(spark, tables):
    plan = mixing.op8_mixing(spark, tables)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


def taken_words(mixed, ids):
    out = dict.fromkeys(ids, 0)
    for r in mixed.filter(F.col("doc_id").isin(*ids)).collect():
        out[r["doc_id"]] += len(r["text"].split())
    return out


@pytest.mark.parametrize("same_id", [True, False])
def test_repeated_rows_are_taken_as_often_as_the_mix_takes_them(spark, monkeypatch, same_id):
    """Equal rows, and rows without an id of one size: the curriculum has the words of the mix, neither more nor less."""
    monkeypatch.setattr(mixing, "CHUNK", 7)
    rows = [(1 if same_id else None, " ".join(["w"] * 5 if same_id else [f"w{i}"] * 5), "a", "x") for i in range(300)]
    rows += [(1, "w w w w w", "a", "y")] * 3 + [(10 + i, "v " * 40, "b", None) for i in range(5)] + [(None, "u", "c", "z")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_position string")
    got, want = {}, {}
    for r in mixing.mix(docs).collect():
        want[r["source"]] = want.get(r["source"], 0) + r["taken"]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    mixed = mixing.curriculum(docs)
    assert mixed.columns == ["doc_id", "text", "source", "mix_position"]
    placed = mixed.collect()
    for r in placed:
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
    assert got == want and want["a"] not in (0, 1500)
    assert [r["mix_position"] for r in placed] == sorted(r["mix_position"] for r in placed)
    assert len({(r["source"], r["mix_position"]) for r in placed}) == len(placed)  # no two copies lie on each other


def test_first_positions_of_equal_rows(spark):
    """Row by row, as SQL numbers them."""
    rows = [(i % 3, "w " * (1 + i % 4), "ab"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    want = con.sql(f"SELECT doc_id, size, taken, first_position FROM ({mixing.ORACLE})").fetchall()
    got = sorted(map(tuple, mixing.mix(docs).select("doc_id", "size", "taken", "first_position").collect()), key=str)
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want, key=str)]
    assert sorted(r[3] or -1 for r in got) == pytest.approx(sorted(r[3] or -1 for r in want))


def test_own_weights_and_schedules(spark):
    docs = make(spark)
    by = {r["source"]: r for r in mixing.mix(docs, weights=(1,), max_repeats=2, schedules={1: (1.0, 3.0)}).collect()}
    assert {r["weight"] for r in by.values()} == {1} and all(r["target"] <= 2 * r["source_size"] for r in by.values())
    assert mixing.curriculum(docs, (1,), 2, {1: (1.0, 3.0)}).agg(F.avg("mix_position")).head()[0] > 0.5


def test_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0) and {r["size"] for r in rows if r["doc_id"] in (0, 1, 2)} == {0}
    assert mixing.mix(no_docs).count() == 0
    mixed = mixing.curriculum(odd_docs)
    assert {r["doc_id"]: r["taken"] for r in rows if r["doc_id"] in (90, 91)} == taken_words(mixed, (90, 91))
    assert mixed.columns == [*odd_docs.columns, "mix_position"] and mixed.count() > 0 and mixing.curriculum(no_docs).count() == 0
    empty = odd_docs.withColumn("text", F.lit(None).cast("string"))
    assert {r["taken"] for r in mixing.mix(empty).collect()} == {0}
