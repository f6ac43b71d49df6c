import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from sievelog.llm import common, langid, quality


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, sf, "labels").collect()}
    rows = quality.op4_quality(spark, sf).collect()
    assert len(rows) == common.table(spark, sf, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    told = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(told) > 50 and np.mean([a == b for a, b in told]) >= 0.97
    clean = [a for a, b in told if b == 1]
    assert np.mean(clean) >= 0.97


def test_quality_learns_from_the_right_rows_only(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    spoiled = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    renamed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")})
    one, two = ({r["doc_id"]: round(r["score"], 9) for r in quality.score(d, x).collect()} for d, x in ((docs, labels), (renamed, spoiled)))
    assert one == two


def test_statistics_do_not_depend_on_the_batch():
    texts = ["One two two.", "", "A" * 300, "é è 中", "x | y | z\n\n" * 20]

    def stats(ts):
        raw = [t.encode() for t in ts]
        return quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))

    assert np.allclose(stats(texts), np.concatenate([stats([t]) for t in texts])) and np.isfinite(stats(texts)).all()


def plain_statistics(text):
    """The twelve statistics of one text, letter by letter and word by word."""
    raw = (text or "").encode()
    words = raw.split()
    lower = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    is_in = lambda *spans: lambda c: any(a <= c <= b for a, b in spans)
    upper, letter = is_in((65, 90)), is_in((65, 90), (97, 122), (48, 57), (128, 255))
    pause = lambda c: chr(c) in ".,;:?'\"()-"
    mark = lambda c: 33 <= c <= 126 and not letter(c) and not pause(c)
    size, n = [min(len(w), 16) for w in words], len(words)
    counts = [sum(map(f, raw)) for f in (upper, pause, mark)]
    counts += [sum(a == b for a, b in zip(lower, lower[1:])), n - len(set(lower)), sum(s <= 2 for s in size), sum(s >= 14 for s in size), sum(upper(w[0]) for w in words), sum(not any(map(letter, w)) for w in words)]
    typical = [0.02, 0.02, 0.01, 0.005, 0.2, 0.2, 0.05, 0.1, 0.01]
    out = [math.log((k + 40 * t) / (of + 40)) for k, t, of in zip(counts, typical, [len(raw)] * 3 + [n] * 6)]
    mean, square = (sum(size) + 240) / (n + 40), (sum(s * s for s in size) + 40 * 46) / (n + 40)
    return [*out, math.log(mean), math.log(max(square - mean * mean, 0.1)), math.log1p(n)]


def plain_scores(texts, quality_of, shrinkage=0.25):
    """Scores of all texts by two Gaussians learnt from those that have a class."""
    x = np.array([plain_statistics(t) for t in texts])
    own = {c: x[[i for i, q in enumerate(quality_of) if q == c]] for c in (0, 1)}
    d, whole = x.shape[1], len(own[0]) + len(own[1])
    pooled = (sum(len(a) * np.cov(a.T, bias=True) for a in own.values()) + np.eye(d)) / (whole + 1)
    logs = []
    for c in (0, 1):
        n = len(own[c])
        cov = (n * np.cov(own[c].T, bias=True) + 24 * pooled) / (n + 24)
        cov = (1 - shrinkage) * cov + (shrinkage * np.trace(cov) / d + 1e-6) * np.eye(d)
        z = x - own[c].mean(0)
        logs.append(np.log(n / whole) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / 2, -500, 500)))


def test_statistics_are_those_of_each_text():
    texts = ["One two Two. TWO", "", "A" * 300, "é è 中 中", "x | y | z\n\n" * 20, None, "it's (so-called) 42%!? ## ##", "unbelievably-long-winded short a b"]
    raw = [(t or "").encode() for t in texts]
    got = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    assert np.allclose(got, [plain_statistics(t) for t in texts])


def test_quality_query_by_plain_arithmetic(spark):
    """Every score of the query, learnt and worked out text by text."""
    sf = "/root/testdata/sf0.001"
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, sf, "labels").collect()}
    docs = [(r["doc_id"], r["text"]) for r in common.table(spark, sf, "documents").orderBy("doc_id").collect()]
    known = [None if zlib.crc32(str(i).encode()) % 3 == 1 else labels.get(i) for i, _ in docs]
    want = plain_scores([t for _, t in docs], known)
    got = quality.op4_quality(spark, sf).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == [i for i, _ in docs] and np.allclose([r["score"] for r in got], want, atol=1e-6)


def test_few_labels_of_a_class_still_teach(spark):
    """One or two rows of a class, and labels that repeat."""
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    free = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for n in (1, 2):
        few = free.filter("quality = 1").union(free.filter("quality = 0").orderBy("doc_id").limit(n))
        rows = quality.score(docs, few.union(few)).collect()
        once = {r["doc_id"]: r["score"] for r in quality.score(docs, few).collect()}
        assert {r["doc_id"]: r["score"] for r in rows} == once
        told = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth]
        assert {p for p, _ in told} == {0, 1} and np.mean([p == 1 for p, t in told if t == 1]) >= 0.9


def test_labels_are_bounded_for_each_class(spark):
    labels = spark.range(20_000).select("id", F.when(F.col("id") % 100 == 0, 0).otherwise(1).alias("quality")).withColumnRenamed("id", "doc_id")
    counts = {r["quality"]: r["count"] for r in quality.marked(labels, 1000).groupBy("quality").count().collect()}
    assert 120 <= counts[0] <= 200 and 850 <= counts[1] <= 1150


def test_discriminant_is_the_textbook_one():
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = {0: rng.standard_normal((500, d)) * 2, 1: rng.standard_normal((700, d)) + 1}
    model = quality.Discriminant({c: np.concatenate([[len(a)], a.sum(0), (a.T @ a).ravel()]) for c, a in x.items()})
    pooled = (sum(len(a) * np.cov(a.T, bias=True) for a in x.values()) + np.eye(d)) / 1201
    logs = []
    for c in (0, 1):
        n = len(x[c])
        cov = (n * np.cov(x[c].T, bias=True) + quality.POOLED * pooled) / (n + quality.POOLED)
        cov = (1 - quality.SHRINKAGE) * cov + (quality.SHRINKAGE * np.trace(cov) / d + 1e-6) * np.eye(d)
        z = x[1] - x[c].mean(0)
        logs.append(np.log(n / 1200) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    want = 1 / (1 + np.exp(-(logs[1] - logs[0]) / quality.TEMPERATURE))
    assert np.allclose(model.scores(x[1]), want)


def test_quality_of_odd_rows(spark, odd_docs, no_docs, no_labels, tables):
    labels = common.table(spark, tables, "labels").unionByName(spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    train = common.table(spark, tables, "documents").withColumn("doc_id", F.col("doc_id") + 1000)
    labels = labels.withColumn("doc_id", F.col("doc_id") + 1000)
    both = train.unionByName(odd_docs, allowMissingColumns=True)
    rows = quality.score(both, labels).filter("doc_id < 1000 or doc_id is null").collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.score(odd_docs, no_labels).collect()} == {0.5}
    assert quality.score(no_docs, labels).count() == 0
    kept = quality.keep_good(both, labels)
    assert kept.columns == both.columns and 0 < kept.count() < both.count()


def test_codewords():
    for n in (1, 2, 3, 4, 6, 9, 40):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n
        if n > 6:
            assert (code[:, None, :] != code[None, :, :]).sum(axis=2)[~np.eye(n, dtype=bool)].min() >= 5


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in common.table(spark, sf, "documents").collect()}
    rows = langid.op6_langid(spark, sf).collect()
    assert len(rows) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]) >= 0.98


def test_decoding_is_the_textbook_one():
    """Every bit's log-odds, the loss of each codeword, weights and the mark of the ambiguous, one number at a time."""
    rng = np.random.default_rng(3)
    known = {f"l{k}": rng.poisson(np.exp(rng.standard_normal(langid.DIMENSIONS)) * 3).astype(float) for k in range(4)}
    model = langid.Codes(known)
    names, code, size = sorted(known), langid.codewords(4), langid.DIMENSIONS
    share = {x: [(c + 0.5) / (known[x].sum() + 0.5 * size) for c in known[x]] for x in names}
    weight, centre, apart = [], [], []
    for bit in range(code.shape[1]):
        one, zero = [[share[x] for x, c in zip(names, code[:, bit]) if c == side] for side in (1, -1)]
        w = [math.log(sum(o) / len(o)) - math.log(sum(z) / len(z)) for o, z in zip(zip(*one), zip(*zero))]
        margin = [sum(a * b for a, b in zip(share[x], w)) for x in names]
        low, high = min(m for m, c in zip(margin, code[:, bit]) if c > 0), max(m for m, c in zip(margin, code[:, bit]) if c < 0)
        weight.append(w)
        centre.append((low + high) / 2)
        apart.append(low - high)
    bit_weight = [max(a, 1e-3) / sum(max(x, 1e-3) for x in apart) for a in apart]
    mixed = [known["l1"], known["l2"], (known["l0"] + known["l3"]) / 2, 0.55 * known["l0"] + 0.45 * known["l2"], np.zeros(size), np.eye(1, size, 7)[0]]
    best, score, unsure = model.decode(np.array(mixed))
    marks = []
    for counts, b, s, u in zip(mixed, best, score, unsure):
        total = max(sum(counts), 1)
        loss = []
        for word in code:
            margins = [(sum(c * w for c, w in zip(counts, weight[k]) if c) / total - centre[k]) * 8 / max(abs(apart[k]), 1e-3) for k in range(len(apart))]
            loss.append(sum(w * math.log1p(math.exp(-m * c)) for w, m, c in zip(bit_weight, margins, word)))
        odds = [math.exp((min(loss) - x) * len(apart) / 2) for x in loss]
        odds = [o / sum(odds) for o in odds]
        order = sorted(range(4), key=lambda i: -odds[i])
        marks.append(odds[order[0]] - odds[order[1]] < langid.AMBIGUOUS)
        assert (order[0] == b or abs(odds[order[0]] - odds[b]) < 1e-9) and abs(odds[b] - s) < 1e-9 and marks[-1] == u
    assert list(best[:2]) == [1, 2] and True in marks and False in marks


def test_every_language_is_learnt(spark, monkeypatch):
    """Rows without ids, ids that repeat, and languages of few rows among many of another."""
    rng = np.random.default_rng(2)
    words = {f"l{k}": ["".join(rng.choice(list("abcdefghijklmnop")[k : k + 8], 6)) for _ in range(50)] for k in range(5)}
    rows = [(None if i % 2 else 1, " ".join(rng.choice(words["l0"], 12)), "l0") for i in range(6000)]
    rows += [(None, " ".join(rng.choice(words[x], 30)), x) for x in ("l1", "l2", "l3") for _ in range(6)] + [(1, "zz yy " * 9, "l4")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = docs.withColumn("held_out", F.lit(False))
    counts = {r["lang"]: r["count"] for r in langid.sample(known, 500).groupBy("lang").count().collect()}
    assert {x: counts[x] for x in ("l1", "l2", "l3", "l4")} == {"l1": 6, "l2": 6, "l3": 6, "l4": 1} and 400 <= counts["l0"] <= 600
    got = langid.predict(docs, per_language=500).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"] for r in got} == set(words)
    assert sum(r["count"] for r in got if r["lang_pred"] == "l0") >= 5900


def test_many_languages(spark):
    """More than six: random codewords."""
    rng = np.random.default_rng(1)
    words = {f"l{k}": ["".join(rng.choice(list("abcdefghijklmnop")[k : k + 7], 5)) for _ in range(60)] for k in range(9)}
    rows = [(i, " ".join(rng.choice(words[lang], 40)), lang) for i, lang in enumerate(sorted(words) * 40)]
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("held_out").collect()
    langs = {i: lang for i, _, lang in rows}
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in got]) >= 0.95


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    rows = langid.predict(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r["doc_id"] in (0, 1, 2, 4):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] in (3, 6, 90):
            assert r["lang_pred"] in ("en", "de") and r["score"] > 0
    assert {r["lang_pred"] for r in langid.predict(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.predict(no_docs).count() == 0


def test_letters_of_any_script():
    import pyarrow as pa

    texts = pa.array(["12 .", "é", "中", "", None, "…", "a", "２"])
    assert langid.has_letter(*common.utf8(texts), texts).tolist() == [False, True, True, False, False, False, True, False]
