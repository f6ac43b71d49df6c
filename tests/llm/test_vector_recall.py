import numpy as np
import pyarrow as pa
import pytest

from sievelog.llm import common, vector_dedup as vd


def planted(rng, n, hot, cosine, pairs):
    """n vectors of 64 dimensions, `hot` of them in one cone of pairwise cosine 0.7, and pairs of this cosine among the last of them."""
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)

    def cone(z):
        z = z - (z @ centre)[:, None] * centre
        return np.sqrt(0.7) * centre + np.sqrt(0.3) * z / np.linalg.norm(z, axis=1)[:, None]

    if hot:
        x[:hot] = cone(x[:hot])
        at = np.arange(2 * pairs)
    else:
        at = np.arange(n - 2 * pairs, n)
    a, z = x[at[:pairs]], rng.standard_normal((pairs, 64))
    if hot:  # both ends in the cone: partners share all but a part of what leads away from its axis
        away = (a - np.sqrt(0.7) * centre) / np.sqrt(0.3)
        z -= (z @ centre)[:, None] * centre
        z -= (z * away).sum(axis=1)[:, None] * away
        z /= np.linalg.norm(z, axis=1)[:, None]
        part = (cosine - 0.7) / 0.3
        x[at[pairs:]] = np.sqrt(0.7) * centre + np.sqrt(0.3) * (part * away + np.sqrt(1 - part**2) * z)
    else:
        z -= (z * a).sum(axis=1)[:, None] * a
        z /= np.linalg.norm(z, axis=1)[:, None]
        x[at[pairs:]] = cosine * a + np.sqrt(1 - cosine**2) * z
    return x, at[:pairs], at[pairs:]


def met(x, a, b, passes):
    """Share of the pairs that some pass puts into one block or the next, with all passes in one order as the operator has them."""
    made, n, found = vd.directions(64, passes, vd.BITS), len(x), np.zeros(len(a), bool)
    for p in range(passes):
        keys = (x @ made[:, p * vd.BITS : (p + 1) * vd.BITS] > 0).astype(np.int64) @ (np.int64(1) << np.arange(vd.BITS - 1, -1, -1, dtype=np.int64))
        place = np.empty(n, np.int64)
        place[np.argsort(keys, kind="stable")] = np.arange(p * n, (p + 1) * n)
        found |= np.abs(place[a] // vd.WINDOW - place[b] // vd.WINDOW) <= 1
    return found.mean()


@pytest.mark.parametrize("n,hot,cosine", [(20_000, 0, 0.901), (200_000, 0, 0.901), (150_000, 50_000, 0.91)])
def test_recall_at_the_threshold_at_every_size(spark, n, hot, cosine):
    x, a, b = planted(np.random.default_rng(3), n, hot, cosine, 1000)
    common.ship(spark)
    flat = pa.array(x.ravel())
    table = pa.table({"id": pa.array(np.arange(n)), "v": pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * n + 1, 64, dtype=np.int32)), flat)})
    passes = vd.passes_needed(spark.createDataFrame(table))
    found, fixed = met(x, a, b, passes), met(x, a, b, vd.PASSES)
    print("recall", n, hot, cosine, passes, found, fixed)
    assert found >= 0.98 and (n < 100_000 or fixed < 0.98)
