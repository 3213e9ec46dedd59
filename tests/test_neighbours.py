import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldsift.operators import neighbours

SCHEMA = "fileId long, emb array<float>, part string"


def brute(rows, least=neighbours.SAME):
    usable = [(i, tuple(np.float32(v) for v in e), p) for i, e, p in rows if i is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    first = {}
    for i, e, p in sorted(usable):
        first.setdefault(e, (i, p))
    out = {(first[e][0], i, p != first[e][1]) for i, e, p in usable if first[e][0] != i}
    reps = [(i, np.array(e, float), p) for e, (i, p) in first.items()]
    for n, (i, x, p) in enumerate(reps):
        for j, y, q in reps[:n]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) > least:
                out.add((min(i, j), max(i, j), p != q))
    return out


def got(spark, rows, **more):
    found = neighbours.near_duplicates(spark.createDataFrame(rows, SCHEMA), **more).collect()
    out = {(r.a, r.b, r.crossPart) for r in found}
    assert len(out) == len(found)
    return out


def rows_of(vectors, start=0):
    return [(start + i, [float(v) for v in x], "train" if i % 3 else "test") for i, x in enumerate(vectors)]


@pytest.mark.parametrize("crowd", [neighbours.CROWD, 4])
def test_crowds_copies_and_odd_vectors(spark, crowd):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((120, 24))
    crowd_of = rng.standard_normal(24) + 0.14 * rng.standard_normal((90, 24))  # some pairs above the threshold, many below
    loose = np.repeat(base[:40], 2, axis=0) + 0.12 * rng.standard_normal((80, 24))
    rows = rows_of(base) + rows_of(crowd_of, 1000) + rows_of(loose, 2000) + rows_of(base[:15], 3000)
    rows += [(4000, None, "x"), (4001, [], "x"), (4002, [0.0] * 24, "x"), (4003, [float("nan")] + [1.0] * 23, "x"), (4004, [1.0, 2.0], None), (4005, [1.0, 2.0], "x"), (None, [1.0, 2.0], "x"), (4006, [2.0, 4.0], None)]
    want = brute(rows)
    assert len(want) > 200 and got(spark, rows, crowd=crowd) == want


def test_bands_hold_the_stated_chance():
    for bits in (8, 20, 34):
        together = (1 - np.arccos(neighbours.SAME) / np.pi) ** bits
        n = neighbours.bands_needed(bits)
        assert (1 - together) ** n <= neighbours.MISS * 1.001 < (1 - together) ** (n - 1) * 1.01


def test_none(spark):
    assert got(spark, []) == set() and got(spark, [(1, [1.0, 0.0], "a")]) == set()


def test_unlike_vectors_are_seldom_proposed(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, rng.standard_normal(64).tolist()) for i in range(1500)], "id long, emb array<double>")
    found = neighbours.candidates(rows.select("id", neighbours.unit(F.col("emb")).alias("u")))
    assert found.count() < 4 * 1500
