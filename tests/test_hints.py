import numpy as np

from fieldsift.operators import hints

SCHEMA = "fileId long, emb array<float>, cls string"


def brute(known, asked, top):
    ok = lambda e: e and all(v is not None and np.isfinite(v) for v in e) and any(e)
    unit = lambda e: np.array(np.float32(e), float) / np.linalg.norm(np.array(np.float32(e), float))
    have = [(i, unit(e), c) for i, e, c in known if i is not None and ok(e)]
    out = {}
    for i, e, _ in asked:
        if i is not None and ok(e):
            x = unit(e)
            near = sorted((-round(float(x @ y), 9), j, c) for j, y, c in have if j != i and len(y) == len(x))[:top]
            out |= {(i, n): (j, c) for n, (_, j, c) in enumerate(near, 1)}
    return out


def got(spark, known, asked, **more):
    rows = hints.neighbour_hints(spark.createDataFrame(known, SCHEMA), spark.createDataFrame(asked, SCHEMA), **more).collect()
    out = {(r.fileId, r.rank): (r.near, r.cls) for r in rows}
    assert len(out) == len(rows)
    return out


def rows_of(vectors, start=0):
    return [(start + n, [float(v) for v in x], f"c{n % 4}") for n, x in enumerate(vectors)]


ODD = [(4000, None, "x"), (4001, [], "x"), (4002, [0.0] * 12, "x"), (4003, [float("nan")] * 12, "x"), (4004, [None] + [1.0] * 11, "x"),
       (4005, [1.0, 2.0], "y"), (4006, [2.0, 1.0], None), (None, [1.0, 2.0], "x")]


def test_all_cells_and_small_blocks_are_exact(spark):
    rng = np.random.default_rng(5)
    known = rows_of(rng.standard_normal((150, 12))) + rows_of(np.repeat(rng.standard_normal((1, 12)), 60, axis=0), 1000) + ODD
    asked = known[::7] + ODD
    asked = list({r[0]: r for r in asked}.values())
    assert got(spark, known, asked, visits=1000, block=16) == brute(known, asked, 5)


def test_recall_of_the_default_visits(spark):
    rng = np.random.default_rng(6)
    known = rows_of(rng.standard_normal((40, 32))[rng.integers(0, 40, 3000)] + 0.7 * rng.standard_normal((3000, 32)))
    want, found = brute(known, known[::50], 5), got(spark, known, known[::50])
    right = {(k[0], v[0]) for k, v in want.items()}
    assert len({(k[0], v[0]) for k, v in found.items()} & right) >= 0.9 * len(right)


def test_none(spark):
    some = [(1, [1.0, 0.0], "a")]
    assert got(spark, [], some) == {} and got(spark, some, []) == {} and got(spark, some, some) == {}
