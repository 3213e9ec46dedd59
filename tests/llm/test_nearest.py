import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import SF

from fieldsift.llm import nearest, queries
from fieldsift.llm.common import table


def plain(rows, k, is_query):
    usable = []
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        usable.append((i, [int(np.floor(1024 * float(x))) for x in v]))
    out = []
    for i, q in usable:
        if is_query(i):
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in usable if j != i and len(v) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    got = queries.QUERIES["op5_top_k"](spark, SF)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 10, lambda i: i % 100 == 0)


def test_ties_odd_rows_and_blocks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [float(np.float32(rng.gauss(c % 5, 1))) for c in range(6)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(60)]  # a group of copies, tied
    rows += [(400, None), (401, []), (402, [None] * 6), (403, [float("nan")] * 6), (404, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (405, [0.0] * 6)]
    schema = "vec_id long, embedding array<float>, rank int, score double"
    vectors = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], schema)
    want = plain(rows, 7, lambda i: i % 3 == 0)
    for block, ask in ((4096, 1024), (16, 10)):
        monkeypatch.setattr(nearest, "BLOCK", block)
        monkeypatch.setattr(nearest, "QUERY_BLOCK", ask)
        got = nearest.top_k(vectors, F.col("vec_id") % 3 == 0, k=7, pivots=9)
        assert sorted(map(tuple, got.collect())) == want


def test_few_rows_none_and_repeated_ids(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.0]), (2, [-3.0, 1.0])], schema)
    assert nearest.top_k(few, F.col("vec_id") == 0).count() == 2
    assert nearest.top_k(few, F.col("vec_id") == 9).count() == 0
    assert nearest.top_k(few.limit(0), F.lit(True)).count() == 0
    twice = few.union(few.filter("vec_id = 0"))
    rows = nearest.top_k(twice, F.col("vec_id") == 0).collect()
    assert len(rows) == 4 and all(r.vec_id != 0 for r in rows)


def test_distant_cells_are_not_sent():
    pivots = np.array([[0.0, 0.0], [100.0, 0.0]])
    import pandas as pd

    data = pd.DataFrame({"cell": [0, 1], "near": [0.0, 0.0], "far": [1.0, 1.0], "n": [20, 20]})
    close = pd.DataFrame({"cell": [0] * 3 + [1] * 3, "dist": [0.1, 0.2, 0.3] * 2})
    need = nearest.reachable(pivots, data, close, pd.DataFrame({"cell": [0], "far": [1.0], "n": [5]}), 2, 1.0)
    assert list(need.cell) == [0]


def test_rows_of_the_own_id_do_not_tighten_the_bound(spark):
    """The query's id stands on 30 rows close together; its true neighbours are far from all of them."""
    rng = random.Random(7)
    rows = [(0, [1.0, 0.0, 0.0])] * 30
    for i in range(1, 60):
        x = np.array([rng.gauss(0, 1) for _ in range(3)])
        rows.append((i, (0.99 * x / np.linalg.norm(x)).tolist()))
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.top_k(vectors, F.col("vec_id") == 0, k=5, pivots=89)
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, lambda i: i == 0)


def test_each_length_is_answered_among_its_own(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range((2, 3, 3, 5)[i % 4])]) for i in range(120)] + [(500, [1.0] * 7)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.top_k(vectors, F.col("vec_id") % 5 == 0, k=4, pivots=6)
    assert sorted(map(tuple, got.collect())) == plain(rows, 4, lambda i: i % 5 == 0)


def test_large_components_score_exactly_or_are_an_error(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [20_000.0, 0.0]), (1, [30_000.0, 0.25]), (2, [17_000.0, 3.0]), (3, [30_000.0, 1.0]), (4, [-9_999.5, 700_000.0])]
    got = nearest.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 2 == 0, k=3)
    assert sorted(map(tuple, got.collect())) == plain(rows, 3, lambda i: i % 2 == 0)
    for far in ([1e30, 0.0], [2.0e6, 2.0e6]):
        with pytest.raises(Exception, match="fit in a long"):
            nearest.top_k(spark.createDataFrame([*rows, (9, far)], schema), F.col("vec_id") == 0).collect()
