import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from tests.llm.conftest import SF

from fieldsift.llm import collocations as C
from fieldsift.llm import queries

SCHEMA = "doc_id long, text string, lang string, w1 string, f long, phrase string"


def brute(rows, least=10, percent=50, top=2000):
    """Counts of all phrases from the texts themselves."""
    found = {}
    for lang, text in rows:
        counts = found.setdefault(lang if lang is not None else "und", Counter())
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            counts.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in found.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rated = []
        for p, a in cands.items():
            if any(p in (q[:2], q[1:]) and 100 * b >= percent * a for q, b in cands.items() if len(q) > len(p)):
                continue
            score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rated.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def texts():
    rows = []
    for i in range(40):
        rows.append(("en", f"New York City is big, the New York City Hall; new york {i % 3}"))
        rows.append(("en", "a a a a\tA a. x\x0by\x0cz \r\n one passage that is shared by very many texts word for word" + " tail" * (i % 4)))
        rows.append((None, "Ünter Énd ünter. b c b c b c b c\n" + ("b c d" if i % 2 else "d c b")))
        rows.append(("fr", f"solo {i}"))
    rows += [("en", None), (None, None), ("en", ""), ("en", ".,;:!? \t\n"), ("und", "b c b c"), ("de", "lang " * 50_000), ("en", "\x1f \xa0 x y" * 12)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = texts()
    return spark.createDataFrame([(i % 7 if i % 5 else None, t, lang, "clash", 1, "clash") for i, (lang, t) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(("least", "percent", "top"), [(10, 50, 2000), (2, 80, 5), (1, 50, 2000)])
def test_against_counts_of_all_phrases(docs, least, percent, top):
    got = C.collocations(docs, least, percent, top).collect()
    assert sorted(map(tuple, got)) == brute(texts(), least, percent, top)


def test_paths_are_maximal_and_hold_every_edge_once(spark, docs):
    heavy = C.graph(docs, 2).filter("w3 IS NOT NULL")
    edges = {(r.lang, r.w1, r.w2, r.w3): r.f for r in heavy.collect()}
    nodes = Counter()
    for lang, text in texts():
        for piece in re.split("[.,;:!?\n-\r]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = re.findall("[^ \t]+", piece)
            nodes.update((lang if lang is not None else "und", *w[i : i + 2]) for i in range(len(w) - 1))
    seen = Counter()
    paths = C.unary_paths(C.graph(docs, 2).filter("w3 IS NOT NULL")).collect()
    for p in paths:
        w = p.words
        assert p["first"] == nodes[(p.lang, *w[:2])]
        for i in range(len(w) - 2):
            seen[(p.lang, *w[i : i + 3])] += 1
            assert edges[(p.lang, *w[i : i + 3])] == p.c
            assert i == 0 or nodes[(p.lang, *w[i : i + 2])] == p.c
    assert seen == Counter(edges.keys())
    # no two paths could be one
    starts = {(p.lang, *p.words[:2], p.c) for p in paths if p["first"] == p.c}
    assert not starts & {(p.lang, *p.words[-2:], p.c) for p in paths}
    assert max(len(p.words) for p in paths) >= 12


def blocks(batch, buckets):
    """Weights of all edges that the blocks hold, and the buckets of each node."""
    found, where = Counter(), {}
    for out in C._count(iter([batch]), buckets):
        for r in out.to_pylist():
            assert r["words"][0] == ""
            for e in zip(r["e1"], r["e2"], r["e3"], r["c"], strict=True):
                edge = (r["lang"], *[r["words"][i] for i in e[:3]])
                found[edge] += e[3]
                where.setdefault(edge[:3], set()).add(r["bucket"])
    return found, where


def test_tasks_add_up_alike_however_often_they_hand_on(monkeypatch):
    rows = texts()[:60]
    batch = pa.RecordBatch.from_pydict({"lang": [r[0] or "und" for r in rows], "text": [r[1] or "" for r in rows]})
    want, _ = blocks(batch, 1)
    for tokens in (10**6, 7):
        monkeypatch.setattr(C, "FLUSH_TOKENS", tokens)
        got, where = blocks(batch, 5)
        assert got == want and all(len(b) == 1 for b in where.values())
        assert len(set().union(*where.values())) > 1


def test_buckets_of_any_number_give_the_same_graph(docs, monkeypatch):
    want = sorted(map(tuple, C.graph(docs, 3).collect()), key=str)
    monkeypatch.setattr(C, "BUCKET_CHARACTERS", 30_000)
    assert sorted(map(tuple, C.graph(docs, 3).collect()), key=str) == want


def test_more_words_than_a_key_has_bits_for():
    import numpy as np

    rng = np.random.default_rng(1)
    three, weights = rng.integers(0, 3, (3, 200)), rng.integers(1, 9, 200)
    wide = three.copy()
    wide[:, 0] = 1 << 40
    narrow, c = C._added(three[:, 1:], weights[1:])
    found, d = C._added(wide, weights)
    assert (found[:, :-1] == narrow).all() and (d[:-1] == c).all() and d[-1] == weights[0]


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**12 - 1, 10**12, 10**12 + 7), (10**12, 10**12, 10**12), (3, 7, 11)]
    from pyspark.sql import functions as F

    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", C._score(F.col("a"), F.col("l"), F.col("r")).cast("long").alias("s")).collect()
    assert all(r.s == 10**6 * r.a * r.a // (r.l * r.r) for r in got)


def test_an_empty_table_and_no_candidates(spark, docs):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.collocations(docs, least=10**9).collect() == []


def test_query(spark):
    got = queries.QUERIES["op13_collocations"](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op13_collocations"])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
