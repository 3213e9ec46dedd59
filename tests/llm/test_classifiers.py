import zlib

import numpy as np
import pytest
from tests.llm.conftest import SF, SF_LARGER

from fieldsift.llm import quality_classifier, queries, toxicity
from fieldsift.llm.common import labelled_ids, remainder, table


def auc(score, label):
    score, label = np.asarray(score, float), np.asarray(label)
    good, bad = score[label == 1], score[label == 0]
    return np.mean((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :]))


@pytest.mark.parametrize(
    ("name", "column", "modulus", "out", "least", "limit"),
    [("op8_quality_classifier", "quality", 4, 2, 0.93, 0.7), ("op10_toxicity", "toxic", 5, 0, 0.85, 0.5)],
)
def test_query_held_out(spark, name, column, modulus, out, least, limit):
    rows = queries.QUERIES[name](spark, SF_LARGER)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in rows.collect()}
    assert len(rows) == table(spark, SF_LARGER, "documents").count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == out)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)
    labels = [x for x in table(spark, SF_LARGER, "labels").collect() if rows[x.doc_id].held_out]
    assert auc([rows[x.doc_id].score for x in labels], [x[column] for x in labels]) > least


def test_odd_rows(spark, odd, empty):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    for given in (labels, labels.limit(0)):
        model = toxicity.fit(docs, given)
        rows = toxicity.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert {r.held_out for r in rows if r.doc_id is None} == {None}
        by = [r.score for r in rows if r.doc_id in (0, 1)]
        assert by[0] == by[1] == pytest.approx(1 / (1 + np.exp(-model.bias)))
        assert len({r.score for r in rows if r.doc_id == 2}) == 1
        assert toxicity.score(empty, model).count() == 0
    vectors = quality_classifier.word_vectors(docs)
    net = quality_classifier.fit(docs, labels, vectors)
    rows = quality_classifier.score(odd, vectors, net).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    none = quality_classifier.word_vectors(empty)
    prior = quality_classifier.fit(empty, labels, none)
    assert {round(r.score, 9) for r in quality_classifier.score(odd, none, prior).collect()} == {0.5}
    assert quality_classifier.score(empty, vectors, net).count() == 0


def test_labelled_sample_is_bounded_and_settles_conflicts(spark):
    rows = [(i, i % 2) for i in range(50)] + [(1, 0), (2, 1), (None, 1), (60, None), (61, 7)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    got = {r.doc_id: r.label for r in labelled_ids(labels, "quality").collect()}
    assert got == {i: int(i % 2 or i == 2) for i in range(50)}
    assert labelled_ids(labels, "quality", rows=7).count() == 7
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in labelled_ids(labels, "quality", remainder(4) != 2).collect())


def test_context_sums_equal_counting_over_cuts(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{'abcdefghij'[c % 10]}{'klmno'[c // 10]}" for c in rng.integers(0, 50, n)) for n in (700, 7, 1, 3)]
    batches = [pa.RecordBatch.from_pydict({"text": texts})]
    index, want = quality_classifier.index_vectors().astype(int), {}
    for text in texts:
        ids = quality_classifier.Tokens().of(text)
        for k, i in enumerate(ids):
            near = [ids[j] for j in (k - 2, k - 1, k + 1, k + 2) if 0 <= j < len(ids)]
            n, v = want.get(i, (0, 0))
            want[i] = (n + 1, v + index[near].sum(axis=0))
    for step in (10**6, 50, 3):
        monkeypatch.setattr(quality_classifier, "_STEP", step)
        (got,) = quality_classifier._context_sums(batches)
        got = got.to_pandas().set_index("bucket")
        assert len(got) == len(want)
        for i, (n, v) in want.items():
            assert got.loc[i, "n"] == n and (got.loc[i].to_numpy()[1:] == v).all()


def test_grams_stay_inside_words():
    assert toxicity.grams("").size == 0 and toxicity.grams("1 2 -").size == 0
    one, two = toxicity.grams("idiot"), toxicity.grams("--IDIOT, idiot!")
    assert set(one) == set(two) and len(two) == 2 * len(one)
