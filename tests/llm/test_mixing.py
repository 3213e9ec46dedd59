import math

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import SCHEMA, SF

from fieldsift.llm import mixing, queries
from fieldsift.llm.common import table


def made(spark, sizes, words=20):
    rows, i = [], 0
    for source, n in sizes.items():
        for k in range(n):
            rows.append((i, " ".join(["w"] * (words + k % 3)), "en", source, 1, 0.5, 1))
            i += 1
    return spark.createDataFrame(rows, SCHEMA)


def plain_exponent(tokens, entropy, repeats):
    total, greatest = sum(tokens), math.log(len(tokens))

    def share(a):
        w = [(t / total) ** a for t in tokens]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w) / greatest

    low, high = 0.0, 1.0
    if share(1.0) >= entropy:
        low = 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if share(mid) >= entropy else (low, mid)
    limit = 1 - math.log(repeats) / math.log(max(tokens) / min(tokens))
    return max(low, limit, 0.0)


def test_every_document_once_and_repeats_as_decided(spark):
    sizes = {"big": 3000, "mid": 700, "small": 150, None: 90}
    docs = made(spark, sizes)
    counted = {r.key: r.tokens for r in mixing.counted(docs).groupBy("key").agg(F.sum("tokens").alias("tokens")).collect()}
    for entropy, repeats in ((0.95, 4.0), (0.9, 50.0), (0.2, 4.0), (1.0, 1.0)):
        want = plain_exponent(list(counted.values()), entropy, repeats)
        heat = mixing.temperature(spark.createDataFrame(list(counted.items()), "key string, tokens long"), entropy, repeats)
        assert heat.exponent == pytest.approx(min(1.0, want), abs=1e-6)
        rows = mixing.mixed(docs, entropy, repeats)
        assert rows.columns == ["doc_id", "source", "pass", "order_key"]
        per = rows.groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.max("pass").alias("last"))
        per = per.join(mixing.counted(docs).select("doc_id", "tokens"), "doc_id").collect()
        assert len(per) == sum(sizes.values()) and all(r.n == r.last for r in per)
        most = max(counted.values())
        for source in sizes:
            own = [r for r in per if r.source == source]
            tokens = sum(r.tokens for r in own)
            epochs = (most / tokens) ** (1 - heat.exponent)
            assert {r.n for r in own} <= {math.floor(epochs + 1e-9), math.floor(epochs + 1e-9) + 1}
            assert abs(sum(r.n * r.tokens for r in own) - epochs * tokens) <= 25  # within one document


def test_query_covers_all_documents(spark):
    docs = table(spark, SF, "documents")
    rows = queries.QUERIES["op3_mixing"](spark, SF)
    assert rows.select("doc_id").distinct().count() == docs.count()
    assert rows.groupBy("doc_id", "pass").count().filter("count > 1").count() == 0


def test_odd_rows(spark, odd, empty):
    rows = mixing.mixed_rows(odd)
    assert rows.columns == odd.columns
    want, got = map(lambda d: {repr(r) for r in d.collect()}, (odd, rows))
    assert want == got and rows.count() >= odd.count()
    assert mixing.mixed_rows(empty).count() == 0 and mixing.mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, "a", None, None, None), (2, "", None, None, None, None, None)], SCHEMA)
    assert mixing.mixed_rows(blank).count() == 2


def test_words_are_those_between_ascii_white_space(odd):
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode().split())) for r in odd.collect())
    got = sorted((r.doc_id is None, r.doc_id or 0, r.tokens) for r in mixing.counted(odd).collect())
    assert got == want
