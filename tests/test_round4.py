"""Findings of the fourth round."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fieldsift.functions.boxes import iou
from fieldsift.operators import agreement
from fieldsift.plans import more

DEFECTS = "fileId string, source string, defectType string, box string, seq long"
#: Beyond so many bytes the JVM interprets a method for good.
COMPILED = 8000


@pytest.fixture
def drawn(spark):
    """Defects of a few photos, one of them with many boxes, with odd lists among them."""
    rng = random.Random(4)
    some = lambda: [x := rng.randrange(400), y := rng.randrange(400), x + 200 + rng.randrange(99), y + 200 + rng.randrange(99)]
    rows = [(f, s, "t", json.dumps([some() for _ in range(rng.randrange(4))]), n) for f, many in (("p", 4), ("q", 9), ("full", 90), (None, 3)) for s in "abc" for n in range(many)]
    lists = ["[\"[1, 2, 300, 400]\", [1, 2, 300, 400]]", "[\"\\u005b1, 2, 300, 400]\", \"x\"]", "[[null, 2, 3, 4]]", "[", "", None, "[]"]
    return spark.createDataFrame(rows + [("odd", s, "t", box, n) for s in "ab" for n, box in enumerate(lists)], DEFECTS)


def test_boxes_are_compared_in_code_that_the_jvm_compiles(spark, drawn):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        a, b = (agreement.numbered_boxes(drawn.filter("fileId <> 'full'"), s) for s in "ab")
        stages = agreement.close_pairs(a, b)._jdf.queryExecution().debug().codegenToSeq()
        assert stages.size() and max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < COMPILED
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_crowded_photos_spare_the_count_and_change_no_pair(drawn):
    a, b = (agreement.numbered_boxes(drawn, s) for s in "ab")
    crowded = agreement.crowded_photos(drawn, "a", "b")
    assert [r.fileId for r in crowded.collect()] == ["full"]
    other = b.select("fileId", F.col("i").alias("j"), F.col("box").alias("other"))
    plain = a.join(other, "fileId").withColumn("iou", iou(F.col("box"), F.col("other"))).filter("iou >= 0.5").select("fileId", "i", "j", "iou")
    want = sorted(map(tuple, plain.collect()))
    assert {r[0] for r in want} == {"p", "q", "full", "odd"}
    assert sorted(map(tuple, agreement.close_pairs(a, b, crowded=crowded).collect())) == want == sorted(map(tuple, agreement.close_pairs(a, b).collect()))


@pytest.mark.parametrize("lists", [["[[1, 2, 3, 4]]"] * 65, [json.dumps([[1, 2, 3, 4]] * 65)], ["[" + ", ".join(['"\\u005b1, 2, 3, 4]"'] * 65) + "]"]])
def test_no_photo_of_many_boxes_is_taken_for_one_of_few(spark, lists):
    rows = spark.createDataFrame([("p", "a", "t", box, n) for n, box in enumerate(lists)], DEFECTS)
    assert agreement.numbered_boxes(rows, "a").count() == 65
    assert agreement.crowded_photos(rows, "a", "b").count() == 1 and agreement.crowded_photos(rows, "b").count() == 0


def test_texts_of_boxes_are_as_format_string_writes_them(spark, tmp_path):
    lines = [(1, 2, 3, 7.0, 0.05, 0.02), (1, 2, 4, None, None, 0.02), (None, None, None, -3.5, 0.1, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.fileId, r.source, r.seq, r.box) for r in more._boxes(spark, str(tmp_path)).collect()}
    text = lambda x: "[[null, null, null, null]]" if x is None else f"[[{x}, {x}, {x + 300}, {x + 300}]]"
    keys = ("1", 30_000_002), ("1", 40_000_002), (None, None)
    assert got == {(f, s, q, text(x)) for (f, q), both in zip(keys, ((35, 70), (None, None), (-15, None)), strict=True) for s, x in zip("ab", both, strict=True)}
