"""Small literal cases for rules that the big tables cannot show."""

import warnings

import pytest
from pyspark.sql import functions as F

from fieldsift import scale
from fieldsift.functions.boxes import box_list
from fieldsift.functions.text import grams
from fieldsift.operators import agreement, deident, evaluation, mining, replay, sampling, splitting
from fieldsift.sources import tabular


def test_running_totals_and_ranks_with_null_and_nan(spark):
    rows = [(None, 1), (float("nan"), 2), (3.0, 4), (1.0, 8), (2.0, 16)]
    df = spark.createDataFrame(rows, "v double, n long")
    for ranges in (1, 2, 40):
        got = scale.running_totals(df, "v", {"n": "t"}, descending=False, ranges=ranges).collect()
        assert sorted(r.t for r in got) == [1, 9, 25, 29, 31]
    names = spark.createDataFrame([(f"n{i:03}",) for i in range(300)], "name string")
    for ranges in (1, 7):
        assert all(int(r.name[1:]) + 1 == r["rank"] for r in scale.ordered_rank(names, "name", ranges=ranges).collect())


def test_hash_order_keeps_null_keys(spark):
    df = spark.createDataFrame([("a", "x"), (None, "x"), ("b", None), (None, None)], "id string, cls string")
    assert scale.hash_rank(df, ["cls"], "id").count() == 4
    quotas = spark.createDataFrame([("x", 5), (None, 5)], "cls string, quota long")
    assert scale.take_by_hash(df, ["cls"], "id", quotas).count() == 4
    groups = spark.createDataFrame([(None,), ("g",), ("h",)], "g string")
    assert splitting.group_folds(groups, "g").count() == 3


@pytest.mark.parametrize(("n", "want"), [(20, [5, 5, 10]), (40, [5, 5, 30]), (50, [5, 5, 40]), (13, [4, 4, 5])])
def test_floor_sample(spark, n, want):
    sizes = {"a": 5, "b": 5, "c": 40}
    df = spark.createDataFrame([(f"{c}{i}", c) for c, k in sizes.items() for i in range(k)], "fileId string, cls string")
    counts = df.groupBy("cls").agg(F.count("*").alias("size"))
    quotas = {r.cls: r.quota for r in sampling.floor_quotas(counts, n, 4).collect()}
    assert [quotas[c] for c in "abc"] == want
    assert sampling.stratified_floor(df, n, 4).count() == n
    with pytest.raises(ValueError):
        sampling.stratified_floor(df, 10, 4)
    with warnings.catch_warnings(record=True):
        assert sampling.stratified_floor(df, 90, 4).count() == 50


def test_terms_of_a_script_without_spaces(spark):
    got = spark.createDataFrame([("抿石子ab施作",)], "t string").select(grams(F.col("t")).alias("g")).first().g
    assert sorted(got) == sorted(["抿石", "石子", "抿石子", "施作"])
    unclaimed = spark.createDataFrame([("抿石子施作", 20), ("外牆抿石子", 15)], "title string, photos long")
    claimed = spark.createDataFrame([("外牆防水施作", 50)], "title string, photos long")
    picked = mining.cover_titles(unclaimed, claimed, min_photos=10).collect()
    assert [r.term for r in picked] == ["抿石子"] and picked[0].photos == 35
    assert mining.cover_titles(unclaimed, claimed, min_photos=100).count() == 0


def test_boxes_in_mixed_lists(spark):
    texts = ['[[1,2,3,4],"x"]', '[["1","2","3","4"]]', "[[1,2,3]]", "{", "[]", "[[1.9, 2, 3, 4], [5, 6, 7, 8]]"]
    df = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "fileId string, seq int, box string")
    got = {r.fileId: r.boxes for r in replay.last_boxes(df).collect()}
    assert got == {"0": [[1, 2, 3, 4]], "1": [[1, 2, 3, 4]], "5": [[1, 2, 3, 4], [5, 6, 7, 8]]}
    assert df.select(box_list(F.col("box")).alias("b")).first().b == [[1, 2, 3, 4]]
    log = spark.createDataFrame([("a", 1, "[[1,2,3,4]]"), ("a", 2, " "), ("b", 1, ""), ("b", 2, "[[1,2,3,4]]"), ("b", 3, "{")], df.schema)
    assert {r.fileId for r in replay.last_boxes(log).collect()} == {"b"}


def test_box_cells_must_be_whole_numbers(spark):
    cells = {"[1, 2, 3, 1000]": True, '["1","2","3","4"]': False, "[1,2,3,1001]": False, "[1,2,3]": False, "[01,2,3,4]": False}
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = {r.c: r.ok for r in df.select("c", deident.valid_cell(F.col("c"), "box1000", {}).alias("ok")).collect()}
    assert got == cells


def test_rare_floor_counts_own_rows_only(spark):
    rows = [(f"s{i}", "a", f"2024-01-{i + 1:02}", "common", "pms") for i in range(20)]
    rows += [(f"f{i}", "x", "2023-01-01", "rare", "foreign") for i in range(20)]
    rows += [(f"r{i}", "a", f"2024-01-{d:02}", "rare", "pms") for i, d in enumerate((18, 19, 20))]
    df = spark.createDataFrame(rows, "fileId string, constrId string, reportDate string, cls string, dataset string")
    days = spark.createDataFrame([("a", f"2024-01-{d:02}") for d in (18, 19, 20)], "constrId string, reportDate string")
    left, moved = splitting.rare_class_floor(df, days, floor=1, max_shrink=0.5)
    assert moved.count() == 1 and moved.first()["for"] == "rare" and left.count() == 2


def test_verdict_gives_every_reason(spark):
    rows = [("a", "a" if i % 2 else "b", "a") for i in range(60)] + [("b", "b", "b")] * 60
    row = evaluation.verdict(spark.createDataFrame(rows, "true string, candidate string, baseline string")).first()
    assert not row.promote
    assert any(r.startswith("top1 0.750 < 現行 1.000") for r in row.reasons)
    assert "a 召回 1.00 → 0.50（掉 50%）" in row.reasons
    assert evaluation.verdict(spark.createDataFrame(rows[:9], "true string, candidate string, baseline string")).first().reasons[0].startswith("考卷只有 9 張")


def test_overlapping_boxes_meet_once(spark):
    schema = "fileId string, source string, defectType string, box string, seq int"
    rows = [("p", "a", "t", "[[0,0,100,100]]", 1), ("p", "a", "t", "[[500,500,900,900]]", 2), ("p", "b", "t", "[[5,5,100,100]]", 3), ("p", "b", "t", "[[0,0,20,20]]", 4)]
    df = spark.createDataFrame(rows, schema)
    a, b = agreement.numbered_boxes(df, "a"), agreement.numbered_boxes(df, "b")
    (pair,) = agreement.close_pairs(a, b).collect()
    assert round(pair.iou, 4) == round(95 * 95 / 10_000, 4)


def test_csv_columns_go_by_the_header_of_their_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("fileId,cls\nf1,A\n")
    (tmp_path / "b.csv").write_text("cls,fileId,more\nB,f2,x\n\"C, c\",f3,\n")
    got = tabular.read_strings(spark, str(tmp_path), ["fileId", "cls", "note"]).collect()
    assert sorted(map(tuple, got)) == [("f1", "A", ""), ("f2", "B", ""), ("f3", "C, c", "")]
    assert tabular.read_strings(spark, str(tmp_path / "none"), ["fileId"]).count() == 0
