"""Findings of the third round: odd rows and larger tables."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldsift.functions import boxes
from fieldsift.operators import agreement, merge, splitting
from fieldsift.plans import catalogue, ingest, more, norms, review, streams  # noqa: F401  registers itself
from fieldsift.sources import sectioned


@pytest.fixture
def against_sql(spark, tmp_path):
    """A query and its SQL over small tables of the test's own."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, df in tables.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got, want = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(catalogue.ORACLE_SQL[name]).df()
        plain = lambda f: sorted((tuple(None if x != x else x for x in r) for r in f[sorted(f.columns)].itertuples(index=False, name=None)), key=repr)
        return plain(got), plain(want)

    return run


def test_human_references_of_odd_first_lines(spark, against_sql):
    lines = [None, "", "one |the| two", "a|b|c|d|", "short\t\r", "\tnew roof \x85", "ends in Der \r", "The roof | of it", "|||||||||", "Le chat ", "　wide space　"]
    rows = [(i - 5, t, "en", "src1", len(t or "")) for i, t in enumerate(lines)]
    got, want = against_sql("human_references", documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert got == want


def _drawn(spark, boxes):
    """Defects of (photo, source, type, box) in that order."""
    rows = [(f, s, t, f"[[{x}, {y}, {x + w}, {y + w}]]", n) for n, (f, s, t, (x, y, w)) in enumerate(boxes)]
    return spark.createDataFrame(rows, "fileId string, source string, defectType string, box string, seq long")


def test_photos_of_few_boxes_need_no_grid(spark, monkeypatch):
    def grid(*_):
        raise AssertionError("81 rows for every box")

    monkeypatch.setattr(agreement, "_zones", grid)
    df = _drawn(spark, [("p", "a", "t", (0, 0, 100)), ("p", "a", "u", (4, 0, 100)), ("p", "b", "t", (5, 0, 100)), ("q", "b", "t", (5, 0, 100)), (None, "a", "t", (0, 0, 9)), (None, "b", "t", (0, 0, 9))])
    a, b = agreement.numbered_boxes(df, "a"), agreement.numbered_boxes(df, "b")
    assert sorted(r.i["__o"] for r in agreement.close_pairs(a, b).collect()) == [0, 1]
    got = sorted((r.fileId or "", r.kind, r.a, r.b) for r in agreement.box_pairs(df, "a", "b").collect())
    assert got == [("", "only first", "t", ""), ("", "only second", "", "t"), ("p", "agree", "t", "t"), ("p", "only first", "u", ""), ("q", "only second", "", "t")]


def test_full_and_other_photos_are_settled_alike(spark, monkeypatch):
    few = [(f"p{i % 5}", "ab"[i % 2], "tu"[i % 3 % 2], (i * 37 % 50, i * 11 % 40, 90 + i % 30)) for i in range(60)]
    df = _drawn(spark, few)
    run = lambda: sorted(map(tuple, agreement.box_pairs(df, "a", "b").collect()))
    alone = run()
    monkeypatch.setattr(agreement, "FEW", 2)
    assert run() == alone and len({r[1] for r in alone}) > 2


def test_plain_boxes_are_read_as_the_parser_reads_them(spark, monkeypatch):
    texts = ['[[1, 2, 3, 4], [5,6,7]]', '[[-1, "2", 3, 4],[9, 8, 7, 6]]', '[[1,2,3,4], "x"]', '[ [1, 2, 3, 4] ]', '[[01, 2, 3, 4]]', '[[1, 2, 3, "4]]', '[[1, 2', '[]', '', '[[1.5, 2, 3, 4]]', '[[1, 2, 3, 999999999]]', None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    read = lambda: [r[0] for r in df.select(boxes.box_list(df["t"])).collect()]
    quick = read()
    monkeypatch.setattr(boxes, "PLAIN", "^never$")
    assert read() == quick and quick[:2] == [[[1, 2, 3, 4]], [[-1, 2, 3, 4], [9, 8, 7, 6]]]


def test_headers_carry_over_many_files_without_one_task(spark):
    rows = [(f"f{i:03}", b, 0, f"#DOC\td{i}\tx\tn" if i % 7 == 3 and not b else "1\tR\ta") for i in range(60) for b in (0, 64)]
    lines = spark.createDataFrame(rows, "file string, block long, pos long, text string")
    parsed = sectioned.parse_standards(lines)
    plan = parsed.rows._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.file, r.block): r.docNo for r in parsed.rows.collect()}
    last, want = None, {}
    for f, b, _, t in rows:
        if t.startswith("#DOC"):
            last = t.split("\t")[1]
        elif last:
            want[f, b] = last
    assert got == want and parsed.problems.count() == 6
    assert not re.search(r"windowspecdefinition\(file#\d+ ASC", plan)


def test_rare_floor_pages_are_few_and_give_the_greedy_choice(spark, monkeypatch):
    days = [(f"s{i % 40}", f"2024-{i // 40 + 1:02}-01") for i in range(400)]
    rows = [(f"f{i}-{j}", *day, "common" if j else f"rare{i % 3}") for i, day in enumerate(days) for j in range(1 + i % 2)]
    df = spark.createDataFrame(rows, "fileId string, constrId string, reportDate string, cls string")
    fetched = []
    fetch = splitting._Candidates._fetch
    monkeypatch.setattr(splitting._Candidates, "_fetch", lambda self, *a: (fetched.append(a), fetch(self, *a)))
    moved = splitting.rare_class_floor(df, spark.createDataFrame(days, "constrId string, reportDate string"), floor=60, max_shrink=0.9, page=1)[1].collect()
    got = {c: 0 for c in ("rare0", "rare1", "rare2")}
    for i, day in enumerate(days):
        if day in {(r.constrId, r.reportDate) for r in moved}:
            got[f"rare{i % 3}"] += 1
    assert len({(r.constrId, r.reportDate) for r in moved}) == len(moved) and min(got.values()) >= 60, got
    assert len(fetched) <= 40


def test_rows_of_one_label_meet_the_catalogue_in_shares(spark, against_sql):
    orders = spark.range(600).selectExpr("id AS o_orderkey", "'1-URGENT' AS o_orderpriority")
    got, want = against_sql("response_problems", orders=orders)
    assert got == want
    c = spark.createDataFrame([("a-b",), ("",)], "label string")
    one = "fileId string, imageHash string, contextHash string"
    held = spark.createDataFrame([("f", "h", "c")], one)
    results = spark.createDataFrame([("f", "h", "existing", "", "d", "seen", "why", [""], None, None, "v1", "m")], "fileId string, imageHash string, decision string, label string, candidateDefinition string, visualEvidence string, reason string, alternatives array<string>, titleEvidence string, titleRelation string, catalogVersion string, model string")
    faults = merge.response_problems(results, held, held, c, "v1")
    assert [r.problem for r in faults.collect()] == ["unknown class"]
    joins = re.findall(r"Join Left\w+, [^\n]*label[^\n]*", faults._jdf.queryExecution().optimizedPlan().toString())
    assert len(joins) == 2 and all("__s" in j for j in joins)
