import pytest

from fieldsift.operators import checks, standards

DOCS, ITEMS = [("QS01", "id1", "wall"), ("QS02", "id2", "floor")], [("QS01", "1", "O", "a"), ("QS01", "1.1", "R", "b"), ("QS02", "1", "R", "c")]
LISTED = [("QS01", "id1", "wall"), ("QS02", "id2", "floor")]
EXPECTED = [("QS01", 1, 1, "A", "wal"), ("QS02", 1, None, "C", None)]


def standing(spark, docs=DOCS, items=ITEMS, listed=LISTED, expected=EXPECTED):
    frame = spark.createDataFrame
    found = checks.check_standards(
        frame(docs, "docNo string, isoInfoId string, name string"), standards.describe_items(frame(items, "docNo string, itemNo string, status string, name string")),
        frame(listed, "docNo string, id string, name string"), frame(expected, "docNo string, required long, stages long, shape string, word string"),
        docs_least=2, depth_least=2, billing_least=0, penalty_least=0,
    )
    return {r.check for r in found.collect() if r.status != "pass"}


def test_standards_pass(spark):
    assert standing(spark) == set()


@pytest.mark.parametrize("instead, broken", [
    ({"docs": DOCS[:1]}, {"enough documents", "nothing is only listed", "fixed documents are as expected"}),
    ({"docs": [*DOCS, ("QS03", "id3", "x")]}, {"nothing is only parsed", "every document has items"}),
    ({"listed": [*LISTED, LISTED[0]]}, {"catalogue numbers are unique"}),
    ({"listed": [LISTED[0], ("QS02", "other", "floor")]}, {"document ids agree"}),
    ({"items": [*ITEMS, ("QS02", "x", "R", "d")]}, {"item keys are well formed", "fixed documents are as expected"}),
    ({"items": [*ITEMS, ("QS01", "1", "O", "a")]}, {"item keys are unique", "fixed documents are as expected"}),
    ({"expected": [("QS09", None, None, None, None)]}, {"fixed documents are as expected"}),
    ({"expected": [("QS01", None, None, None, "floor")]}, {"fixed documents are as expected"}),
    ({"docs": [], "items": [], "listed": [], "expected": []}, {"enough documents", "items are nested deep enough"}),
])
def test_standards_planted(spark, instead, broken):
    assert standing(spark, **instead) == broken


def test_contracts(spark):
    frame = spark.createDataFrame
    clauses = standards.describe_clauses(frame([("P", "t", "P/t/1", "請款 5%"), ("P", "t", "P/t", "扣款")], "project string, trade string, clauseKey string, text string"))
    items = standards.describe_items(frame([("QS01", "1", "R", "依合約規定"), ("QS01", "2", "R", "x")], "docNo string, itemNo string, status string, name string"))
    found = checks.check_contracts(
        frame([("P", "t"), ("P", "u")], "project string, trade string"), clauses, items, frame([("QS01-2", "P/t/1"), ("QS07-1", "P/t/9")], "itemKey string, clauseKey string"),
        frame([("edge", "P/x/1")], "name string, clauseKey string"), docs_least=2, clauses_least=3, kinds_least={"payment": 1, "penalty": 2},
    )
    told = {r.check: (r.status, r.detail) for r in found.collect()}
    bad = {"every contract has clauses": "1", "enough clauses": "2", "clause keys are project/trade/number": "1", "enough clauses of penalty": "1",
           "answers name clauses": "1", "answers name items": "1", "interfaces name clauses": "1"}
    assert {k: d for k, (s, d) in told.items() if s == "fail"} == bad
    open_items = standards.flagged(items, "contract").count()
    assert told["items that lean on a contract are answered"] == ("warn" if open_items else "pass", str(open_items))
