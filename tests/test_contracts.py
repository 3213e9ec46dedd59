from fieldsift.operators import standards

CLAUSES = [("P", "t", "v", "d1", "P/t/1", "厚度誤差3mm"), ("P", "t", "v", "d2", "P/t/1", "厚度5mm"), ("P", "t", "w", None, "P/t/2", "厚度6mm"), ("P", "u", "v", "d1", "P/u/1", "厚度7mm")]


def test_contracts_of_one_trade_stay_apart(spark):
    clauses = standards.describe_clauses(spark.createDataFrame(CLAUSES, "project string, trade string, vendor string, docDate string, clauseKey string, text string"))
    items = standards.describe_items(spark.createDataFrame([("QS01", "1", "R", "厚度10mm"), ("QS01", "2", "O", "厚度11mm")], "docNo string, itemNo string, status string, name string"))
    trades = spark.createDataFrame([("t", "QS01")], "trade string, docNo string")
    found = standards.conflict_candidates(items, clauses, trades)
    rows = {(r.vendor, r.docDate): (r["items"], r.clauses) for r in found.filter("topic = '厚度'").collect()}
    assert rows == {("v", "d1"): (1, 1), ("v", "d2"): (1, 1), ("w", None): (1, 1)}
    lines = standards.conflict_evidence(found.filter("topic = '厚度'"), items, clauses).collect()
    assert sorted((r.vendor, r.docDate or "", r.side, r.line) for r in lines) == sorted(
        [(v, d or "", "contract", text) for _, t, v, d, _, text in CLAUSES if t == "t"] + [(v, d, "standard", "厚度10mm") for v, d in [("v", "d1"), ("v", "d2"), ("w", "")]]
    )
    per = standards.clause_summary(clauses).collect()
    assert len(per) == 4 and all(r.clauses == r.with_number == 1 for r in per)
