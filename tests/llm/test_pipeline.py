import corpus_pipeline
from tests.llm.conftest import SF
from tests.llm.test_near_copies import plain_groups, plain_pairs
from tests.llm.test_packing import check
from tests.llm.test_pii import plain_base

import __spark_entry__
from fieldsift.llm.common import keep, table


def test_stages_one_by_one(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "personal_data", "mixture", "sequences"]
    stage = dict(corpus_pipeline.STAGES)
    good = keep(stage["quality"](spark, docs, SF), "t")
    assert good.columns == columns
    judged = __spark_entry__.queries()["op2_quality_rules"](spark, SF)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in judged.filter("kept").collect()}

    single = keep(stage["near_duplicates"](spark, good, SF), "t")
    rows = good.collect()
    groups = plain_groups(rows, plain_pairs(rows))
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(set(groups.values()))

    clean = keep(stage["personal_data"](spark, single, SF), "t")
    before = {r.doc_id: r for r in single.collect()}
    assert clean.columns == columns and clean.count() == len(before)
    for r in clean.collect():
        assert not plain_base(r.text)
        old = before[r.doc_id]
        assert (r.text == old.text) or plain_base(old.text)
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (old.lang, old.source)

    mixed = keep(stage["mixture"](spark, clean, SF), "t")
    assert mixed.columns == columns and {repr(r) for r in mixed.collect()} == {repr(r) for r in clean.collect()}
    check(mixed.collect(), stage["sequences"](spark, mixed, SF).collect())


def test_run_is_the_stages_in_turn(spark):
    rows = __spark_entry__.queries()["pipeline"](spark, SF).collect()
    again = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        again = keep(stage(spark, again, SF), "t")
    own = lambda found: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in found)
    assert rows and own(rows) == own(again.collect())


def test_empty_and_odd(spark, empty, odd):
    for given in (empty, odd):
        rows = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = keep(stage(spark, rows, SF), "t")
            assert rows.columns == given.columns
            # nothing is made up, and what a stage leaves alone stays as it was
            assert set(map(repr, rows.collect())) <= set(map(repr, given.collect()))
        check(rows.collect(), corpus_pipeline.STAGES[-1][1](spark, rows, SF).collect())
        assert given is odd or rows.isEmpty()
