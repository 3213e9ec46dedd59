"""Streams over folder tables, replays, crashes between write and mark, and events out of order."""

import itertools

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldsift.plans import catalogue, streams
from fieldsift.streaming import feeds, registry, state

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder_tables(spark, tmp_path_factory):
    """The events as a folder of part files."""
    base = str(tmp_path_factory.mktemp("tables"))
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(f"{base}/events.parquet")
    spark.read.parquet(f"{SF}/customer.parquet").write.parquet(f"{base}/customer.parquet")
    return base


@pytest.mark.parametrize("name", ["stream_known_users", "stream_feedback_idempotent", "stream_latest_state", "stream_rates"])
def test_a_folder_gives_what_a_file_gives(spark, folder_tables, name):
    one, many = (sorted(map(tuple, catalogue.QUERIES[name](spark, sf).collect())) for sf in (SF, folder_tables))
    assert one and one == many


def test_a_stream_without_rows_gives_an_empty_frame(spark, tmp_path):
    spark.createDataFrame([], feeds.EVENT).write.parquet(f"{tmp_path}/events.parquet")
    stream = feeds.file_stream(spark, str(tmp_path), "events.parquet").select("user_id", "event_id", "value")
    assert feeds.drained(feeds.latest_state(stream, ["user_id"], "event_id"), ["user_id"]).collect() == []


def test_candidate_lifecycle():
    def events(*kinds):
        return [{"seq": i, "kind": k, "label": "a-b", "definition": f"d{i}", "complete": c, "fileIds": [f"f{i}"]} for i, (k, c) in enumerate(kinds)]

    after = state.candidate_after
    assert after(events(("approve", True), ("reject", True))) is None
    open_ = after(events(("propose", True), ("approve", False), ("propose", True)))
    assert (open_["status"], open_["fileIds"], open_["refused"], open_["closedSeq"]) == ("proposed", ["f0", "f2"], 1, None)
    closed = after(events(("propose", True), ("approve", True), ("propose", True), ("reject", True)))
    assert (closed["status"], closed["fileIds"], closed["refused"], closed["closedSeq"]) == ("approved", ["f0"], 2, 1)
    assert not state.complete("a", " ", "b") and not state.complete("a", None, "b") and state.complete("a", "b", "c")


def test_any_order_of_arrival_ends_in_the_same_state(spark):
    log = [("x", 1, "approve"), ("x", 2, "propose"), ("x", 3, "propose"), ("x", 4, "reject"), ("x", 5, "propose"), ("y", 6, "approve"), ("z", 7, "propose")]
    rows = [(c, s, k, "a-b", f"d{s}", "not", "tree", [f"f{s}"]) for c, s, k in log]
    want = sorted(map(tuple, state.candidates_of(spark.createDataFrame(rows, state.CANDIDATE)).collect()))
    assert [w[:2] for w in want] == [("x", "rejected"), ("z", "proposed")]
    for order in list(itertools.permutations(range(3)))[:3]:
        parts = [spark.createDataFrame([r for i, r in enumerate(rows) if i % 3 == n], state.CANDIDATE) for n in order]
        with state.rocks(spark):
            got = feeds.Feed(spark).newest(parts, state.candidate_states, ["candidateId"])
        assert sorted(map(tuple, got.collect())) == want


def test_candidate_states_are_columns_and_follow_the_lifecycle(spark, tmp_path):
    kinds = ["propose", "approve", "propose", "reject", None]
    log = [(f"c{n // 25}", n, kinds[(n * 7 + n // 3) % 5], f"l{n}", f"d{n}" if n % 4 else " ", "no\u3000" if n % 3 else "\u3000", "tree", [f"f{n % 6}"] if n % 5 else None) for n in range(200)]
    df = spark.createDataFrame(log, state.CANDIDATE)
    parts = [df.filter(f"seq % 3 = {n}") for n in (2, 0, 1)]
    with state.rocks(spark):
        got = {r.candidateId: r for r in feeds.Feed(spark).newest(parts, state.candidate_states, ["candidateId"]).collect()}
    for c in {r[0] for r in log}:
        events = [{"seq": s, "kind": k, "label": la, "definition": d, "complete": state.complete(d, x, b), "fileIds": f or []} for c_, s, k, la, d, x, b, f in log if c_ == c]
        want = state.candidate_after(events)
        assert {k: got[c][k] for k in want} == want
    plan = state.candidate_states(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan


def test_a_late_review_ends_a_decision(spark):
    schema = "fileId string, kind string, seq long, reviewSeq long, action string"
    parts = [[("a", "decision", 5, 3, "uncertain"), ("b", "decision", 9, None, "excluded")], [("a", "review", 3, None, None)], [("a", "review", 7, None, None)]]
    seen = []
    feed = feeds.Feed(spark)
    with state.rocks(spark):
        feed.run([spark.createDataFrame(p, schema) for p in parts], state.decision_states, lambda rows, n: seen.append({r.fileId: r.active for r in rows.collect()}))
    assert [s for s in seen if s] == [{"a": False, "b": True}, {"a": True}, {"a": False}]


SCHEMA = "k string, a string, b long, seq long"


@pytest.fixture
def held(spark, tmp_path):
    return registry.Registry(spark, f"{tmp_path}/r", "k", ["a", "b"], StructType.fromDDL(SCHEMA), "seq", buckets=4)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_what_is_recorded_stays(spark, held):
    assert held.rows().collect() == [] and held.conflicts().collect() == [] and held.last_commit() == -1
    assert held.upsert(frame(spark, [("x", "one", 1, 2), ("x", "one", 1, 3), ("x", "two", 1, 4), ("y", None, None, 5), (None, "no", 1, 6)]), 0)
    assert held.upsert(frame(spark, [("x", "one", 1, 1), ("y", None, None, 7), ("y", "", None, 8), ("z", "new", 2, 9)]), 1)
    assert sorted(map(tuple, held.rows().collect())) == [("x", "one", 1, 2), ("y", None, None, 5), ("z", "new", 2, 9)]
    got = sorted(map(tuple, held.conflicts().collect()), key=lambda r: r[3])
    assert got == [("x", "two", 1, 4, 2), (None, "no", 1, 6, None), ("y", "", None, 8, 5)]


def test_replays_and_a_crash_before_the_mark_change_nothing(spark, held):
    batch = frame(spark, [("x", "one", 1, 1), ("x", "two", 1, 2)])
    held.upsert(batch, 0)
    before = held.rows().collect(), held.conflicts().collect()
    assert held.upsert(frame(spark, [("x", "other", 1, 0)]), 0) is False
    assert (held.rows().collect(), held.conflicts().collect()) == before
    # rows of a batch that was written, but never marked, are not seen, and its repetition replaces them
    frame(spark, [("lost", "half", 1, 1)]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{held.path}/rows/batch=1")
    assert held.rows().collect() == before[0]
    held.upsert(frame(spark, [("whole", "row", 1, 1)]), 1)
    assert {r.k for r in held.rows().collect()} == {"x", "whole"}


def test_one_class_list_a_catalogue_version(spark, tmp_path):
    lists = registry.Registry(spark, f"{tmp_path}/c", "catalogVersion", ["classes"], StructType.fromDDL("catalogVersion string, classes array<string>, seq long"), "seq")
    rows = [("c1", ["a", "b"], 1), ("c1", ["b", "a"], 2), ("c2", ["a"], 3)]
    lists.upsert(spark.createDataFrame(rows, lists.schema), 0)
    assert {r.catalogVersion: r.classes for r in lists.rows().collect()} == {"c1": ["a", "b"], "c2": ["a"]}
    assert [tuple(r) for r in lists.conflicts().collect()] == [("c1", ["b", "a"], 2, 1)]


def test_rules_and_mismatches(spark):
    base = ("e", "p1", "f", "i", "v", "m", "c", 1)
    rows = [(*base, "correct", "a", None), (*base, "correct", "", None), (*base, "agree", "a", "x-y"), (*base, "new_candidate", None, None), (*base, None, None, None)]
    ruled = spark.createDataFrame(rows, streams.FEEDBACK).select(registry.broken_rules().alias("b")).collect()
    assert [len(r.b) for r in ruled] == [0, 1, 2, 1, 0]
    known = spark.createDataFrame([("p1", "f", "i", "v", "m", "c", 1)], streams.PREDICTION)
    classes = spark.createDataFrame([("c", ["a"])], "catalogVersion string, classes array<string>")
    asked = [(*base, "correct", "a", None), (*base, "correct", "z", None), ("e", "p9", *base[2:], "agree", None, None), ("e", "p1", "g", None, *base[4:], "agree", None, None)]
    got = registry.mismatches(spark.createDataFrame(asked, streams.FEEDBACK), known, classes).collect()
    assert [r.mismatch for r in got] == [[], ["selectedClass"], ["prediction"], ["fileId", "imageSha256"]]
