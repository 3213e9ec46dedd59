import pytest
from pyspark.sql import functions as F

from fieldsift.sources.events import EventLog, StaleAppend

BATCH = "kind string, entity string, payload string, created_at timestamp, pos long"
EXPECTED = "kind string, entity string, seq long"


@pytest.fixture
def log(spark, tmp_path):
    return EventLog(spark, f"{tmp_path}/log", buckets=4)


def batch(spark, *entities):
    return spark.createDataFrame([("candidate", e, "{}", None, i) for i, e in enumerate(entities, 1)], BATCH)


def expected(spark, **seqs):
    return spark.createDataFrame([("candidate", e, s) for e, s in seqs.items()], EXPECTED)


def seqs(log):
    return sorted((r.entity, r.seq) for r in log.events().collect())


def test_whole_batches_on_valid_expectations(spark, log):
    assert log.version() == (0, 0) and log.events().collect() == []
    assert log.append(batch(spark, "a", "b", "a"), expected(spark, a=0, b=0)) == 1
    assert seqs(log) == [("a", 1), ("a", 3), ("b", 2)] and log.version() == (1, 3)
    assert log.append(batch(spark, "b", "c"), expected(spark, b=2)) == 2
    assert sorted((r.entity, r.seq) for r in log.heads().collect()) == [("a", 3), ("b", 4), ("c", 5)]


def test_a_stale_expectation_appends_nothing(spark, log):
    log.append(batch(spark, "a"), expected(spark))
    before = seqs(log)
    for wrong in ({"a": 0}, {"a": 1, "b": 1}, {"a": 2}):
        with pytest.raises(StaleAppend):
            log.append(batch(spark, "a", "b"), expected(spark, **wrong))
    assert seqs(log) == before and log.version() == (1, 1)


def test_of_two_writers_one_commits(spark, log):
    log.append(batch(spark, "a"), expected(spark))
    seen = log.version()
    log.append(batch(spark, "b"), expected(spark), at=seen)
    with pytest.raises(StaleAppend, match="another writer"):
        log.append(batch(spark, "c"), expected(spark), at=seen)
    assert seqs(log) == [("a", 1), ("b", 2)]


def test_an_attempt_that_died_is_never_read_and_empty_batches_pass(spark, log):
    log.append(batch(spark, "a"), expected(spark))
    lost = log.events().withColumn("bucket", F.lit(0))
    lost.write.partitionBy("bucket").parquet(f"{log.path}/events/attempt=lost")
    assert seqs(log) == [("a", 1)]
    assert log.append(batch(spark).filter("false"), expected(spark)) == 2
    assert log.append(batch(spark, "z"), expected(spark, z=0)) == 3 and log.version() == (3, 2)
