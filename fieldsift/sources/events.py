"""The append-only event log: one row per event, payload as JSON text."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "seq long, kind string, entity string, payload string, created_at timestamp"


def events_of(log: DataFrame, kind: str, payload_schema: str) -> DataFrame:
    """Events of one kind with the payload unpacked next to seq, entity and time."""
    body = F.from_json("payload", payload_schema).alias("p")
    return log.filter(F.col("kind") == kind).select(
        body, F.col("seq").alias("_seq"), F.col("entity").alias("_entity"), F.col("created_at").alias("_at")
    ).select("p.*", "_seq", "_entity", "_at")


def stale_expectations(log: DataFrame, expected: DataFrame) -> DataFrame:
    """Expectations (kind, entity, seq) that no longer hold: the entity moved on since it was read."""
    current = log.join(expected.select("kind", "entity").distinct(), ["kind", "entity"], "left_semi")
    top = current.groupBy("kind", "entity").agg(F.max("seq").alias("current_seq"))
    return (
        expected.join(top, ["kind", "entity"], "left")
        .withColumn("current_seq", F.coalesce("current_seq", F.lit(0).cast("long")))
        .filter(F.col("current_seq") != F.col("seq"))
    )


def checked_batch(log: DataFrame, batch: DataFrame, expected: DataFrame) -> DataFrame:
    """The batch as it may be appended: all of it, or nothing when any expectation is stale.

    Sequence numbers continue the log in the order of `batch.pos`, which numbers the batch from 1.
    """
    stale = stale_expectations(log, expected).agg(F.count(F.lit(1)).alias("stale"))
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top"))
    return (
        batch.crossJoin(F.broadcast(stale.crossJoin(top)))  # one row
        .filter(F.col("stale") == 0)
        .withColumn("seq", F.col("top") + F.col("pos"))
        .drop("stale", "top", "pos")
    )


class StaleAppend(Exception):
    """An expectation no longer holds, or another writer has committed first; nothing is appended."""


class EventLog:
    """An append-only log under `path` whose batches are appended whole, if what they were made on still holds.

    Each attempt writes `events/attempt=A/bucket=K` and the newest seq of its entities to `heads/attempt=A/bucket=K`; the commit
    `commits/version=N`, which must not exist, names the attempt. Attempts without a commit are never read. Expectations
    are checked against the heads of the batch's buckets, not against the log.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as absent:
            if absent.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def commits(self) -> DataFrame:
        return self._read("commits", "attempt string, top long, version long")

    def _committed(self, name: str, schema: str) -> DataFrame:
        return self._read(name, f"{schema}, attempt string, bucket int").join(self.commits().select("attempt"), "attempt", "left_semi")

    def events(self) -> DataFrame:
        """All committed events."""
        return self._committed("events", EVENT_SCHEMA).drop("attempt", "bucket")

    def heads(self) -> DataFrame:
        """The newest seq of each entity."""
        return self._committed("heads", "kind string, entity string, seq long").groupBy("kind", "entity", "bucket").agg(F.max("seq").alias("seq"))

    def version(self) -> tuple[int, int]:
        """Number of the last commit and the highest seq; zeros before the first."""
        last = self.commits().agg(F.max(F.struct("version", "top")).alias("m")).first()["m"]
        return (0, 0) if last is None else (last["version"], last["top"])

    def append(self, batch: DataFrame, expected: DataFrame, at: tuple[int, int] | None = None) -> int:
        """Append `batch` (kind, entity, payload, created_at, pos from 1) and return the new version.

        `expected` (kind, entity, seq; 0: none yet) must agree with the heads. `at` is a `version` read before; another
        writer's commit since then makes this one fail. An empty batch appends an empty version.
        """
        bucketed = F.pmod(F.xxhash64("kind", "entity"), F.lit(self.buckets)).cast("int")
        version, top = at or self.version()
        asked = expected.select("kind", "entity", F.col("seq").alias("wanted"), bucketed.alias("bucket"))
        touched = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most `buckets`
        now = self.heads().filter(F.col("bucket").isin(touched))
        stale = asked.join(now, ["kind", "entity", "bucket"], "left").filter(F.coalesce("seq", F.lit(0)) != F.col("wanted"))
        if not stale.isEmpty():
            raise StaleAppend("an entity has moved on since it was read")
        attempt = uuid.uuid4().hex
        rows = batch.select((F.col("pos") + top).alias("seq"), "kind", "entity", "payload", "created_at", bucketed.alias("bucket"))
        rows.write.partitionBy("bucket").parquet(f"{self.path}/events/attempt={attempt}")
        own = self._read(f"events/attempt={attempt}", f"{EVENT_SCHEMA}, bucket int")
        own.groupBy("kind", "entity", "bucket").agg(F.max("seq").alias("seq")).write.partitionBy("bucket").parquet(f"{self.path}/heads/attempt={attempt}")
        mark = own.agg(F.lit(attempt).alias("attempt"), F.coalesce(F.max("seq"), F.lit(top)).alias("top"))
        try:
            mark.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/commits/version={version + 1}")
        except AnalysisException as taken:
            if taken.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            raise StaleAppend("another writer has committed first") from taken
        return version + 1
