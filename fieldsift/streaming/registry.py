"""Insert-once tables for streams: what is recorded stays, a repetition is ignored, a contradiction is a conflict row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Buckets of a registry by hash of the key; fixed for its lifetime.
BUCKETS = 64


def payload_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of named columns, nulls kept apart from empty texts."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


class Registry:
    """Rows by key under `path`: `rows/batch=N/bucket=K`, `conflicts/batch=N`, and a mark `commits/batch=N` written last.

    A batch without its mark counts as not written, and its repetition writes the same folders again; a batch at or
    before the last mark is passed over, so replays change nothing. Lookups read only the buckets that a batch has
    keys of. Only one query may write to a registry.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, identity: Sequence[str], schema: StructType, order: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self.identity, self.schema = list(identity), schema

    def _read(self, name: str, fields: list[StructField]) -> DataFrame:
        schema = StructType(fields)
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as absent:
            if absent.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def last_commit(self) -> int:
        """Number of the last batch with a mark, -1 before the first."""
        marks = self._read("commits", [StructField("n", LongType())])
        return -1 if (top := marks.agg(F.max("n")).first()[0]) is None else top

    def _committed(self, name: str, fields: list[StructField]) -> DataFrame:
        return self._read(name, [*fields, StructField("batch", LongType())]).filter(F.col("batch") <= self.last_commit())

    def rows(self) -> DataFrame:
        """What is recorded."""
        return self._committed("rows", [*self.schema.fields, StructField("bucket", IntegerType())]).select(*self.schema.names)

    def conflicts(self) -> DataFrame:
        """Rows whose key is recorded with another identity, and the `order` of the recorded row."""
        first = StructField("recorded", self.schema[self.order].dataType)
        return self._committed("conflicts", [*self.schema.fields, first]).select(*self.schema.names, "recorded")

    def upsert(self, batch: DataFrame, number: int) -> bool:
        """Record the new keys of a batch, and its conflicts; False where the batch is recorded already.

        Of several rows of one new key the first by `order` is recorded. A row without key is a conflict with nothing.
        """
        if number <= self.last_commit():
            return False
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows = batch.select(*self.schema.names).withColumn("bucket", bucket)
        rows.persist()
        try:
            touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
            known = self._committed("rows", [*self.schema.fields, StructField("bucket", IntegerType())])
            known = known.filter(F.col("bucket").isin(touched)).select("bucket", self.key, F.struct(*self.schema.names).alias("__known"))
            whole = F.struct(*self.schema.names)
            firsts = rows.filter(F.col(self.key).isNotNull()).groupBy("bucket", self.key).agg(F.min_by(whole, F.struct(self.order, payload_hash(self.identity))).alias("__first"))
            judged = firsts.join(known, ["bucket", self.key], "left").withColumn("__is", F.coalesce("__known", "__first"))
            fresh = judged.filter(F.col("__known").isNull()).select("bucket", "__first.*")
            fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={number}")
            same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__is.{c}")) for c in self.identity])
            against = rows.join(judged.select("bucket", self.key, "__is"), ["bucket", self.key], "left").filter(F.col("__is").isNull() | ~same)
            against.select(*self.schema.names, F.col(f"__is.{self.order}").alias("recorded")).write.mode("overwrite").parquet(f"{self.path}/conflicts/batch={number}")
        finally:
            rows.unpersist()
        self.spark.range(1).select(F.lit(number).cast("long").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={number}")
        return True


# --- feedback on predictions

IDENTITY = ["fileId", "imageSha256", "modelVersion", "modelSha256", "catalogVersion"]


def broken_rules() -> Column:
    """Names of the cross-field rules that a feedback event breaks; empty where it is well formed."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    correct, new = F.col("action") == "correct", F.col("action") == "new_candidate"
    rules = [
        ("correct requires selectedClass", correct & ~has("selectedClass")),
        ("selectedClass is only valid for correct", ~correct & has("selectedClass")),
        ("new_candidate requires candidateLabel", new & ~has("candidateLabel")),
        ("candidateLabel is only valid for new_candidate", ~new & has("candidateLabel")),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules]), lambda r: r.isNotNull())


def mismatches(events: DataFrame, predictions: DataFrame, classes: DataFrame) -> DataFrame:
    """`events` with `mismatch`: the names of what does not agree with the recorded prediction, empty where all does.

    `prediction` where none is recorded; else those of the five identity columns that differ, and `selectedClass` where it
    is none of the classes of that catalogue version (`classes`: catalogVersion, classes array).
    """
    held = predictions.select(F.col("predictionId"), F.struct(*IDENTITY).alias("__p"))
    lists = classes.select("catalogVersion", F.col("classes").alias("__classes"))
    rows = events.join(held, "predictionId", "left").join(lists, "catalogVersion", "left")
    differs = [F.when(~F.col(c).eqNullSafe(F.col(f"__p.{c}")), F.lit(c)) for c in IDENTITY]
    chosen = F.coalesce(F.col("selectedClass"), F.lit(""))
    unknown = F.when((chosen != "") & ~F.coalesce(F.array_contains("__classes", chosen), F.lit(False)), F.lit("selectedClass"))
    named = F.filter(F.array(*differs, unknown), lambda m: m.isNotNull())
    return rows.select(*events.columns, F.when(F.col("__p").isNull(), F.array(F.lit("prediction"))).otherwise(named).alias("mismatch"))


class Intake:
    """Feedback events judged in each batch: broken rules and mismatches go to reject sinks, the rest to a registry.

    `rejects/batch=N` and `mismatches/batch=N` are written before the registry commits the batch, so one mark covers
    all four outputs.
    """

    def __init__(self, registry: Registry, predictions: DataFrame, classes: DataFrame) -> None:
        self.registry, self.predictions, self.classes = registry, predictions, classes

    def take(self, batch: DataFrame, number: int) -> None:
        if number <= self.registry.last_commit():
            return
        path, names = self.registry.path, self.registry.schema.names
        ruled = batch.select(*names).withColumn("broken", broken_rules())
        ruled.filter(F.size("broken") > 0).write.mode("overwrite").parquet(f"{path}/rejects/batch={number}")
        judged = mismatches(ruled.filter(F.size("broken") == 0).drop("broken"), self.predictions, self.classes)
        judged.filter(F.size("mismatch") > 0).write.mode("overwrite").parquet(f"{path}/mismatches/batch={number}")
        self.registry.upsert(judged.filter(F.size("mismatch") == 0).drop("mismatch"), number)

    def _sink(self, name: str, column: str) -> DataFrame:
        from pyspark.sql.types import ArrayType, StringType

        fields = [*self.registry.schema.fields, StructField(column, ArrayType(StringType()))]
        return self.registry._committed(name, fields).select(*self.registry.schema.names, column)

    def rejects(self) -> DataFrame:
        return self._sink("rejects", "broken")

    def mismatched(self) -> DataFrame:
        return self._sink("mismatches", "mismatch")
