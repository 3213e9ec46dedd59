"""Streaming counterparts: idempotent feedback, latest state, rates, over file streams until nothing is left."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fieldsift.scale import latest_by
from fieldsift.session import shared_dir

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def file_stream(spark: SparkSession, folder: str, name: str, schema: str = EVENT) -> DataFrame:
    """Rows of the table `name` in `folder`, a plain file or a folder of part files, as a stream."""
    reader = spark.readStream.schema(StructType.fromDDL(schema))
    files = spark.read.parquet(f"{folder}/{name}").inputFiles()
    if len(files) == 1 and files[0].rstrip("/").endswith(f"/{name}"):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(f"{folder}/{name}")


class Feed:
    """A source folder that is fed part by part; after each part the query goes on from its checkpoint."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/feed-{uuid.uuid4().hex}"

    def run(self, parts: list[DataFrame], plan: Callable[[DataFrame], DataFrame], take: Callable[[DataFrame, int], None], mode: str = "update") -> None:
        """`plan` makes the query of the stream; `take(rows, batch)` gets what each batch gives."""
        for part in parts:
            part.write.mode("append").parquet(f"{self.base}/source")
            stream = plan(self.spark.readStream.schema(part.schema).parquet(f"{self.base}/source"))
            writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{self.base}/checkpoint")
            writer.trigger(availableNow=True).foreachBatch(take).start().awaitTermination()

    def newest(self, parts: list[DataFrame], plan: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
        """The last row that the query has given for each key. A repeated batch writes its own folder again."""
        schema: list[StructType] = []

        def planned(stream: DataFrame) -> DataFrame:
            out = plan(stream)
            schema[:] = [out.schema]
            return out

        self.run(parts, planned, lambda rows, batch: rows.write.mode("overwrite").parquet(f"{self.base}/rows/batch={batch}"))
        return _newest(self.spark, f"{self.base}/rows", schema[0], keys)


def _newest(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    batches = StructType([*schema.fields, StructField("batch", LongType())])
    try:
        rows = spark.read.schema(batches).parquet(path)
    except AnalysisException as absent:  # no batch came
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return latest_by(rows, keys, "batch").select(*schema.names)


def once_only(stream: DataFrame, key: str = "event_id", time: str = "ts", late: str = "7 days") -> DataFrame:
    """Each key once; what arrives again within the watermark is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def latest_state(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest `order` for each key so far."""
    rest = [c for c in stream.columns if c not in keys]
    picked = stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def rates(stream: DataFrame, width: str = "1 day", time: str = "ts", late: str = "1 day") -> DataFrame:
    """Events and summed value for each window and type."""
    per = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type")
    out = per.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "events", "total")


def drained(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Run the stream until its source is empty and hand back what it has written.

    Without keys rows are appended. With keys the query runs in update mode: each batch gives the rows that have
    changed, in a folder of its own, so a repeated batch writes the same place again, and the last row of a key counts.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode("update" if keys else "append").option("checkpointLocation", f"{base}/checkpoint")
    writer = writer.trigger(availableNow=True)
    if keys:
        writer.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{base}/rows/batch={batch}")).start().awaitTermination()
        return _newest(spark, f"{base}/rows", stream.schema, keys)
    writer.format("parquet").start(f"{base}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def review_rates(stream: DataFrame, low: float, width: str = "1 day", late: str = "3 days") -> DataFrame:
    """Reviews, and how many were overridden, rejected or of low confidence, by window, site, class and model version.

    `stream`: ts, site, cls, version, overridden, rejected, confidence. A row that comes late counts as long as its
    window ends after the watermark; the state of older windows is given up.
    """
    per = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "site", "cls", "version")
    share = lambda name: F.col(name) / F.col("reviews")
    counted = per.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count_if("overridden").alias("overrides"),
        F.count_if("rejected").alias("rejects"),
        F.count_if(F.col("confidence") < low).alias("lows"),
    )
    return counted.select(
        F.col("w.start").alias("start"), "site", "cls", "version", "reviews",
        share("overrides").alias("overrideRate"), share("rejects").alias("rejectRate"), share("lows").alias("lowRate"),
    )


def accepted(stream: DataFrame, check: Callable[[], DataFrame], key: str) -> DataFrame:
    """Stream rows whose key a static table knows (stream-static join)."""
    return stream.join(check().select(key).distinct(), key, "left_semi")
