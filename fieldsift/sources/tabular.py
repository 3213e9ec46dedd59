"""All-string CSV tables, append-only tables and JSON-lines logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def with_columns(df: DataFrame, columns: Sequence[str], fill: str | None = "") -> DataFrame:
    """Exactly these columns, absent ones filled."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).cast("string").alias(c) for c in columns])


def _missing(problem: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER_SCHEMA" in str(problem)


def _by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """Files that share a header line, together. Reads the first line of each file; the driver lists files anyway."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    first = lines.filter("block = 0").withColumn("pos", F.monotonically_increasing_id())
    heads = first.groupBy("file").agg(F.min_by("value", "pos").alias("header"))
    return [r.files for r in heads.groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files")).collect()]


def read_strings(
    spark: SparkSession, path: str, columns: Sequence[str], *, blank_as_null: bool = False, multi_line: bool = False
) -> DataFrame:
    """CSV with every column a string. A missing file is an empty table; absent columns are filled.

    Columns go by the header of their own file, so files may order them differently. Fields with line breaks
    need `multi_line`, at the price of one task for each file.
    """
    try:
        groups = _by_header(spark, path)
    except AnalysisException as problem:
        if not _missing(problem):
            raise
        groups = []
    # null is written as "", and with an impossible null marker "" stays an empty string
    options = {"header": True, "nullValue": "\u0000", "emptyValue": "", "multiLine": multi_line, "escape": '"'}
    df = spark.createDataFrame([], string_schema(columns))
    for files in groups:
        df = df.unionByName(with_columns(spark.read.options(**options).csv(files), columns))
    if blank_as_null:
        return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in columns])
    return df.na.fill("")


def append_evolving(df: DataFrame, path: str) -> None:
    """Append to a Parquet table; columns may be added over time."""
    df.write.mode("append").parquet(path)


def read_evolving(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read an appended table; rows written before a column existed carry null in it."""
    try:
        have = spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as problem:
        if _missing(problem):
            return spark.createDataFrame([], schema)
        raise
    return spark.createDataFrame([], schema).unionByName(have, allowMissingColumns=True).select(*schema.names)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def newest(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last `n` entries of a log, newest first."""
    return df.orderBy(F.col(order).desc()).limit(n)


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack sources that share columns; a source may lack some."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def load_features(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Feature tables (fileId, emb) of several sources; sources not there yet are skipped."""
    schema = "fileId string, emb array<float>"
    frames = []
    for path in paths:
        try:
            frames.append(spark.read.parquet(path).selectExpr("cast(fileId as string) fileId", "cast(emb as array<float>) emb"))
        except AnalysisException as problem:
            if not _missing(problem):
                raise
    return union_sources(frames) if frames else spark.createDataFrame([], schema)
