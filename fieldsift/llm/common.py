"""What the operators of this subpackage share: inputs, tables in the shared folder, labelled samples."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsift.session import shared_dir

#: Rows of `labels` that a classifier is fitted on, at most. Counts and statistics have no such bound.
LABEL_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """`doc_id` as long and `text` (null: empty), with the named further columns; the rest is pruned."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    This cuts the lineage: a later loss of an executor reads the files again instead of redoing the work, and
    what is read twice is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_batch(df: DataFrame, fn: Callable[..., dict[str, Iterable]], schema: str, *args: object) -> DataFrame:
    """Apply `fn(columns, *args)` to each Arrow batch; `columns` maps names to Python lists, and so does the result."""
    names = df.columns
    # names, not positions, decide, and the declared types hold even for an empty batch
    target = pa.schema(_arrow_fields(df.sparkSession, schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn({n: batch.column(i).to_pylist() for i, n in enumerate(names)}, *args)
            yield pa.RecordBatch.from_pydict({f.name: pa.array(out[f.name], f.type) for f in target}, schema=target)

    return df.mapInArrow(run, schema)


def _arrow_fields(spark: SparkSession, schema: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return list(to_arrow_schema(StructType.fromDDL(schema)))


def remainder(modulus: int) -> Column:
    """crc32 of the decimal text of `doc_id`, modulo `modulus` (null where the id is null)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def labelled_ids(labels: DataFrame, column: str, usable: Column | None = None, rows: int = LABEL_ROWS) -> DataFrame:
    """`doc_id, label`: at most `rows` labelled ids, the first ones in hash order.

    Rows without id or label take no part; an id labelled several times counts once, with its highest label.
    `usable` restricts the ids, for instance to those outside a held-out part.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if usable is not None:
        known = known.filter(usable)
    each = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    return each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
