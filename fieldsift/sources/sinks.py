"""Exports: review queue, browse layout, annotation tasks, detection labels, de-identified pack."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fieldsift import fixed_values as V
from fieldsift.functions.text import blank, safe_name
from fieldsift.operators import deident

#: Rows a file of a pack may hold, so that a file's checksum is taken of a bounded content.
PACK_FILE_ROWS = 500_000
PACK_CSV = {"header": True, "escape": '"'}


def queue_entries(routed: DataFrame) -> DataFrame:
    """Open items in contract form, reasons as a list; order by (priority, -reportDate) to consume."""
    return routed.filter(F.col("bucket").isin("queue", "audit")).select(
        "fileId",
        "bucket",
        F.filter(F.split("reason", V.REASON_SEPARATOR), lambda w: w != "").alias("reasons"),
        blank("ruleClass").alias("ruleClass"),
        blank("modelClass").alias("modelClass"),
        F.bround("modelConfidence", 4).alias("modelConfidence"),
        blank("title").alias("title"),
        blank("reportDate").alias("reportDate"),
        "priority",
    )


def write_queue(entries: DataFrame, path: str) -> None:
    """Globally ordered JSON lines: parts are range-sorted, so reading them by name gives the order."""
    entries.orderBy(F.col("priority"), F.col("reportDate").desc(), F.col("fileId")).write.mode("errorifexists").json(path)


def browse_rows(photos: DataFrame) -> DataFrame:
    """Paths of the by-date, by-site and by-class views of each photo."""
    site = safe_name(F.coalesce(F.nullif(F.col("constrName"), F.lit("")), F.col("constrId")))
    page = F.concat(
        F.lpad(F.coalesce(F.col("pageSort").cast("int"), F.lit(0)).cast("string"), 2, "0"), F.lit("-"), safe_name(F.col("title"), "untitled")
    )
    name = F.concat(F.lpad(F.coalesce(F.col("serial").cast("int"), F.lit(0)).cast("string"), 2, "0"), F.lit("-"), F.col("fileId"))
    views = F.array(
        F.struct(F.lit("by-date").alias("view"), F.concat_ws("/", safe_name(F.col("reportDate")), site, page, name).alias("path")),
        F.struct(F.lit("by-site").alias("view"), F.concat_ws("/", site, safe_name(F.col("reportDate")), page, name).alias("path")),
        F.struct(F.lit("by-class").alias("view"), F.concat_ws("/", safe_name(F.col("cls")), F.col("fileId")).alias("path")),
    )
    return photos.select("fileId", F.inline(views))


def write_browse(photos: DataFrame, path: str) -> None:
    browse_rows(photos).write.mode("errorifexists").partitionBy("view").parquet(path)


def annotation_tasks(photos: DataFrame) -> DataFrame:
    """Photos tagged with the site-and-day task they belong to."""
    return photos.select(
        "fileId",
        F.concat_ws("|", "constrId", "reportDate").alias("taskId"),
        blank("title").alias("title"),
        "constrName",
        "reportDate",
    )


def task_sizes(tasks: DataFrame) -> DataFrame:
    """How many tasks hold how many photos."""
    per_task = tasks.groupBy("taskId").agg(F.count(F.lit(1)).alias("photos"))
    return per_task.groupBy("photos").agg(F.count(F.lit(1)).alias("tasks"))


def detection_labels(boxes: DataFrame, class_ids: DataFrame) -> DataFrame:
    """One label line per box: class id, centre and size as shares of the image."""
    six = lambda c: F.format_string("%.6f", c)
    line = F.concat_ws(
        " ",
        F.col("classId").cast("string"),
        six((F.col("x0") + F.col("x1")) / 2000),
        six((F.col("y0") + F.col("y1")) / 2000),
        six((F.col("x1") - F.col("x0")) / 1000),
        six((F.col("y1") - F.col("y0")) / 1000),
    )
    return boxes.join(class_ids, "pattern").select("part", "fileId", line.alias("line"))


def write_detection_labels(labels: DataFrame, path: str) -> None:
    labels.write.mode("errorifexists").partitionBy("part").option("header", False).csv(path)


class PackError(ValueError):
    """A pack that may not be published, or one that is not what its manifest says."""


def _pack_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    schema = StructType([StructField(c, StringType()) for c in V.PACK_TABLES[name]])
    return spark.read.schema(schema).options(**PACK_CSV).csv(f"{path}/{name}").fillna("")


def _counted(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows) of each table."""
    each = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, each)


def _file_sums(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """(file, sha256) of the part files below the folders `names` of a pack; a file holds `PACK_FILE_ROWS` rows at most."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load([f"{path}/{n}" for n in names])
    return found.select(F.substring_index("path", "/", -2).alias("file"), F.sha2("content", 256).alias("sha256"))


def publish_pack(
    tables: Mapping[str, DataFrame], allowed: Mapping[str, Sequence[str]], path: str, *, version: str, boundary: str, licensed: bool = False, stats: Mapping[str, int] | None = None
) -> DataFrame:
    """Publish the three tables, the taxonomy and a manifest under `path`, all or nothing; returns the manifest.

    `tables` holds every table of `PACK_TABLES`, `allowed` the classes and defect patterns a cell may name, `boundary`
    the text of the agreement on what may leave (its SHA-256 goes into the manifest). Tables are stored once beside
    the target, and what is stored is checked, so a source that changes meanwhile cannot slip in: a column or cell that
    may not leave, an empty table of judgements, or a version or target that is not fit, and nothing is published.
    The checked folder is moved to `path` in one step; on object stores, where a move is many copies, the manifest
    is what counts, see `read_pack`. An existing target is never written over.
    """
    spark = next(iter(tables.values())).sparkSession
    if not re.fullmatch(V.PACK_VERSION, version):
        raise PackError(f"version {version!r}: letters, digits, hyphens and underscores, 64 at most")
    if set(tables) != set(V.PACK_TABLES):
        raise PackError(f"a pack holds {sorted(V.PACK_TABLES)}, given are {sorted(tables)}")
    for name, df in tables.items():
        if leaked := sorted(set(df.columns) & set(V.PACK_FORBIDDEN)):
            raise PackError(f"{name}: forbidden columns {leaked}")
        if set(df.columns) != set(V.PACK_TABLES[name]):
            raise PackError(f"{name}: columns differ from {list(V.PACK_TABLES[name])}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        raise PackError(f"{path} exists")
    staging = target.suffix(f".building-{uuid.uuid4().hex}")
    place = staging.toString()
    try:
        back, checked = {}, {}
        for name, df in tables.items():
            columns = list(V.PACK_TABLES[name])
            out = df.select(*columns).write.mode("errorifexists").option("maxRecordsPerFile", PACK_FILE_ROWS)
            out.options(**PACK_CSV, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{place}/{name}")
            back[name] = _pack_table(spark, place, name)
            checked[name] = deident.checked_cells(back[name], V.PACK_TABLES[name], allowed).first()
            bad = next((b for b in checked[name].bad if b.rows), None)
            if bad:  # the value itself may be what must not leave, so it is not shown
                raise PackError(f"{name}: {bad.rows} cells of {bad.column} are not of type {bad.type}")
        if not checked["judgements"].rows:
            raise PackError("no human judgement to publish")
        names = [("tradeClass", sorted(allowed["taxonomy"])), ("defectPattern", list(V.DEFECT_PATTERNS)), ("buttonOnly", sorted(V.DEFECT_BUTTON_ONLY))]
        kinds = spark.createDataFrame([(k, v) for k, values in names for v in values], "kind string, name string")
        kinds.coalesce(1).write.json(f"{place}/taxonomy")
        sums = _file_sums(spark, place, [*V.PACK_TABLES, "taxonomy"]).agg(F.array_sort(F.collect_list(F.struct("file", "sha256"))).alias("files"))
        counted = [x for name in sorted(back) for x in (F.lit(name), F.lit(checked[name].rows).cast("long"))]
        counts = spark.range(1).select(F.create_map(*counted).alias("counts"))
        breakdown = deident.override_breakdown(back["judgements"]).select(F.struct("*").alias("judgementBreakdown"))
        more = F.create_map(*[F.lit(x) for pair in (stats or {}).items() for x in pair]).cast("map<string,long>")
        manifest = counts.crossJoin(breakdown).crossJoin(sums).select(  # one row each
            F.lit(V.PACK_SCHEMA).alias("schemaVersion"), F.lit(version).alias("packVersion"), F.lit("licensed-external" if licensed else "internal-only").alias("distribution"),
            F.sha2(F.lit(boundary), 256).alias("boundarySha256"), "counts", "judgementBreakdown", more.alias("stats"), "files", F.current_timestamp().alias("createdAt"),
        )
        manifest.coalesce(1).write.json(f"{place}/manifest")
        if files.exists(target) or not files.rename(staging, target):
            raise PackError(f"{path} exists or cannot be made")
    except BaseException:
        files.delete(staging, True)
        raise
    return pack_manifest(spark, path)


def pack_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The one row of a pack's manifest."""
    return spark.read.schema(V.PACK_MANIFEST).json(f"{path}/manifest")


def read_pack(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a published pack; an error where files are missing, added or changed since, or rows do not add up."""
    said = pack_manifest(spark, path).select(F.inline("files"))
    found = _file_sums(spark, path, [*V.PACK_TABLES, "taxonomy"]).withColumnRenamed("sha256", "now")
    off = said.join(found, "file", "full").filter(~F.col("sha256").eqNullSafe(F.col("now"))).agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file")).first()
    if off.n:
        raise PackError(f"{path}: {off.n} files differ from the manifest, first {off.file}")
    tables = {name: _pack_table(spark, path, name) for name in V.PACK_TABLES}
    counts = pack_manifest(spark, path).select(F.explode("counts").alias("table", "said"))
    wrong = counts.join(_counted(tables), "table", "full").filter(~F.col("said").eqNullSafe(F.col("rows"))).first()
    if wrong:
        raise PackError(f"{path}: {wrong['table']} has {wrong['rows']} rows, the manifest says {wrong['said']}")
    return tables
