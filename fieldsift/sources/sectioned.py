"""Line-oriented text where a `#DOC` line opens a document and later lines belong to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldsift.scale import last_before

LINE_SCHEMA = "file string, block long, pos long, text string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: file, split within the file, and order inside the split."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("text"),
    )


def carry_forward(lines: DataFrame, header: str, out: str) -> DataFrame:
    """Give every line the latest non-null `header` at or before it, across splits and files.

    Inside a split an ordinary window does it; between splits only one value each is carried.
    """
    before = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = lines.groupBy("file", "block").agg(
        F.max_by(header, F.when(F.col(header).isNotNull(), F.col("pos"))).alias("__end")
    )
    # one row per file split, of which there may be as many as files
    carried = last_before(ends, ["file", "block"], "__end", "__carried").select("file", "block", "__carried")
    return (
        lines.withColumn("__own", F.last(header, ignorenulls=True).over(before))
        .join(carried, ["file", "block"])
        .withColumn(out, F.coalesce("__own", "__carried"))
        .drop("__own", "__carried")
    )


def _fields(lines: DataFrame) -> DataFrame:
    is_doc = F.col("text").startswith("#DOC")
    return (
        lines.filter(F.trim("text") != "")
        .filter(is_doc | ~F.col("text").startswith("#"))
        .withColumn("is_doc", is_doc)
        .withColumn("f", F.split("text", "\t"))
    )


def _field(i: int) -> Column:
    return F.trim(F.try_element_at(F.col("f"), F.lit(i + 1)))


def _header(names: list[str], least: int) -> Column:
    fields = [_field(i + 1).alias(n) for i, n in enumerate(names)]
    place = [F.col("file").alias("h_file"), F.col("block").alias("h_block"), F.col("pos").alias("h_pos")]
    return F.when(F.col("is_doc") & (F.size("f") >= least), F.struct(*fields, *place))


class Sections:
    """Documents, their rows, and every line that breaks the format."""

    def __init__(self, docs: DataFrame, rows: DataFrame, problems: DataFrame):
        self.docs, self.rows, self.problems = docs, rows, problems

    def checked(self) -> Sections:
        """Fail on the first broken line."""
        bad = self.problems.orderBy("file", "block", "pos").first()
        if bad:
            raise ValueError(f"{bad['file']} [{bad['block']}:{bad['pos']}]: {bad['problem']}")
        return self


def _parse(lines: DataFrame, names: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    tagged = carry_forward(_fields(lines).withColumn("__h", _header(names, least)), "__h", "doc")
    docs = tagged.filter("is_doc and __h is not null").select("__h.*")
    return docs, tagged


def parse_standards(lines: DataFrame) -> Sections:
    """`#DOC docNo isoInfoId name`, then `itemNo O|R name`."""
    docs, tagged = _parse(lines, ["docNo", "isoInfoId", "name"], 4)
    status = _field(1)
    problem = (
        F.when(F.col("is_doc") & (F.size("f") < 4), F.lit("document line has too few fields"))
        .when(~F.col("is_doc") & (F.size("f") < 3), F.lit("item line has too few fields"))
        .when(~F.col("is_doc") & F.col("doc").isNull(), F.lit("item before any document"))
        .when(~F.col("is_doc") & ~status.isin("O", "R"), F.lit("status is neither O nor R"))
    )
    broken = tagged.select("file", "block", "pos", problem.alias("problem")).filter(F.col("problem").isNotNull())
    again = docs.groupBy("docNo").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("h_file", "h_block", "h_pos")).alias("at")
    )
    repeated = again.filter("n > 1").select(
        "at.h_file", "at.h_block", "at.h_pos", F.concat(F.lit("document number used twice: "), "docNo")
    )
    items = tagged.filter("not is_doc and size(f) >= 3 and doc is not null").select(
        F.col("doc.docNo").alias("docNo"),
        _field(0).alias("itemNo"),
        status.alias("status"),
        _field(2).alias("name"),
        "file",
        "block",
        "pos",
    )
    return Sections(docs, items.filter(F.col("status").isin("O", "R")), broken.union(repeated))


def parse_contracts(lines: DataFrame) -> Sections:
    """`#DOC project trade vendor date kind [note]`, then `no sheet text`."""
    docs, tagged = _parse(lines, ["project", "trade", "vendor", "docDate", "kind", "note"], 6)
    problem = (
        F.when(F.col("is_doc") & (F.size("f") < 6), F.lit("document line has too few fields"))
        .when(~F.col("is_doc") & (F.size("f") < 3), F.lit("clause line has too few fields"))
        .when(~F.col("is_doc") & F.col("doc").isNull(), F.lit("clause before any document"))
    )
    broken = tagged.select("file", "block", "pos", problem.alias("problem")).filter(F.col("problem").isNotNull())
    clauses = tagged.filter("not is_doc and size(f) >= 3 and doc is not null").select(
        "doc.project",
        "doc.trade",
        "doc.vendor",
        "doc.docDate",
        F.col("doc.kind").alias("docKind"),
        _field(1).alias("sheet"),
        _field(0).alias("no"),
        _field(2).alias("text"),
        F.concat_ws("/", "doc.project", "doc.trade", _field(0)).alias("clauseKey"),
        "file",
        "block",
        "pos",
    )
    return Sections(docs.withColumn("note", F.coalesce("note", F.lit(""))), clauses, broken)
