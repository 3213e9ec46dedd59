"""Box annotations: drawn boxes in XML, and detector boxes a person found correct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsift import fixed_values as V

IMAGE_SCHEMA = (
    "_name string, _width string, _height string, "
    "box array<struct<_label:string,_xtl:string,_ytl:string,_xbr:string,_ybr:string>>"
)


def read_box_xml(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "image").schema(IMAGE_SCHEMA).load(path)


def _scaled(value: Column, size: Column) -> Column:
    # half-even, as in the format's other writers
    return F.greatest(F.lit(0), F.least(F.lit(1000), F.bround(value / size * 1000).cast("int")))


def drawn_boxes(images: DataFrame) -> DataFrame:
    """(fileId, defectType, box): boxes in thousandths of the image, clamped; slips of the mouse dropped."""
    number = lambda c: F.col(c).try_cast("double")
    corner = lambda b, f: F.coalesce(b[f], F.lit("0")).try_cast("double")
    sized = images.select(
        F.regexp_replace("_name", r"^.*/|\.[^./]*$", "").alias("fileId"),
        number("_width").alias("w"),
        number("_height").alias("h"),
        F.explode("box").alias("b"),
    ).filter("w > 0 and h > 0")
    b = F.col("b")
    placed = sized.select(
        "fileId",
        F.trim(F.coalesce(b["_label"], F.lit(""))).alias("defectType"),
        F.array(
            _scaled(corner(b, "_xtl"), F.col("w")),
            _scaled(corner(b, "_ytl"), F.col("h")),
            _scaled(corner(b, "_xbr"), F.col("w")),
            _scaled(corner(b, "_ybr"), F.col("h")),
        ).alias("box"),
        (
            corner(b, "_xtl").isNotNull()
            & corner(b, "_ytl").isNotNull()
            & corner(b, "_xbr").isNotNull()
            & corner(b, "_ybr").isNotNull()
        ).alias("whole"),
    ).filter("whole")
    side = F.lit(V.MIN_BOX_SIDE)
    return placed.filter(
        (F.col("box")[2] - F.col("box")[0] >= side) & (F.col("box")[3] - F.col("box")[1] >= side)
    ).drop("whole")


def known_label(label: str = "defectType") -> Column:
    return F.col(label).isin(*V.DEFECT_PATTERNS)


def rejected_labels(boxes: DataFrame) -> DataFrame:
    """How many boxes carry a label outside the agreed patterns."""
    return boxes.filter(~known_label()).groupBy("defectType").agg(F.count(F.lit(1)).alias("boxes"))


def confirmed_detections(verdicts: DataFrame, annotations: DataFrame) -> DataFrame:
    """Boxes judged correct. `verdicts`: runId, photoId, boxIdx, verdict. `annotations`: runId, photoId,
    width, height, boxes array<struct<pattern, box array<double>>>."""
    box = F.try_element_at("boxes", F.col("boxIdx") + 1)
    hit = (
        verdicts.filter(F.col("verdict") == "correct")
        .join(annotations, ["runId", "photoId"])
        .filter(F.col("boxIdx") < F.size("boxes"))
        .withColumn("b", box)
    )
    at = lambda i, size: (F.col("b.box")[i] / F.col(size) * 1000)
    return hit.select(
        F.col("photoId").alias("fileId"),
        F.col("b.pattern").alias("pattern"),
        at(0, "width").alias("x0"),
        at(1, "height").alias("y0"),
        at(2, "width").alias("x1"),
        at(3, "height").alias("y1"),
        F.col("width").alias("w"),
        F.col("height").alias("h"),
        F.concat(F.lit("gdino-correct/"), F.col("runId").cast("string")).alias("source"),
    )
