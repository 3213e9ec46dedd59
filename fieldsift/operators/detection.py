"""Detection training tables out of drawn boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift.functions.boxes import box_list
from fieldsift.operators.splitting import train_val_groups
from fieldsift.scale import materialise, quantiles


def drawn_box_rows(defects: DataFrame) -> DataFrame:
    """(fileId, pattern, x0, y0, x1, y1, source) of boxes from drawing tools."""
    rows = defects.filter(F.col("source").startswith("cvat")).select(
        "fileId", F.col("defectType").alias("pattern"), "source", F.explode(box_list(F.col("box"))).alias("b")
    )
    return rows.select("fileId", "pattern", *[F.col("b")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], "source")


def boxes_by_pattern(defects: DataFrame) -> DataFrame:
    """Every well-formed box under its pattern."""
    # with outer, the list is read once and not again for a filter before
    return defects.select(F.col("defectType").alias("pattern"), "fileId", F.explode_outer(box_list(F.col("box"))).alias("box")).filter("box is not null")


def pattern_counts(boxes: DataFrame) -> DataFrame:
    """(pattern, boxes), stored: a row a pattern, for those who need no more of the boxes than that."""
    return materialise(boxes.groupBy("pattern").agg(F.count(F.lit(1)).alias("boxes")))


def keep_frequent(boxes: DataFrame, least: int) -> DataFrame:
    few = boxes.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < least).select("pattern")
    return boxes.join(few, "pattern", "left_anti")


def class_ids(boxes: DataFrame) -> DataFrame:
    """(pattern, classId): patterns numbered in name order; as many rows as there are patterns."""
    names = boxes.agg(F.array_sort(F.collect_set("pattern")).alias("names"))
    return names.select(F.posexplode("names").alias("classId", "pattern"))


def detection_dataset(boxes: DataFrame, groups: DataFrame, *, least: int, fraction: float, seed: str = "") -> DataFrame:
    """Boxes of frequent patterns with train or val by whole groups. `groups`: fileId, group."""
    kept = keep_frequent(boxes, least)
    placed = kept.join(groups, "fileId", "left").withColumn("group", F.coalesce("group", F.lit("unknown")))
    return train_val_groups(placed, "group", fraction, seed=seed)


def box_pixels(side: int) -> Column:
    """Shorter side of a box in pixels after the image is scaled to `side`."""
    scale = F.lit(side) / F.greatest("w", "h")
    return F.least(
        (F.col("x1") - F.col("x0")) / 1000 * F.col("w") * scale, (F.col("y1") - F.col("y0")) / 1000 * F.col("h") * scale
    )


def pixel_report(boxes: DataFrame, sides: tuple[int, ...] = (640, 1280)) -> DataFrame:
    """Median, tenth percentile and share of tiny boxes at each input size. `boxes` carries w and h."""
    out = None
    for side in sides:
        px = boxes.filter("w > 0 and h > 0").select(box_pixels(side).alias("px"))
        shares = px.agg(
            F.lit(side).alias("side"), F.count(F.lit(1)).alias("boxes"),
            F.round(F.avg((F.col("px") < 8).cast("int")), 3).alias("lt8"), F.round(F.avg((F.col("px") < 16).cast("int")), 3).alias("lt16"),
        )
        ranks = quantiles(px, "px", {"median_px": 0.5, "p10_px": 0.1})
        one = shares.crossJoin(ranks).select("side", "boxes", *[F.round(c, 1).alias(c) for c in ("median_px", "p10_px")], "lt8", "lt16")  # one row each
        out = one if out is None else out.union(one)
    return out.filter("boxes > 0").withColumn("usable", F.col("lt16") < 0.05)
