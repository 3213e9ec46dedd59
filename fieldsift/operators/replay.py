"""Current state out of append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift import fixed_values as V
from fieldsift.functions.boxes import box_list
from fieldsift.functions.text import blank, strip, try_json
from fieldsift.scale import latest_by


def last_verdicts(reviews: DataFrame, order: str = "seq") -> DataFrame:
    """Latest class per photo; a blank class says nothing and undoes nothing."""
    said = reviews.withColumn("cls", strip(F.col("cls"))).filter(blank("cls") != "")
    return said.groupBy("fileId").agg(F.max_by("cls", order).alias("cls"))


def last_boxes(reviews: DataFrame, order: str = "seq") -> DataFrame:
    """Latest boxes per photo. A blank entry clears them; broken or empty JSON changes nothing."""
    entries = try_json(F.col("box"), "array<string>")
    state = F.when(strip(blank("box")) == "", F.lit("clear")).when(F.size(entries) > 0, F.lit("set"))
    moves = reviews.select("fileId", F.col(order).alias("__o"), state.alias("__s"), box_list(F.col("box")).alias("boxes")).filter("__s is not null")
    top = moves.groupBy("fileId").agg(F.max_by(F.struct("__s", "boxes"), "__o").alias("m"))
    return top.filter("m.__s = 'set' and size(m.boxes) > 0").select("fileId", "m.boxes")


def latest_events(log: DataFrame) -> DataFrame:
    """The newest event of every (kind, entity)."""
    return latest_by(log, ["kind", "entity"], "seq")


def active_decisions(decisions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Latest decision per photo, as long as no review row came after the one it was taken on.

    `decisions`: fileId, seq, reviewSeq (null when there was no review), action and more.
    `reviews`: fileId, seq.
    """
    newest = latest_by(decisions, ["fileId"], "seq")
    seen = reviews.groupBy("fileId").agg(F.max("seq").alias("__last"))
    return newest.join(seen, "fileId", "left").filter(F.col("reviewSeq").eqNullSafe(F.col("__last"))).drop("__last")


def blocked_ids(active: DataFrame) -> DataFrame:
    """Photos held back by an active decision."""
    return active.filter(F.col("action").isin(*V.HELD_STATES)).select("fileId")


def suggestions_now(suggestions: DataFrame, context: DataFrame, version: str) -> DataFrame:
    """Latest suggestion per photo and whether its catalogue and context are still the current ones.

    `suggestions`: fileId, seq, catalogVersion, contextHash. `context`: fileId, contextHash.
    """
    newest = latest_by(suggestions, ["fileId"], "seq")
    now = context.select("fileId", F.col("contextHash").alias("__now"))
    fresh = (F.col("catalogVersion") == version) & F.coalesce(F.col("contextHash") == F.col("__now"), F.lit(False))
    return newest.join(now, "fileId", "left").withColumn("current", fresh).drop("__now")
