"""Who needs to look at which photo: buckets, reasons, queue, audit sample, workbench view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift import fixed_values as V
from fieldsift.functions.rules import RuleSet
from fieldsift.functions.text import blank
from fieldsift.operators.labelling import defect_title
from fieldsift.operators.pool import bad_date, today_text
from fieldsift.operators.splitting import audit_pick
from fieldsift.scale import join_blank_safe


def assemble_signals(oof: DataFrame, live: DataFrame) -> DataFrame:
    """Labelled photos keep their out-of-fold answer, all others the live model's."""
    cols = ["fileId", "modelClass", "modelConfidence", "stageSource"]
    seen = oof.select(*cols, F.lit("oof").alias("signal"))
    fresh = live.join(oof.select("fileId"), "fileId", "left_anti").select(*cols, F.lit("live").alias("signal"))
    return seen.unionByName(fresh)


def route(df: DataFrame, model_classes: Sequence[str], *, today: str | None = None) -> DataFrame:
    """Add bucket, reason and priority.

    Reads fileId, ruleClass, modelClass, modelConfidence, stageSource, reportDate, humanClass,
    reviewState, hasPhoto. Row-local: no shuffle.
    """
    rule, model = blank("ruleClass"), blank("modelClass")
    conf = F.coalesce(F.nanvl(F.col("modelConfidence").cast("double"), F.lit(0.0)), F.lit(0.0))
    ready = (
        df.withColumn("__bad", bad_date(F.col("reportDate"), today_text(today)))
        .withColumn("__photo", F.coalesce("hasPhoto", F.lit(False)))
        .withColumn(
            "__conflict", (rule != "") & rule.isin(*model_classes) & (rule != model) if model_classes else F.lit(False)
        )
    )
    why = F.array_compact(
        F.array(
            F.when(rule == "", F.lit(V.REASON_NO_RULE))
            .when(~rule.isin(*model_classes) if model_classes else F.lit(True), F.lit(V.REASON_UNTRAINED))
            .when(F.col("__conflict"), F.lit(V.REASON_CONFLICT)),
            F.when(F.col("stageSource") == "manual", F.lit(V.REASON_STAGE)),
            F.when(rule == V.DEFECT_CLASS, F.lit(V.REASON_DEFECT)),
            F.when((conf < V.AUTO_CONFIDENCE) & ~F.col("__conflict"), F.lit(V.REASON_LOW)),
        )
    )
    stuck = (
        F.when(~F.col("__photo"), F.lit(V.REASON_NO_PHOTO)).when(model == "", F.lit(V.REASON_NO_FEATURE)).otherwise(F.col("__bad"))
    )
    ready = ready.withColumn("__why", why).withColumn(
        "bucket",
        F.when(blank("humanClass") != "", F.lit("done"))
        .when(blank("reviewState").isin(*V.HELD_STATES), F.lit("held"))
        .when(stuck != "", F.lit("quarantine"))
        .when(F.size("__why") > 0, F.lit("queue"))
        .when(audit_pick(F.col("fileId")), F.lit("audit"))
        .otherwise(F.lit("auto")),
    )
    reasons = (
        F.when(F.col("bucket") == "quarantine", F.array(stuck))
        .when(F.col("bucket") == "queue", F.col("__why"))
        .when(F.col("bucket") == "audit", F.array(F.lit(V.REASON_AUDIT)))
        .otherwise(F.array().cast("array<string>"))
    )
    places = F.transform(
        F.filter(reasons, lambda w: w.isin(*V.REASONS)),
        lambda w: F.array_position(F.array(*[F.lit(r) for r in V.REASONS]), w) - 1,
    )
    return (
        ready.withColumn("reason", F.array_join(reasons, V.REASON_SEPARATOR))
        .withColumn("priority", F.coalesce(F.array_min(places), F.lit(len(V.REASONS))).cast("int"))
        .drop("__bad", "__photo", "__conflict", "__why")
    )


def build_routing(
    pool: DataFrame, rules: RuleSet, signals: DataFrame, human: DataFrame, decisions: DataFrame, photos: DataFrame,
    model_classes: Sequence[str], *, today: str | None = None,
) -> DataFrame:
    """Bring all signals to the pool and route. `photos`: fileId of photos whose file is there."""
    ruled = rules.with_class(pool, out="ruleClass").withColumn(
        "ruleClass", F.when(F.col("ruleClass") == rules.fallback, F.lit("")).otherwise(blank("ruleClass"))
    )
    df = (
        ruled.join(signals, "fileId", "left")
        .join(human.select("fileId", F.col("cls").alias("humanClass")), "fileId", "left")
        .join(decisions.select("fileId", F.col("action").alias("reviewState")), "fileId", "left")
        .join(photos.select("fileId").distinct().withColumn("hasPhoto", F.lit(True)), "fileId", "left")
    )
    filled = df.na.fill("", ["modelClass", "stageSource", "signal", "humanClass", "reviewState"]).na.fill({"hasPhoto": False})
    return route(filled, model_classes, today=today)


def bucket_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("bucket").agg(F.count(F.lit(1)).alias("photos"))


def signal_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("signal").agg(F.count(F.lit(1)).alias("photos"))


def open_reasons(routed: DataFrame) -> DataFrame:
    """How many open photos carry each reason."""
    each = routed.filter(F.col("bucket").isin("queue", "audit", "quarantine")).select(
        F.explode(F.split("reason", V.REASON_SEPARATOR)).alias("reason")
    )
    return each.filter("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("photos"))


def queue_items(routed: DataFrame, human: DataFrame, held: DataFrame) -> DataFrame:
    """Open items nobody has dealt with since; order by priority, newest report first."""
    return (
        routed.filter(F.col("bucket").isin("queue", "audit"))
        .join(human.select("fileId"), "fileId", "left_anti")
        .join(held.select("fileId"), "fileId", "left_anti")
    )


def in_queue_order(queue: DataFrame) -> DataFrame:
    return queue.orderBy(F.col("priority").asc(), F.col("reportDate").desc(), F.col("fileId").asc())


def blind_audit(queue: DataFrame, neutral: str = "") -> DataFrame:
    """What reviewers see: audit rows do not say that they are audit rows."""
    return queue.withColumn("reason", F.when(F.col("bucket") == "audit", F.lit(neutral)).otherwise(F.col("reason")))


def first_audits(routed: DataFrame, recorded: DataFrame, model: str, sampled_at: str) -> DataFrame:
    """Audit photos not recorded before, with the answer the automatic bucket would have given."""
    fresh = routed.filter(F.col("bucket") == "audit").join(recorded.select("fileId"), "fileId", "left_anti")
    return fresh.select(
        "fileId", F.col("ruleClass").alias("autoClass"), F.bround("modelConfidence", 4).alias("modelConfidence"),
        F.lit(model).alias("model"), F.lit(sampled_at).alias("sampledAt"),
    )


def audit_precision(recorded: DataFrame, human: DataFrame) -> DataFrame:
    """Sampled, reviewed, agreeing, and the share that agrees."""
    both = recorded.join(human.select("fileId", "cls"), "fileId", "left")
    reviewed, agree = F.count("cls"), F.count_if(F.col("cls") == F.col("autoClass"))
    return both.agg(
        F.count(F.lit(1)).alias("sampled"), reviewed.alias("reviewed"), agree.alias("agree"),
        F.round(F.try_divide(agree, reviewed), 4).alias("precision"),
    )


def training_debt(reviews: DataFrame, routed: DataFrame, trained_at: str, now: str) -> DataFrame:
    """What has piled up since the model was trained, and whether to train again."""
    trained, at = F.lit(trained_at).cast("timestamp"), F.lit(now).cast("timestamp")
    new = reviews.agg(F.count_if(F.try_to_timestamp("reviewedAt") > trained).alias("newReviews"))
    live = routed.agg(F.count_if(F.col("signal") == "live").alias("newPhotos"))
    days = (F.unix_timestamp(at) - F.unix_timestamp(trained)) / 86400
    due = F.when(F.col("newReviews") >= V.RETRAIN_NEW_REVIEWS, F.lit("reviews")).when(
        (F.col("daysSince") >= V.RETRAIN_DAYS) & (F.col("newPhotos") >= V.RETRAIN_NEW_PHOTOS), F.lit("age and photos")
    )
    out = new.crossJoin(F.broadcast(live)).withColumn("daysSince", F.round(days, 1))  # one row each
    return out.withColumn("because", F.coalesce(due, F.lit(""))).withColumn("retrain", F.col("because") != "")


def workbench(
    pool: DataFrame, rules: RuleSet, catalog: DataFrame, human: DataFrame, decisions: DataFrame, scores: DataFrame, split: DataFrame,
    queue: DataFrame, marks: DataFrame, trained: Sequence[str], *, defect_threshold: float | None = None,
) -> DataFrame:
    """One row per photo with everything the workbench shows.

    `scores`: fileId, modelClass, modelConfidence, modelMargin, stageSource, defectScore.
    `split`: fileId, part. `queue`: fileId, reason. `marks`: fileId, defect.
    """
    known = catalog.select(F.col("label").alias("humanClass"), F.lit(True).alias("__known"))
    parts = split.groupBy("fileId").agg(F.max(F.col("part") == "test").alias("__test"))
    df = (
        rules.with_class(pool, out="ruleClass")
        .join(human.select("fileId", F.col("cls").alias("humanClass")), "fileId", "left")
        .join(decisions.select("fileId", F.col("action").alias("__action")), "fileId", "left")
        .join(scores, "fileId", "left")
        .join(parts, "fileId", "left")
        .join(queue.select("fileId", F.col("reason").alias("__queued")), "fileId", "left")
        .join(marks.select("fileId", F.col("defect").alias("__mark")), "fileId", "left")
    )
    # nearly all photos have no human class; they must not meet in one partition
    df = (
        join_blank_safe(df, known, "humanClass", "fileId")
        .withColumn("ruleClass", F.when(F.col("ruleClass") == rules.fallback, F.lit("")).otherwise(blank("ruleClass")))
        .withColumn("humanClass", blank("humanClass"))
    )
    label = F.when(F.col("humanClass") != "", F.col("humanClass")).otherwise(F.col("ruleClass"))
    reviewed = F.col("humanClass") != ""
    image = F.coalesce(F.col("defectScore") >= F.lit(defect_threshold), F.lit(False)) if defect_threshold is not None else F.lit(False)
    source: Column = (
        F.when(F.col("__mark").isNotNull(), F.lit("human"))
        .when(defect_title(F.col("title")), F.lit("title"))
        .when(image, F.lit("image"))
        .otherwise(F.lit(""))
    )
    out = (
        df.withColumn("reviewState", F.coalesce("__action", F.when(reviewed, F.lit("classified")).otherwise(F.lit("pending"))))
        .withColumn(
            "route",
            F.when(reviewed & F.col("__known").isNull(), F.lit("invalid"))
            .when(label == "", F.lit("unknown"))
            .when(~label.isin(*trained) if trained else F.lit(True), F.lit("known_untrained"))
            .otherwise(F.lit("known")),
        )
        .withColumn("part", F.when(F.col("__test"), F.lit("test")).when(~F.col("__test"), F.lit("train")).otherwise(F.lit("unseen")))
        .withColumn("defectSource", source)
        .withColumn("defectFlag", F.when(F.col("defectSource") == "human", F.col("__mark")).otherwise(F.col("defectSource") != ""))
    )
    notes = F.array_compact(
        F.array(
            F.when(F.col("reviewState") == "pending", F.col("__queued")),
            F.when(F.col("route") == "invalid", F.lit(V.ROUTES["invalid"])),
        )
    )
    return out.withColumn("reviewReason", F.array_join(notes, V.REASON_SEPARATOR)).withColumn("needsReview", F.size(notes) > 0).select(
        *pool.columns, "ruleClass", "humanClass", blank("modelClass").alias("modelClass"), blank("stageSource").alias("stageDecision"),
        "modelConfidence", "modelMargin", "defectScore", "defectFlag", "defectSource", "part", "route", "reviewState", "reviewReason", "needsReview",
    )
