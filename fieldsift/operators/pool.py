"""Which photos count: source boundary, exclusions, id and date checks, file audit, list views."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift import fixed_values as V
from fieldsift.functions.rules import RuleSet
from fieldsift.functions.text import blank, strip, truthy
from fieldsift.scale import latest_by


def today_text(today: str | None = None) -> str:
    return today or dt.date.today().isoformat()


def work_items(df: DataFrame) -> DataFrame:
    """Only rows whose source is plainly a work item; without the column nothing may be classified."""
    if "source" not in df.columns:
        raise ValueError("the manifest has no source column; sync it again")
    keep = strip(blank("source")) == V.WORK_ITEM
    if "dataset" in df.columns:
        keep = keep & blank("dataset").isin(*V.WORK_DATASETS)
    return df.filter(keep)


def active_only(df: DataFrame) -> DataFrame:
    return df.filter(truthy(F.col("active"))) if "active" in df.columns else df


def drop_excluded(df: DataFrame, rules: RuleSet, today: str | None = None) -> DataFrame:
    """Leave out whole reports by date, author, status or site; dates compare as text."""
    if rules.drop_future and "reportDate" in df.columns:
        df = df.filter(F.coalesce("reportDate", F.lit("nan")) <= today_text(today))
    for column, values in (
        ("reportDate", rules.bad_dates),
        ("createdBy", rules.bad_authors),
        ("status", rules.bad_status),
        ("constrName", rules.bad_sites),
    ):
        if values and column in df.columns:
            df = df.filter(~blank(column).isin(*values))
    return df


def valid_pool(manifest: DataFrame, rules: RuleSet, *, order: str = "seq", today: str | None = None) -> DataFrame:
    """Active work-item photos with an id, the last row of each id by `order`."""
    kept = drop_excluded(active_only(work_items(manifest)), rules, today).filter(blank("fileId") != "")
    return latest_by(kept, ["fileId"], order)


def file_id_valid(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]{0,127}\z")


def photo_problems(wanted: DataFrame, pool: DataFrame) -> DataFrame:
    """Requested ids that are malformed or not in the pool."""
    ids = wanted.select("fileId").distinct()
    malformed = ids.filter(~file_id_valid(F.col("fileId"))).select("fileId", F.lit("malformed").alias("problem"))
    unknown = (
        ids.filter(file_id_valid(F.col("fileId")))
        .join(pool.select("fileId"), "fileId", "left_anti")
        .select("fileId", F.lit("not in pool").alias("problem"))
    )
    return malformed.unionByName(unknown)


def require_photos(wanted: DataFrame, pool: DataFrame) -> DataFrame:
    """Pool rows of the requested ids; any problem rejects the whole request."""
    bad = photo_problems(wanted, pool).limit(5).collect()
    if bad:
        raise ValueError(f"photos outside the pool: {[r['fileId'] for r in bad]}")
    return pool.join(wanted.select("fileId").distinct(), "fileId", "left_semi")


def class_name_problem(c: Column) -> Column:
    """Why a class name is refused, or null."""
    name = strip(F.coalesce(c, F.lit("")))
    parts = F.split(name, "-")
    return (
        F.when(
            (F.length(name) > 80) | (F.size(parts) != 2) | F.exists(parts, lambda p: strip(p) == ""),
            F.lit("needs two parts around one hyphen, at most 80 characters"),
        )
        .when(name.rlike(r"[\x00-\x1f]"), F.lit("control character"))
        .when(name.rlike(r'[/\\:*?"<>|]'), F.lit("reserved character"))
    )


def clean_capture(report_date: Column, synced_at: Column, clean_from: str) -> Column:
    """The report is new enough to come without overlays, and not dated after its sync."""
    return (report_date >= F.lit(clean_from)) & (report_date <= F.substring(synced_at, 1, 10))


def bad_date(c: Column, today: str) -> Column:
    """Why a report date cannot be trusted, or an empty string."""
    day = F.try_to_timestamp(F.substring(blank(c), 1, 10), F.lit("yyyy-M-d")).cast("date")
    return (
        F.when(day.isNull(), F.lit(V.REASON_BAD_DATE))
        .when(day > F.date_add(F.lit(today).cast("date"), 1), F.lit(V.REASON_FUTURE))
        .otherwise(F.lit(""))
    )


def size_problem(size: Column) -> Column:
    """Missing or too small a file to be a photo, or null."""
    return F.when(size.isNull(), F.lit("missing")).when(
        size < V.MIN_PHOTO_BYTES, F.concat(F.lit("too_small:"), size.cast("string"))
    )


def audit_files(manifest: DataFrame, raw: DataFrame, prepared: DataFrame, training: DataFrame) -> DataFrame:
    """Photos whose raw or prepared file is missing or unusable. File tables: (fileId, size).

    One good raw file is enough; the prepared file only matters when the raw one is fine.
    """
    per_photo = raw.groupBy("fileId").agg(
        F.min(size_problem(F.col("size")).isNotNull()).alias("all_bad"),
        F.collect_set(size_problem(F.col("size"))).alias("problems"),
    )
    ready = prepared.groupBy("fileId").agg(F.max("size").alias("prepared_size"))
    train = training.select("fileId").distinct().withColumn("trainingRelevant", F.lit(True))
    raw_problem = F.when(F.col("all_bad").isNull(), F.lit("missing")).when(
        F.col("all_bad"), F.array_join(F.array_sort("problems"), "|")
    ).otherwise(F.lit(""))
    out = (
        manifest.filter(blank("fileId") != "")
        .join(per_photo, "fileId", "left")
        .join(ready, "fileId", "left")
        .join(train, "fileId", "left")
        .withColumn("rawProblem", raw_problem)
        .withColumn(
            "preparedProblem",
            F.when(F.col("rawProblem") == "", F.coalesce(size_problem(F.col("prepared_size")), F.lit(""))).otherwise(F.lit("")),
        )
        .withColumn("trainingRelevant", F.coalesce("trainingRelevant", F.lit(False)))
    )
    return out.filter("rawProblem <> '' or preparedProblem <> ''").select(
        "fileId", "source", "active", "rawProblem", "preparedProblem", "trainingRelevant"
    )


def audit_summary(issues: DataFrame) -> DataFrame:
    """Issues by stage and problem, with how many touch the training set."""
    stages = F.array(
        F.struct(F.lit("raw").alias("stage"), F.col("rawProblem").alias("problem")),
        F.struct(F.lit("prepared").alias("stage"), F.col("preparedProblem").alias("problem")),
    )
    return (
        issues.select("trainingRelevant", F.inline(F.filter(stages, lambda s: s["problem"] != "")))
        .groupBy("stage", "problem")
        .agg(F.count(F.lit(1)).alias("photos"), F.count_if("trainingRelevant").alias("training"))
    )


def list_view(
    df: DataFrame,
    *,
    equals: dict[str, object] | None = None,
    search: str = "",
    reasons: Sequence[str] = (),
    page: int = 1,
    page_size: int | None = None,
) -> DataFrame:
    """Filtered, newest-first list: equal values, literal search in title or id, any of the reasons."""
    for column, value in (equals or {}).items():
        df = df.filter(F.col(column) == F.lit(value))
    if search:
        df = df.filter(F.contains(F.col("title"), F.lit(search)) | F.contains(F.col("fileId"), F.lit(search)))
    if reasons:
        df = df.filter(F.arrays_overlap(F.split("reason", V.REASON_SEPARATOR), F.array(*[F.lit(r) for r in reasons])))
    df = df.orderBy(F.col("reportDate").desc(), F.col("fileId").asc())
    return df if page_size is None else df.offset((page - 1) * page_size).limit(page_size)


def reason_counts(df: DataFrame) -> DataFrame:
    """Rows per single reason."""
    each = df.select(F.explode(F.split("reason", V.REASON_SEPARATOR)).alias("reason")).filter("reason <> ''")
    return each.groupBy("reason").agg(F.count(F.lit(1)).alias("photos"))
