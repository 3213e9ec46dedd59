"""Upserts, work lists, de-duplicated appends, and all-or-nothing checks of incoming batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift import fixed_values as V
from fieldsift.functions.text import blank
from fieldsift.operators.pool import class_name_problem

#: Shares in which the rows of one label meet the catalogue.
SPREAD = 64


def merge_manifest(old: DataFrame, new: DataFrame, *, partial: bool, api_host: str = "") -> DataFrame:
    """New rows win. After a full sync, rows of the same host that were not seen again go inactive."""
    kept = old.join(new.select("fileId"), "fileId", "left_anti").select(*old.columns)
    if not partial:
        host = F.coalesce("apiHost", F.lit(V.UNKNOWN_HOST)) if "apiHost" in old.columns else F.lit(V.UNKNOWN_HOST)
        same = host == (api_host or V.UNKNOWN_HOST)
        kept = kept.withColumn("active", F.when(same, F.lit("false")).otherwise(F.col("active")))
    return new.unionByName(kept, allowMissingColumns=True)


def upsert(old: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fresh rows replace old rows with the same key; no fresh rows, no change."""
    return fresh.unionByName(old.join(fresh.select(*keys), list(keys), "left_anti").select(*old.columns), allowMissingColumns=True)


def reports_to_fetch(listed: DataFrame, index: DataFrame, cached: DataFrame) -> DataFrame:
    """Listed reports that changed since the last sync or were never stored.

    A report stays as it is only when it is stored, was and is submitted, and has the same version.
    """
    before = index.select("dailyReportInfoId", F.col("status").alias("__s"), F.col("version").cast("string").alias("__v"))
    have = cached.select("dailyReportInfoId").distinct().withColumn("__c", F.lit(True))
    same = (
        F.coalesce("__c", F.lit(False))
        & F.col("__s").eqNullSafe("SUBMITTED")
        & F.col("status").eqNullSafe("SUBMITTED")
        & F.col("__v").eqNullSafe(F.col("version").cast("string"))
    )
    return (
        listed.join(before, "dailyReportInfoId", "left").join(have, "dailyReportInfoId", "left").filter(~same).select(*listed.columns)
    )


def missing_artefacts(wanted: DataFrame, have: DataFrame, key: str = "fileId") -> DataFrame:
    return wanted.join(have.select(key), key, "left_anti")


def living_artefacts(have: DataFrame, wanted: DataFrame, key: str = "fileId") -> DataFrame:
    """Artefacts whose origin still exists."""
    return have.join(wanted.select(key), key, "left_semi")


DEFECT_KEYS = ("fileId", "source", "defectType", "box")


def new_defects(batch: DataFrame, stored: DataFrame, order: str = "pos", keys: Sequence[str] = DEFECT_KEYS) -> DataFrame:
    """Rows to append: not stored yet, and the first of their kind inside the batch."""
    blanks = [blank(k).alias(k) for k in keys]
    rest = [c for c in batch.columns if c not in keys]
    first = (
        batch.select(*blanks, *rest).groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r"))
        .select(*keys, *[F.col("__r")[c].alias(c) for c in rest])
    )
    return first.join(stored.select(*blanks), list(keys), "left_anti").select(*batch.columns)


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys missing on one side or repeated on the right."""
    l = left.groupBy(key).agg(F.count(F.lit(1)).alias("l"))
    r = right.groupBy(key).agg(F.count(F.lit(1)).alias("r"))
    both = l.join(r, key, "full").select(key, F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r"))
    problem = F.when(F.col("r") == 0, "missing").when(F.col("l") == 0, "unexpected").when(F.col("r") > 1, "repeated")
    return both.withColumn("problem", problem).filter("problem is not null").select(key, "problem")


def response_problems(results: DataFrame, packet: DataFrame, pool: DataFrame, catalog: DataFrame, version: str) -> DataFrame:
    """Everything wrong with an answered packet, one row per fault; any row rejects the batch.

    `results`: fileId, imageHash, decision, label, candidateDefinition, visualEvidence, reason,
    alternatives array<string>, titleEvidence, titleRelation, catalogVersion, model.
    `packet`: fileId, imageHash, contextHash. `pool`: fileId, imageHash, contextHash as of now.
    `catalog`: label.
    """
    # rows of one label are many: they meet the catalogue in SPREAD shares, by file
    shares = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("__s")
    known = catalog.select(F.col("label"), F.lit(True).alias("__known")).distinct().select("*", shares)
    share = F.pmod(F.xxhash64("fileId"), F.lit(SPREAD).cast("long")).alias("__s")
    item = packet.select("fileId", F.col("imageHash").alias("__pi"), F.col("contextHash").alias("__pc"))
    now = pool.select("fileId", F.col("imageHash").alias("__ni"), F.col("contextHash").alias("__nc"), F.lit(True).alias("__in"))
    strange = (
        results.select("fileId", share, F.explode("alternatives").alias("label"))
        .join(known, ["label", "__s"], "left_anti").select("fileId").distinct().withColumn("__strange", F.lit(True))
    )
    placed = results.join(item, "fileId", "left").join(now, "fileId", "left").join(strange, "fileId", "left")
    row = placed.select("*", share).join(known, ["label", "__s"], "left")
    is_known = F.coalesce("__known", F.lit(False)) & (blank("label") != "")
    empty = lambda c: F.trim(blank(c)) == ""
    decision = F.col("decision")
    checks: list[tuple[str, Column]] = [
        ("catalogue version", ~F.col("catalogVersion").eqNullSafe(version)),
        ("model missing", empty("model")),
        ("not in pool", F.col("__in").isNull()),
        ("image differs", ~F.col("imageHash").eqNullSafe(F.col("__pi"))),
        ("context changed", ~F.col("__pc").eqNullSafe(F.col("__nc"))),
        ("image changed", ~F.col("__pi").eqNullSafe(F.col("__ni"))),
        ("decision", ~blank("decision").isin("existing", "new_candidate", "uncertain", "not_construction")),
        ("unknown class", (decision == "existing") & ~is_known),
        ("class name", (decision == "new_candidate") & class_name_problem(F.col("label")).isNotNull()),
        ("class exists", (decision == "new_candidate") & is_known),
        ("definition missing", (decision == "new_candidate") & empty("candidateDefinition")),
        ("label not blank", decision.isin("uncertain", "not_construction") & (blank("label") != "")),
        ("evidence missing", empty("visualEvidence") | empty("reason")),
        ("alternatives", (F.size("alternatives") > 3) | F.col("__strange").isNotNull()),
        (
            "title fields",
            (F.col("titleEvidence").isNotNull() | F.col("titleRelation").isNotNull())
            & (empty("titleEvidence") | ~blank("titleRelation").isin("agrees", "conflicts", "insufficient_context")),
        ),
    ]
    faults = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))
    per_row = row.select("fileId", F.explode(faults).alias("problem"))
    return per_row.unionByName(set_differences(packet, results, "fileId"))


def proposal_ids(results: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Content hash of each proposal over `fields`, in name order."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(fields)]), {"ignoreNullFields": "false"})
    return results.withColumn("proposalId", F.sha2(body, 256))


def new_proposals(results: DataFrame, stored: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Proposals that are not stored yet; repeating an import adds nothing."""
    return proposal_ids(results, fields).dropDuplicates(["proposalId"]).join(stored.select("proposalId"), "proposalId", "left_anti")


ANSWER_FIELDS = (
    "decision", "label", "visualEvidence", "titleEvidence", "titleRelation", "reason", "alternatives", "candidateDefinition",
)


def answer_problem(text: Column) -> Column:
    """Why a JSON answer is refused: not an object, other keys than agreed, wrong types or values; else null."""
    body = F.try_parse_json(text)
    keys = F.json_object_keys(F.when(body.isNotNull(), text))
    kind = lambda f: F.schema_of_variant(F.try_variant_get(body, f"$.{f}", "variant"))
    strings = [f for f in ANSWER_FIELDS if f != "alternatives"]
    value = lambda f: F.try_variant_get(body, f"$.{f}", "string")
    wrong_type = F.lit(False)
    for f in strings:
        wrong_type = wrong_type | (kind(f) != "STRING")
    return (
        F.when(body.isNull() | keys.isNull(), F.lit("not a JSON object"))
        .when(F.array_sort(keys) != F.array(*[F.lit(f) for f in sorted(ANSWER_FIELDS)]), F.lit("keys"))
        .when(wrong_type, F.lit("type"))
        .when(~value("decision").isin("existing", "new_candidate", "uncertain", "not_construction"), F.lit("decision"))
        .when(~value("titleRelation").isin("agrees", "conflicts", "insufficient_context"), F.lit("titleRelation"))
    )
