"""De-identified pack: salted ids, site codes, judgement rows, and checks that fail loudly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift import fixed_values as V
from fieldsift.functions.rules import RuleSet
from fieldsift.functions.text import blank, clean, try_json
from fieldsift.scale import join_blank_safe, ordered_rank


def salted_id(identity: Column, salt: str) -> Column:
    """First 16 hexadecimal digits of the salted hash."""
    return F.substring(F.sha2(F.concat(F.lit(salt), F.lit(":"), identity), 256), 1, 16)


def site_buckets(manifest: DataFrame) -> DataFrame:
    """(constrId, siteBucket): sites numbered in name order.

    Works on the distinct sites only.
    """
    sites = manifest.select("constrId").distinct().filter(F.trim(blank("constrId")) != "")
    number = lambda n: F.concat(F.lit("site-"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")))
    return ordered_rank(sites, "constrId").select("constrId", number(F.col("rank")).alias("siteBucket"))


def taxonomy(rules: RuleSet, approved: DataFrame) -> DataFrame:
    """(cls): classes a pack may name."""
    ruled = approved.sparkSession.createDataFrame([(c,) for c in [*rules.labels(), rules.fallback]], "cls string")
    return ruled.unionByName(approved.select(F.col("label").alias("cls"))).filter("cls <> ''").distinct()


def judgements(
    human: DataFrame, boxes: DataFrame, manifest: DataFrame, rules: RuleSet, buckets: DataFrame, allowed: DataFrame, salt: str
) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped): human verdicts next to the rule's, and how many could not be told.

    `manifest`: fileId (unique), constrId, reportDate, title.
    """
    known = allowed.select("cls").withColumn("__ok", F.lit(True))
    rule_ok = allowed.select(F.col("cls").alias("rule"), F.lit(True).alias("__rule_ok"))
    place = manifest.select("fileId", "constrId", "reportDate", "title", F.lit(True).alias("__m"))
    boxed = boxes.select("fileId").distinct().withColumn("__b", F.lit(True))
    month = F.substring(blank("reportDate"), 1, 7)
    told = rules.with_class(human.join(place, "fileId", "left").withColumnRenamed("cls", "humanClass"), out="rule")
    # verdicts without a manifest row have no site, and untitled ones no rule; neither may meet in one partition
    df = (
        join_blank_safe(join_blank_safe(told, buckets, "constrId", "fileId"), rule_ok, "rule", "fileId")
        .join(known.withColumnRenamed("cls", "humanClass"), "humanClass", "left")
        .join(boxed, "fileId", "left")
    )
    skip = (
        F.when(F.col("__m").isNull(), F.lit("no manifest"))
        .when(F.col("__ok").isNull(), F.lit("orphan class"))
        .when(F.col("siteBucket").isNull() | ~month.rlike(V.CELL_PATTERNS["yearMonth"]), F.lit("no manifest"))
    )
    marked = df.withColumn("__skip", skip).withColumn("ruleClass", F.when(F.col("__rule_ok"), F.col("rule")).otherwise(F.lit("")))
    flag = lambda c: F.when(c, F.lit("1")).otherwise(F.lit("0"))
    rows = marked.filter("__skip is null").select(
        salted_id(F.col("fileId"), salt).alias("sampleId"), "siteBucket", month.alias("yearMonth"), "humanClass", "ruleClass",
        flag((F.col("ruleClass") != "") & (F.col("ruleClass") != F.col("humanClass"))).alias("humanOverrode"),
        flag(F.col("__b").isNotNull()).alias("hasBox"),
    )
    skipped = marked.filter("__skip is not null").groupBy(F.col("__skip").alias("why")).agg(F.count(F.lit(1)).alias("rows"))
    return rows, skipped


def override_breakdown(rows: DataFrame) -> DataFrame:
    said = F.col("ruleClass") != ""
    return rows.agg(
        F.count_if(~said).alias("ruleSilent"), F.count_if(said & (F.col("humanOverrode") == "0")).alias("agree"),
        F.count_if(F.col("humanOverrode") == "1").alias("overridden"),
    )


def defect_box_rows(defects: DataFrame, salt: str) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped): one row per box of a known pattern, and how many entries or boxes were refused."""
    allowed = [*V.DEFECT_PATTERNS, *V.DEFECT_BUTTON_ONLY]
    source = F.lower(clean(F.col("source")))
    df = (
        defects.withColumn("__box", clean(F.col("box"))).filter("__box <> ''")
        .withColumn("__v", F.try_parse_json("__box"))
        .withColumn("__list", try_json(F.col("__box"), "array<array<double>>"))
        .withColumn("__ok", F.col("__v").isNotNull() & clean(F.col("defectType")).isin(*allowed))
    )
    each = df.filter("__ok").select(
        salted_id(clean(F.col("fileId")), salt).alias("sampleId"), clean(F.col("defectType")).alias("defectPattern"),
        clean(F.col("qsCode")).alias("qsCode"), F.explode("__list").alias("b"),
        F.when(source.rlike(V.CELL_PATTERNS["token"]), source).otherwise(F.lit("")).alias("source"),
    ).withColumn("__four", F.size("b") == 4)
    text = F.concat(F.lit("["), F.array_join(F.transform("b", lambda v: v.cast("int").cast("string")), ", "), F.lit("]"))
    rows = each.filter("__four").select("sampleId", "defectPattern", "qsCode", text.alias("box"), "source")
    refused = df.filter("not __ok").agg(F.count(F.lit(1)).alias("n")).union(each.filter("not __four").agg(F.count(F.lit(1)).alias("n")))
    return rows, refused.agg(F.sum("n").alias("skippedBoxes"))


def criteria_rows(items: DataFrame) -> DataFrame:
    """Codes and flags of checklist items, never their text."""
    flag = lambda c: F.when(F.col(c), F.lit("1")).otherwise(F.lit("0"))
    return items.filter(F.col("itemKey").rlike(V.CELL_PATTERNS["qsCode"])).select(
        F.col("itemKey").alias("qsKey"), F.lower("kind").alias("kind"), F.lower("status").alias("status"),
        flag("billing").alias("isBilling"), flag("penalty").alias("isPenalty"), flag("contract").alias("isContract"),
    )


def valid_cell(value: Column, kind: str, allowed: dict[str, Sequence[str]]) -> Column:
    """Whether a cell may leave the house as this type. Types nobody declared are refused."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    if kind in V.CELL_PATTERNS:
        ok = text.rlike(V.CELL_PATTERNS[kind])
    elif kind in ("taxonomy", "defectPattern"):
        ok = text.isin(*allowed[kind])
    elif kind == "box1000":
        whole = r"\s*(?:1000|0|[1-9][0-9]{0,2})\s*"
        ok = text.rlike(rf"^\s*\[{whole}(?:,{whole}){{3}}\]\s*$")
    else:
        return F.when(text == "", F.lit(True)).otherwise(F.lit(False))
    return F.when(text == "", F.lit(kind not in V.CELL_REQUIRED)).otherwise(F.coalesce(ok, F.lit(False)))


def checked_cells(df: DataFrame, columns: dict[str, str], allowed: dict[str, Sequence[str]]) -> DataFrame:
    """One row `rows, bad`: how many rows there are, and (column, type, rows) of the cells that break their type; one pass."""
    each = [F.count_if(~valid_cell(F.col(c) if c in df.columns else F.lit(""), k, allowed)).alias(c) for c, k in columns.items()]
    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("type"), F.col(c).alias("rows")) for c, k in columns.items()])
    return df.agg(F.count(F.lit(1)).alias("__rows"), *each).select(F.col("__rows").alias("rows"), listed.alias("bad"))


def cell_violations(df: DataFrame, columns: dict[str, str], allowed: dict[str, Sequence[str]]) -> DataFrame:
    """(column, type, rows): cells that break their type, counted; values are never shown."""
    return checked_cells(df, columns, allowed).select(F.inline("bad")).filter("rows > 0")


def check_table(name: str, df: DataFrame, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """The table, once it is certain that every column and cell may leave; otherwise an error."""
    columns = V.PACK_TABLES[name]
    extra = sorted(set(df.columns) - set(columns))
    if extra:
        raise ValueError(f"{name}: columns that may not leave: {extra}")
    bad = cell_violations(df, columns, allowed).first()
    if bad:
        raise ValueError(f"{name}: {bad['rows']} cells of {bad['column']} are not of type {bad['type']}")
    return df
