"""Class per photo: rules, human overrides, exclusions, small classes, and what they leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift import fixed_values as V
from fieldsift.functions.rules import RuleSet
from fieldsift.functions.text import blank, first_match
from fieldsift.operators.pool import drop_excluded


def class_counts(df: DataFrame, by: str = "cls") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("photos"))


def resize_classes(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Drop classes below the minimum size, or fold them into the fallback.

    Only the class counts are shuffled; Spark broadcasts them back while they are small.
    """
    if not rules.min_class_size:
        return df
    small = class_counts(df).filter(F.col("photos") < rules.min_class_size).select("cls")
    if rules.small_class == "drop":
        return df.join(small, "cls", "left_anti").select(*df.columns)
    tagged = df.join(small.withColumn("__small", F.lit(True)), "cls", "left")
    return tagged.withColumn("cls", F.when(F.col("__small"), F.lit(rules.fallback)).otherwise(F.col("cls"))).select(*df.columns)


def apply_rules(
    df: DataFrame,
    rules: RuleSet,
    *,
    human: DataFrame | None = None,
    blocked: DataFrame | None = None,
    drop_small: bool = True,
    today: str | None = None,
) -> DataFrame:
    """Add `cls`. `human` (fileId, cls) overrides the rules before unlabelled rows go, so a person can
    bring back a photo whose title says nothing; `blocked` (fileId) is held out altogether."""
    out = rules.with_class(drop_excluded(df, rules, today))
    if human is not None:
        said = human.select("fileId", F.col("cls").alias("__said"))
        out = out.join(said, "fileId", "left").withColumn("cls", F.coalesce("__said", "cls")).drop("__said")
    if blocked is not None:
        out = out.join(blocked.select("fileId"), "fileId", "left_anti")
    out = out.filter(F.col("cls").isNotNull())
    if not drop_small:
        return out
    if rules.drop_fallback:
        out = out.filter(F.col("cls") != rules.fallback)
    return resize_classes(out, rules)


def unclaimed(df: DataFrame, rules: RuleSet, **kw) -> DataFrame:
    """Photos no rule claims."""
    return apply_rules(df, rules, drop_small=False, **kw).filter(F.col("cls") == rules.fallback)


def title_counts(df: DataFrame, top: int | None = None) -> DataFrame:
    """Photos per title; the `top` most frequent when asked for."""
    counts = df.groupBy("title").agg(F.count(F.lit(1)).alias("photos"))
    return counts if top is None else counts.orderBy(F.col("photos").desc(), F.col("title").asc()).limit(top)


def waiting_classes(df: DataFrame, rules: RuleSet, **kw) -> DataFrame:
    """Classes the rules know that have too few photos yet."""
    full = apply_rules(df, rules, drop_small=False, **kw).filter(F.col("cls") != rules.fallback)
    per = full.groupBy("cls").agg(F.count(F.lit(1)).alias("photos"), F.max("reportDate").alias("latest"))
    return per.filter(F.col("photos") < rules.min_class_size).select(
        "cls", "photos", (F.lit(rules.min_class_size) - F.col("photos")).alias("need"), "latest"
    )


def catalogue(rules: RuleSet, approved: DataFrame) -> DataFrame:
    """Classes of the rules with their patterns, then approved classes the rules do not have."""
    ruled = (
        rules.table(approved.sparkSession)
        .groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pattern"))), lambda x: x["pattern"]).alias("patterns"))
        .select("label", F.lit("labels.yaml").alias("origin"), "patterns")
    )
    extra = approved.join(F.broadcast(ruled), "label", "left_anti").select(  # one row per rule class
        "label", F.lit("human-approved").alias("origin"), F.array().cast("array<string>").alias("patterns")
    )
    return ruled.unionByName(extra)


def catalogue_version(catalog: DataFrame, rules: RuleSet) -> DataFrame:
    """One row: a digest that changes whenever a rule or a class does. The catalogue is class-sized."""
    body = F.to_json(F.array_sort(F.collect_list(F.struct("label", "origin", "patterns"))))
    text = "\n".join(f"{p}\t{label}" for p, label in rules.rules)
    return catalog.agg(F.sha2(F.concat(F.lit(f"{rules.version}\n{text}\n"), body), 256).alias("version"))


def orphan_verdicts(human: DataFrame, catalog: DataFrame, rules: RuleSet) -> DataFrame:
    """Human verdicts that name a class nobody defines any more."""
    valid = catalog.select(F.col("label").alias("cls"))
    return human.filter(F.col("cls") != rules.fallback).join(valid, "cls", "left_anti")


def human_references(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Two further human answers: the ticked labels put through the rules, and the chosen trade."""
    trades = F.create_map(*[F.lit(x) for pair in V.SPEC_TRADES.items() for x in pair])
    out = rules.with_class(df.withColumn("__chips", F.replace(blank("chipsOn"), F.lit("|"), F.lit(""))), "__chips", "clsChips")
    return out.withColumn("specTrade", F.try_element_at(trades, blank("specKey"))).drop("__chips")


def rule_calibration(pool: DataFrame, rules: RuleSet, human: DataFrame, blocked: DataFrame) -> DataFrame:
    """How often the bare rules agree with people, over reviewed photos that are not held back."""
    judged = rules.with_class(
        pool.join(human.select("fileId", F.col("cls").alias("final")), "fileId").join(
            blocked.select("fileId"), "fileId", "left_anti"
        ),
        out="rule",
    )
    hit = F.count_if(F.col("rule") == F.col("final"))
    return judged.agg(
        F.count(F.lit(1)).alias("reviewed"), hit.alias("ruleMatches"), F.try_divide(hit, F.count(F.lit(1))).alias("ruleAccuracy")
    )


def class_inventory(
    catalog: DataFrame, human: DataFrame, weak: DataFrame, effective: DataFrame, trained: list[str], minimum: int
) -> DataFrame:
    """Per class: confirmed by people, hit by rules, effective labels, shortfall, known to the model."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("cls").agg(F.count(F.lit(1)).alias(name)).withColumnRenamed("cls", "label")

    out = catalog.select("label", "origin")
    for df, name in ((human, "human"), (weak, "weak"), (effective, "effective")):
        out = out.join(counted(df, name), "label", "left")
    out = out.na.fill(0, ["human", "weak", "effective"])
    return out.withColumn("missing", F.greatest(F.lit(0), F.lit(minimum) - F.col("effective"))).withColumn(
        "trained", F.col("label").isin(*trained) if trained else F.lit(False)
    )


def defect_pattern(description: Column) -> Column:
    """Defect pattern named in a description, or null."""
    return first_match(F.coalesce(description, F.lit("")), V.DEFECT_KEYWORDS)


def defect_title(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(V.DEFECT_TITLE)


def title_stage(title: Column) -> Column:
    """The stage a title names when it names exactly one, else an empty string."""
    t = F.coalesce(title, F.lit(""))
    base, finish = F.contains(t, F.lit(V.STAGE_TITLE[0])), t.rlike(V.STAGE_TITLE[1])
    return (
        F.when(base & ~finish, F.lit(V.STAGE_CLASSES[0])).when(finish & ~base, F.lit(V.STAGE_CLASSES[1])).otherwise(F.lit(""))
    )
