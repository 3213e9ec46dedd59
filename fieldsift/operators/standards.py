"""Checklist standards and contract clauses: structure, what judges an item, cross-checks, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift import fixed_values as V
from fieldsift.functions.text import first_match, found
from fieldsift.scale import null_safe_join


def item_kind(name: Column) -> Column:
    return first_match(name, V.ITEM_KINDS, V.ITEM_KIND_DEFAULT)


def clause_kind(text: Column) -> Column:
    return first_match(text, V.CLAUSE_KINDS, V.CLAUSE_KIND_DEFAULT)


def has_number(text: Column) -> Column:
    return text.rlike(r"(?U)\d")


def numbers(text: Column) -> Column:
    """Numbers with a unit, as written."""
    return F.regexp_extract_all(text, F.lit(V.NUMBER_WITH_UNIT), F.lit(0))


def family(doc_no: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in V.DOC_FAMILIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.substring(doc_no, 1, 4)), F.lit(V.DOC_FAMILY_DEFAULT))


def describe_items(items: DataFrame) -> DataFrame:
    """Add itemKey, depth, kind and the three flags."""
    name = F.col("name")
    return (
        items.withColumn("itemKey", F.concat_ws("-", "docNo", "itemNo"))
        .withColumn("depth", F.size(F.split("itemNo", r"\.")))
        .withColumn("kind", item_kind(name))
        .withColumn("billing", found(name, V.BILLING))
        .withColumn("penalty", found(name, V.PENALTY))
        .withColumn("contract", found(name, V.CONTRACT))
    )


def flagged(items: DataFrame, flag: str) -> DataFrame:
    """Required items with the flag set."""
    return items.filter((F.col("status") == "R") & F.col(flag))


def orphan_items(items: DataFrame) -> DataFrame:
    """Required top-level items nothing hangs below: often a stage in all but form."""
    parents = items.filter("depth > 1").select(
        "docNo", F.regexp_replace("itemNo", r"\.[^.]*$", "").alias("itemNo")
    ).distinct()
    return items.filter("status = 'R' and depth = 1").join(parents, ["docNo", "itemNo"], "left_anti")


def document_shapes(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: required items, stages, and whether it comes in stages (A) or flat (C)."""
    stage = (F.col("status") == "O") & (F.col("depth") == 1)
    per = items.groupBy("docNo").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("status") == "R").alias("required"), F.count_if(stage).alias("stages")
    )
    return docs.select("docNo", F.col("name").alias("title")).join(per, "docNo", "left").na.fill(0, ["items", "required", "stages"]).withColumn(
        "shape", F.when(F.col("stages") > 0, F.lit("A")).otherwise(F.lit("C"))
    )


def stage_lists(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document the stages in order, the orphans, and whether stages have to be inferred.

    Lists are as long as one standard's own stages.
    """
    place = F.struct("file", "block", "pos")
    shown = F.replace(F.regexp_replace("name", "[:：]+$", ""), F.lit('"'), F.lit("'"))
    stages = items.filter("status = 'O' and depth = 1").groupBy("docNo").agg(
        F.array_sort(F.collect_list(F.struct(place.alias("p"), "itemNo", shown.alias("name")))).alias("s")
    )
    orphans = orphan_items(items).groupBy("docNo").agg(
        F.array_sort(F.collect_list(F.struct(place.alias("p"), "itemNo", F.replace("name", F.lit('"'), F.lit("'")).alias("name")))).alias("o")
    )
    named = lambda c: F.transform(c, lambda x, i: F.struct((i + 1).alias("seq"), x["itemNo"].alias("itemNo"), x["name"].alias("name")))
    out = docs.select("docNo", "name").join(stages, "docNo", "left").join(orphans, "docNo", "left")
    return out.select(
        "docNo", "name", F.col("s").isNull().alias("needs_inference"), named(F.col("s")).alias("stages"),
        F.when(F.col("s").isNotNull(), named(F.col("o"))).alias("orphans"),
    )


def kind_shares(items: DataFrame) -> DataFrame:
    """Required items per kind with their share. The total comes from the per-kind counts."""
    per = items.filter("status = 'R'").groupBy("kind").agg(F.count(F.lit(1)).alias("items"))
    total = per.agg(F.sum("items").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("kind", "items", F.round(F.col("items") / F.col("total"), 6).alias("share"))  # one row


#: What tells one contract from another; a trade of a project can have several.
CONTRACT = ["project", "trade", "vendor", "docDate"]


def clause_summary(clauses: DataFrame) -> DataFrame:
    """Clauses of each kind in each contract, and how many of them hold a number."""
    return clauses.groupBy(*CONTRACT, "kind").agg(F.count(F.lit(1)).alias("clauses"), F.count_if("has_number").alias("with_number"))


def describe_clauses(clauses: DataFrame) -> DataFrame:
    return clauses.withColumn("kind", clause_kind(F.col("text"))).withColumn("has_number", has_number(F.col("text")))


def conflict_candidates(items: DataFrame, clauses: DataFrame, trade_docs: DataFrame) -> DataFrame:
    """Where a standard and a contract of the same trade both give numbers on one topic.

    Each side is reduced to its (document, topic) counts before they meet, so no item is ever paired
    with every clause. Follow up with `conflict_evidence`.
    """

    def on_topic(df: DataFrame, text: str) -> DataFrame:
        rows = df.filter(F.col(text).rlike(V.NUMBER_WITH_UNIT))
        hit = F.array_compact(F.array(*[F.when(found(F.col(text), p), F.lit(t)) for t, p in V.CONFLICT_TOPICS]))
        return rows.withColumn("topic", F.explode(hit))

    left = on_topic(items.filter("status = 'R'"), "name").groupBy("docNo", "topic").agg(F.count(F.lit(1)).alias("items"))
    right = on_topic(clauses, "text").groupBy(*CONTRACT, "topic").agg(F.count(F.lit(1)).alias("clauses"))
    return right.join(trade_docs, "trade").join(left, ["docNo", "topic"]).select(*CONTRACT, "docNo", "topic", "items", "clauses")


def conflict_evidence(candidates: DataFrame, items: DataFrame, clauses: DataFrame) -> DataFrame:
    """The lines behind each candidate, one row per line with the side it comes from."""
    topics = candidates.sparkSession.createDataFrame(V.CONFLICT_TOPICS, "topic string, pattern string")
    want = candidates.join(F.broadcast(topics), "topic")  # six topics
    clear = lambda c: F.col(c).rlike(V.NUMBER_WITH_UNIT) & F.expr(f"{c} rlike pattern")
    a = items.filter("status = 'R'").join(want.select(*CONTRACT, "docNo", "topic", "pattern"), "docNo").filter(clear("name")).select(
        *CONTRACT, "docNo", "topic", F.lit("standard").alias("side"), F.col("itemKey").alias("key"), F.col("name").alias("line")
    )
    b = null_safe_join(clauses, want.select(*CONTRACT, "docNo", "topic", "pattern"), CONTRACT).filter(clear("text")).select(
        *CONTRACT, "docNo", "topic", F.lit("contract").alias("side"), F.col("clauseKey").alias("key"), F.col("text").alias("line")
    )
    return a.unionByName(b)


def answering_clauses(answers: DataFrame, clauses: DataFrame) -> DataFrame:
    """Clauses that answer an item, in the order of the mapping."""
    # clauses come with a place of their own
    return answers.select("itemKey", "pos", "clauseKey").join(clauses.select("clauseKey", "text"), "clauseKey").select("itemKey", "pos", "clauseKey", "text")


def interface_clauses(interfaces: DataFrame, clauses: DataFrame) -> DataFrame:
    said = clauses.select("clauseKey", "trade", "no", "text")
    return interfaces.select("name", "pos", "clauseKey", "note").join(said, "clauseKey").select("name", "pos", "clauseKey", "trade", "no", "text", "note")


def contract_gaps(items: DataFrame, answers: DataFrame, trade_docs: DataFrame) -> DataFrame:
    """Per document: items that lean on the contract, how many are mapped, and whether a contract is there."""
    mapped = answers.select("itemKey").distinct().withColumn("__m", F.lit(True))
    have = trade_docs.select("docNo").distinct().withColumn("__h", F.lit(True))
    per = flagged(items, "contract").join(mapped, "itemKey", "left").groupBy("docNo").agg(
        F.count(F.lit(1)).alias("dependent"), F.count("__m").alias("mapped")
    )
    return per.join(have, "docNo", "left").select(
        family(F.col("docNo")).alias("family"), "docNo", "dependent", "mapped", (F.col("dependent") - F.col("mapped")).alias("unmapped"),
        F.coalesce("__h", F.lit(False)).alias("has_contract"),
    )


def gap_ranking(gaps: DataFrame) -> DataFrame:
    """Families with unmapped items: those without a full set of contracts, and those only short of mappings."""
    per = gaps.groupBy("family").agg(
        F.sum("unmapped").alias("unmapped"), F.sum("dependent").alias("dependent"), F.every("has_contract").alias("has_contract")
    )
    return per.filter("unmapped > 0").withColumn("need", F.when(F.col("has_contract"), "mapping").otherwise("contract"))


def gap_table(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Every contract-dependent item with the clauses that answer it (a mapping's own short list)."""
    got = answers.groupBy("itemKey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "clauseKey"))), lambda x: x["clauseKey"]), "、").alias("clauses")
    )
    return flagged(items, "contract").join(got, "itemKey", "left").select("itemKey", "name", F.coalesce("clauses", F.lit("")).alias("clauses"))


def catalogue_alignment(catalog: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents listed, parsed or both, and whether their ids agree. `catalog`: docNo, id, name."""
    left = catalog.select("docNo", F.col("id").alias("listed_id"), F.col("name").alias("listed_name"))
    right = docs.select("docNo", F.col("isoInfoId").alias("parsed_id"))
    status = (
        F.when(F.col("listed_id").isNull(), "parsed only").when(F.col("parsed_id").isNull(), "listed only")
        .when(F.col("listed_id") != F.col("parsed_id"), "id differs").otherwise("same")
    )
    return left.join(right, "docNo", "full").withColumn("status", status)


def standards_index(catalog: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Catalogue with item and stage counts; documents missing from the catalogue show up too."""
    shapes = document_shapes(docs, items).select("docNo", "items", "required", "stages", "shape", F.col("title").alias("__t"))
    listed = catalog.select("docNo", F.col("name").alias("__n"), F.lit(True).alias("listed"))
    return listed.join(shapes, "docNo", "full").select(
        F.substring("docNo", 3, 2).alias("category"), "docNo", F.coalesce("__n", "__t").alias("name"),
        F.coalesce("required", F.lit(0)).alias("required"), F.coalesce("stages", F.lit(0)).alias("stages"),
        F.when(F.coalesce("items", F.lit(0)) > 0, F.col("shape")).otherwise(F.lit("—")).alias("shape"),
        F.when(F.col("listed").isNull(), "not in the catalogue").when(F.coalesce("items", F.lit(0)) > 0, "present").otherwise("no items").alias("raw"),
    )


def known_docs(items: DataFrame, docs: DataFrame) -> DataFrame:
    return items.join(docs.select("docNo").distinct(), "docNo", "left_semi")
