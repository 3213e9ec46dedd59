"""The given tables in the roles that the operators expect; every table is read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsift.functions.rules import RuleSet

TODAY = "2024-12-31"

#: Words that tell the languages of the given documents apart, as ordered rules over the first line.
LANGUAGE_RULES = RuleSet(
    rules=[
        (" und | der | die |Der |Die ", "german"),
        (" the | of | and |The |Of ", "english"),
        (" les | des | le |Le |Les ", "french"),
        (" el | del | y |El |Del ", "spanish"),
    ],
    fallback="other",
    junk=["The.", "Le."],
    min_title=8,
    min_class_size=60,
    small_class="drop",
    drop_fallback=True,
    bad_sites=["src3"],
)

LANGUAGES = {"de": "german", "en": "english", "fr": "french", "es": "spanish"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as photos: first line as title, source as site, a report day from the length."""
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 365).cast("int"))
    return d.select(
        F.col("doc_id").cast("string").alias("fileId"),
        F.split("text", "\n")[0].alias("title"),
        day.cast("string").alias("reportDate"),
        F.col("source").alias("constrId"),
        F.col("source").alias("constrName"),
        F.lit("WORK_ITEM").alias("source"),
        F.when(F.col("n_chars") >= 100, F.lit("true")).otherwise(F.lit("false")).alias("active"),
        F.lit("pms").alias("dataset"),
        F.col("doc_id").alias("seq"),
        "lang",
        "n_chars",
    )


def language_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true language as a person's verdict, for the labelled documents."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    known = table(spark, sf_dir, "labels").select("doc_id")
    docs = table(spark, sf_dir, "documents").join(known, "doc_id", "left_semi")
    return docs.select(F.col("doc_id").cast("string").alias("fileId"), names[F.col("lang")].alias("cls"))


def event_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as an append-only review log: low values leave the class blank, errors clear a box."""
    e = table(spark, sf_dir, "events")
    v = F.floor("value").cast("int")
    box = F.format_string("[[%d, %d, %d, %d], \"x\"]", v, v, v + 100, v + 50)
    return e.select(
        F.col("user_id").cast("string").alias("fileId"),
        F.col("event_id").alias("seq"),
        F.when(F.col("value") >= 10, F.concat(F.lit(" "), F.col("event_type"))).otherwise(F.lit(" ")).alias("cls"),
        F.when(F.col("event_type") == "error", F.lit("")).when(F.col("event_type") == "click", F.lit("{")).otherwise(box).alias("box"),
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as classified photos: the return flag is true, the line status and quantity give the answer."""
    li = table(spark, sf_dir, "lineitem")
    guess = F.when(F.col("l_linestatus") == "O", F.lit("N")).when(F.col("l_quantity") > 25, F.lit("A")).otherwise(F.lit("R"))
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("fileId"),
        F.col("l_returnflag").alias("true"),
        guess.alias("pred"),
        (F.col("l_tax") * 10).alias("conf"),
        F.year("l_shipdate").cast("string").alias("run"),
        F.col("l_orderkey").cast("string").alias("itemKey"),
        F.col("l_discount").alias("d"),
    )


def site_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as photos of customers' sites by day, the priority as class."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("fileId"),
        F.col("o_custkey").cast("string").alias("constrId"),
        F.to_date("o_orderdate").cast("string").alias("reportDate"),
        F.col("o_orderpriority").alias("cls"),
    )
