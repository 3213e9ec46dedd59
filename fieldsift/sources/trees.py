"""Small dimension sources: the work-type tree, checklists, mapping files, run reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LEAF = "struct<name:string>"
_MIDDLE = f"struct<name:string,children:array<{_LEAF}>>"
TREE_SCHEMA = f"name string, children array<{_MIDDLE}>"


def node_name(name: Column) -> Column:
    """A name is plain text or an object keyed by language."""
    return F.trim(F.coalesce(F.get_json_object(name, "$['zh-TW']"), name))


def flatten_tree(tree: DataFrame) -> DataFrame:
    """(l1, l2, l3): a middle node without children stands on its own with a null l3."""
    middle = tree.select(node_name(F.col("name")).alias("l1"), F.explode("children").alias("m"))
    return middle.select("l1", node_name(F.col("m.name")).alias("l2"), F.explode_outer("m.children").alias("c")).select(
        "l1", "l2", node_name(F.col("c.name")).alias("l3")
    )


def search_tree(flat: DataFrame, keyword: str) -> DataFrame:
    return flat.filter(F.contains(F.coalesce("l3", "l2"), F.lit(keyword)))


def checklist_rows(checklist: DataFrame) -> DataFrame:
    """(itemNo, status O|R, name) from entries with OPTIONAL/REQUIRED; other entries are left out."""
    status = F.when(F.col("status") == "OPTIONAL", "O").when(F.col("status") == "REQUIRED", "R")
    return checklist.select(F.col("docNo").alias("itemNo"), status.alias("status"), F.coalesce("name", F.lit("")).alias("name")).filter(
        (F.coalesce("itemNo", F.lit("")) != "") & F.col("status").isNotNull()
    )


def load_mappings(spark: SparkSession, source: str | Mapping | None) -> dict[str, DataFrame]:
    """answers (itemKey, pos, clauseKey), trade_docs (trade, docNo), interfaces (name, pos, clauseKey, note)."""
    cfg: Mapping = {}
    if isinstance(source, Mapping):
        cfg = source
    elif source:
        import os

        import yaml

        if os.path.exists(source):
            with open(source, encoding="utf-8") as fh:
                cfg = yaml.safe_load(fh) or {}
    answers = [(k, i, c) for k, cs in (cfg.get("QS_ANSWERS") or {}).items() for i, c in enumerate(cs)]
    trades = [(t, d) for t, ds in (cfg.get("TRADE_TO_QS") or {}).items() for d in ds]
    faces = [
        (f["name"], i, c, f.get("note", "")) for f in cfg.get("INTERFACES") or [] for i, c in enumerate(f.get("clauses") or [])
    ]
    return {
        "answers": spark.createDataFrame(answers, "itemKey string, pos int, clauseKey string"),
        "trade_docs": spark.createDataFrame(trades, "trade string, docNo string"),
        "interfaces": spark.createDataFrame(faces, "name string, pos int, clauseKey string, note string"),
    }


METRICS_SCHEMA = (
    "mode string, top1 string, support long, macroF1 double, "
    "perClass map<string,struct<precision:double,recall:double,`f1-score`:double,support:double>>"
)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per finished run under `root`; side-by-side comparisons are not runs."""
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    metrics = spark.read.schema(METRICS_SCHEMA).json(f"{root}/*/metrics.json", multiLine=True).select(
        run.alias("run"), F.col("_metadata.file_modification_time").alias("finished"), "*"
    )
    config = spark.read.schema("split string, labelsVersion string").json(f"{root}/*/config.json", multiLine=True).select(
        run.alias("run"), "*"
    )
    return (
        metrics.filter(~F.col("mode").eqNullSafe("ab"))
        .join(config, "run", "left")
        .select(
            "run", "finished", F.coalesce("split", F.lit("?")).alias("split"),
            F.coalesce("labelsVersion", F.lit("?")).alias("labelsVersion"),
            F.col("top1").try_cast("double").alias("top1"), F.col("macroF1").alias("storedMacroF1"), "support", "perClass",
        )
    )


def class_scores(runs: DataFrame) -> DataFrame:
    """Long form of the per-class scores."""
    return runs.select("run", "finished", F.explode("perClass").alias("cls", "s")).select(
        "run", "finished", "cls", F.col("s.precision").alias("precision"), F.col("s.recall").alias("recall"),
        F.col("s.f1-score").alias("f1"), F.col("s.support").alias("support"),
    )


def error_name(name: Column) -> dict[str, Column]:
    """Parts of an error picture's file name: true class, predicted class, id prefix."""
    pattern = r"^真(.+?)_猜(.+?)_(.{8})\.jpg$"
    part = lambda i: F.when(name.rlike(pattern), F.regexp_extract(name, pattern, i))
    return {"true": part(1), "pred": part(2), "prefix": part(3)}
