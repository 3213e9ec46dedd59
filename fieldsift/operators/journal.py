"""How runs compare over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_history(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per run, oldest first, with the change in top-1 since the run before.

    Macro-F1 is recomputed from the class scores, over classes that were really tested. Runs are few,
    one per training.
    """
    real = F.col("support") > 0
    per = scores.groupBy("run").agg(
        F.round(F.avg(F.when(real, F.col("f1"))), 4).alias("macroF1"), F.count_if(real).alias("classes"), F.count_if(~real).alias("ghosts")
    )
    before = F.lag("top1").over(Window.orderBy("finished", "run"))
    return runs.select("run", "finished", "top1", "support").withColumn("delta", F.round(F.col("top1") - before, 4)).join(per, "run", "left")


def class_delta(current: DataFrame, previous: DataFrame, eps: float = 0.005) -> DataFrame:
    """Classes whose F1 changed, appeared or vanished between two runs; untested classes do not count."""
    real = lambda df, p: df.filter("support > 0").select("cls", F.col("f1").alias(f"{p}_f1"), F.col("support").alias(f"{p}_support"))
    both = real(current, "cur").join(real(previous, "prev"), "cls", "full")
    change = F.when(F.col("prev_f1").isNull(), "new").when(F.col("cur_f1").isNull(), "vanished").otherwise("changed")
    return (
        both.withColumn("change", change)
        .withColumn("delta", F.col("cur_f1") - F.col("prev_f1"))
        .filter((F.col("change") != "changed") | (F.abs("delta") >= eps))
        .withColumn("support_changed", F.coalesce(F.col("cur_support") != F.col("prev_support"), F.lit(False)))
    )


def weakest(scores: DataFrame, n: int = 6) -> DataFrame:
    return scores.filter("support > 0").orderBy("f1", "cls").limit(n)


def recurring_confusions(errors: DataFrame, least: int = 2) -> DataFrame:
    """Confusions seen in several runs, once per run. `errors`: run, true, pred."""
    return errors.groupBy("true", "pred").agg(F.count_distinct("run").alias("runs")).filter(F.col("runs") >= least)


def chronic_rows(errors: DataFrame, least: int = 3) -> DataFrame:
    """Rows wrong again and again, with their latest mistake. `errors`: run, finished, prefix, true, pred."""
    latest = F.max_by(F.struct("run", "true", "pred"), F.struct("finished", "run", "true", "pred"))
    per = errors.groupBy("prefix").agg(F.count(F.lit(1)).alias("times"), latest.alias("latest"))
    return per.filter(F.col("times") >= least).select("prefix", "times", "latest.run", "latest.true", "latest.pred")
