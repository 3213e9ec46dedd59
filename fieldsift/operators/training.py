"""Balanced linear probe, grouped out-of-fold prediction, choice of C, defect ranking."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift import fixed_values as V
from fieldsift.operators.evaluation import average_precision, roc_auc
from fieldsift.operators.scoring import pool_siblings
from fieldsift.operators.splitting import group_folds, stratified_group_folds
from fieldsift.scale import materialise, null_safe_join, running_totals


def fit_probe(train: DataFrame, counts: dict[str, int], *, C: float = V.PROBE_C, label: str = "cls", emb: str = "emb", iterations: int = 2000) -> tuple[LogisticRegressionModel, list[str]]:
    """Multinomial logistic regression with balanced class weights; C is the inverse penalty per row.

    `counts` are the training rows per class. Minimises the mean weighted loss plus |w|^2 / (2 C n).
    """
    classes, n = sorted(counts), sum(counts.values())
    index = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    weight = F.create_map(*[x for c in classes for x in (F.lit(c), F.lit(n / (len(classes) * counts[c])))])
    data = train.select(
        index[F.col(label)].alias("label"), weight[F.col(label)].alias("w"), array_to_vector(F.col(emb)).alias("features")
    )
    model = LogisticRegression(
        weightCol="w", regParam=1.0 / (C * n), elasticNetParam=0.0, standardization=False, maxIter=iterations, family="multinomial"
    ).fit(data)
    return model, classes


def apply_probe(df: DataFrame, model: LogisticRegressionModel, classes: Sequence[str], into: Sequence[str], *, emb: str = "emb") -> DataFrame:
    """Add `proba`, aligned to the classes `into`; classes the model never saw get zero."""
    at = {c: i for i, c in enumerate(classes)}
    scored = model.transform(df.withColumn("features", array_to_vector(F.col(emb))))
    p = scored.withColumn("__p", vector_to_array("probability"))
    aligned = F.array(*[F.col("__p")[at[c]] if c in at else F.lit(0.0) for c in into])
    return p.withColumn("proba", aligned).drop("features", "rawPrediction", "probability", "prediction", "__p")


def _fold_counts(df: DataFrame, label: str) -> dict[int, dict[str, int]]:
    cube: dict[int, dict[str, int]] = defaultdict(dict)
    for r in df.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n")).collect():  # folds x classes
        cube[r["fold"]][r[label]] = r["n"]
    return cube


def _outside(cube: dict[int, dict[str, int]], fold: int) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for f, per in cube.items():
        if f != fold:
            for c, n in per.items():
                out[c] += n
    return dict(out)


def with_folds(df: DataFrame, assigned: DataFrame, group: str) -> DataFrame:
    """`df` with the fold of each row's group, stored. `assigned`: (group, fold)."""
    return materialise(null_safe_join(df, assigned.select(group, "fold"), [group]))


def out_of_fold(df: DataFrame, assigned: DataFrame | None = None, *, group: str, C: float = V.PROBE_C, label: str = "cls", emb: str = "emb") -> tuple[DataFrame, list[str]]:
    """Probabilities from models that saw neither the row nor its group. `assigned`: (group, fold).

    Without `assigned` the rows come from `with_folds`. A fold whose training rows hold one class only gets no
    prediction (null).
    """
    rows = df if assigned is None else with_folds(df, assigned, group)
    cube = _fold_counts(rows, label)
    classes = sorted({c for per in cube.values() for c in per})
    parts = []
    for fold in sorted(cube):
        held = rows.filter(F.col("fold") == fold)
        counts = _outside(cube, fold)
        if len(counts) < 2:
            parts.append(held.withColumn("proba", F.lit(None).cast("array<double>")))
            continue
        model, known = fit_probe(rows.filter(F.col("fold") != fold), counts, C=C, label=label, emb=emb)
        parts.append(apply_probe(held, model, known, classes, emb=emb))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, classes


def tune_c(df: DataFrame, *, group: str, grid: Sequence[float] = V.PROBE_C_GRID, folds: int = V.OOF_FOLDS, label: str = "cls", emb: str = "emb") -> DataFrame:
    """(C, macro_f1, best): mean macro-F1 over group folds for each C; the first of equals is best."""
    rows = with_folds(df, group_folds(df, group, folds), group)  # stored once for all values of C
    parts = []
    for place, C in enumerate(grid):
        scored, classes = out_of_fold(rows, group=group, C=C, label=label, emb=emb)
        top = F.array(*[F.lit(c) for c in classes])[F.array_position("proba", F.array_max("proba")).cast("int") - 1]
        cells = scored.filter("proba is not null").groupBy("fold", F.col(label).alias("true"), top.alias("pred")).agg(
            F.count(F.lit(1)).alias("n")
        )
        parts.append(cells.withColumn("C", F.lit(float(C))).withColumn("place", F.lit(place)))
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionByName(part)
    sides = F.array(
        F.struct(F.col("true").alias("cls"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("got"), F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("got"), F.lit(0).cast("long").alias("hit")),
    )
    per = cells.select("place", "C", "fold", F.inline(sides)).groupBy("place", "C", "fold", "cls").agg(
        F.try_divide(2 * F.sum("hit"), F.sum("sup") + F.sum("got")).alias("f1")
    )
    means = per.groupBy("place", "C", "fold").agg(F.avg("f1").alias("f1")).groupBy("place", "C").agg(F.avg("f1").alias("macro_f1"))
    best = means.agg(F.max_by("C", F.struct("macro_f1", -F.col("place"))).alias("best_c"))
    return means.crossJoin(F.broadcast(best)).select("C", "macro_f1", (F.col("C") == F.col("best_c")).alias("best"))


def lowest_passing_score(scored: DataFrame, bar: float = V.IMAGE_PRECISION, *, score: str = "score", positive: str = "y") -> float:
    """The lowest score such that everything at or above it reaches the precision bar; 1 when none does."""
    per = scored.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(positive).alias("hits"))
    run = running_totals(per, score, {"n": "all_n", "hits": "all_hits"})
    lowest = run.filter(F.col("all_hits") / F.col("all_n") >= bar).agg(F.min(score)).first()[0]
    return 1.0 if lowest is None else float(lowest)


def rank_defects(df: DataFrame, *, group: str, key: str = "itemKey", seeds: int = 3, folds: int = V.OOF_FOLDS, C: float = V.DEFECT_PROBE_C, emb: str = "emb") -> tuple[DataFrame, DataFrame]:
    """Defect scores per photo, and one row with the quality of the grouped cross-validation.

    `df`: fileId, emb, defect (0/1), the group and the item key. Scores are the mean over the seeds,
    pooled within the work item.
    """
    rows = df.withColumn("cls", F.col("defect").cast("string"))
    mean = None
    for seed in range(seeds):
        assigned = stratified_group_folds(rows, group, "defect", folds, seed)
        one, classes = out_of_fold(rows, assigned, group=group, C=C, emb=emb)
        part = one.select("fileId", F.col("proba")[classes.index("1")].alias("p"))
        mean = part if mean is None else mean.unionByName(part)
    cv = mean.groupBy("fileId").agg(F.avg("p").alias("p"))
    single = rows.drop(emb).join(cv, "fileId")
    pooled = pool_siblings(single.withColumn("proba", F.array(1 - F.col("p"), F.col("p"))), 2, key=key).select(
        "fileId", F.col("defect").alias("y"), F.col("proba")[1].alias("score"), F.col("p")
    )
    pooled = materialise(pooled)
    counts = {r["cls"]: r["n"] for r in rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}
    model, known = fit_probe(rows, counts, C=C, emb=emb, iterations=3000)
    final = pool_siblings(apply_probe(rows, model, known, ["0", "1"], emb=emb), 2, key=key)
    ranked = final.select("fileId", F.col("proba")[1].alias("defectScore")).join(
        pooled.select("fileId", F.col("score").alias("cvScore"), F.col("y").alias("weakLabel")), "fileId"
    )
    single = roc_auc(pooled.withColumn("score", F.col("p"))).withColumnRenamed("auc", "auc_single")
    size = rows.agg(F.count(F.lit(1)).alias("photos"), F.sum("defect").alias("positives"))
    quality = roc_auc(pooled).crossJoin(average_precision(pooled)).crossJoin(single).crossJoin(size)  # one row each
    quality = quality.withColumn("threshold", F.lit(lowest_passing_score(pooled)))
    return ranked, quality
