"""Class probabilities per photo: linear head, sibling pooling, stage rule, top classes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift import fixed_values as V
from fieldsift.functions.text import blank
from fieldsift.operators.labelling import title_stage
from fieldsift.scale import join_blank_safe


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Compute `value` once and use it several times."""
    return F.transform(F.array(value), use)[0]


def softmax(z: Column) -> Column:
    raised = let(
        F.struct(z.alias("z"), F.array_max(z).alias("m")), lambda s: F.transform(s["z"], lambda x: F.exp(x - s["m"]))
    )
    return let(raised, normalise)


def normalise(e: Column) -> Column:
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return let(F.struct(e.alias("e"), total.alias("t")), lambda s: F.transform(s["e"], lambda x: x / s["t"]))


def log_clipped(proba: Column) -> Column:
    return F.transform(proba, lambda p: F.ln(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-9))))


def linear_scores(features: DataFrame, coef: np.ndarray, intercept: np.ndarray, *, emb: str = "emb", out: str = "proba") -> DataFrame:
    """softmax(coef . x + b) per row. The head is model-sized; rows travel as Arrow batches."""
    weights, bias = np.asarray(coef, dtype=float), np.asarray(intercept, dtype=float)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            z = np.stack(batch.to_numpy()).astype(float) @ weights.T + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            yield pd.Series(list(z / z.sum(axis=1, keepdims=True)))

    return features.withColumn(out, score(emb))


def pool_siblings(
    df: DataFrame, k: int, *, key: str = "itemKey", proba: str = "proba", identity: str = "fileId", weight: float = 1.0
) -> DataFrame:
    """Weigh each photo's log-probabilities with the mean of the other photos of its work item.

    Sums per item are aggregated map-side first, one column per class; a blank key or a lone photo
    keeps its own values, clipped and normalised. A null `proba` (no prediction) stays null and takes
    no part in its item.
    """
    rows = df.withColumn("__lp", log_clipped(F.col(proba)))
    known = rows.filter((blank(key) != "") & F.col("__lp").isNotNull())
    sums = known.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(F.col("__lp")[i]).alias(f"__s{i}") for i in range(k)])
    sums = sums.filter("__n > 1").select(key, "__n", F.array(*[F.col(f"__s{i}") for i in range(k)]).alias("__sum"))
    joined = join_blank_safe(rows, sums, key, identity)
    mixed = F.zip_with(
        "__lp", "__sum", lambda own, s: (own + F.lit(weight) * (s - own) / (F.col("__n") - 1)) / (1 + weight)
    )
    return joined.withColumn(
        proba, F.when(F.col("__lp").isNotNull(), softmax(F.coalesce(mixed, F.col("__lp"))))
    ).drop("__lp", "__n", "__sum")


def item_geomean(df: DataFrame, k: int, *, key: str = "itemKey", proba: str = "proba") -> DataFrame:
    """One distribution per work item: the normalised geometric mean over its photos."""
    rows = df.filter(blank(key) != "").select(key, log_clipped(F.col(proba)).alias("lp"))
    means = rows.groupBy(key).agg(F.count(F.lit(1)).alias("photos"), *[F.avg(F.col("lp")[i]).alias(f"m{i}") for i in range(k)])
    return means.select(key, "photos", softmax(F.array(*[F.col(f"m{i}") for i in range(k)])).alias(proba))


def _classes(classes: Sequence[str]) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def top_class(proba: Column, classes: Sequence[str]) -> Column:
    """The likeliest class; the first of equals."""
    return _classes(classes)[F.array_position(proba, F.array_max(proba)).cast("int") - 1]


def top_three(proba: Column, classes: Sequence[str]) -> Column:
    """The three likeliest classes with probabilities, equals in class order."""
    ranked = F.transform(proba, lambda p, i: F.struct((-p).alias("np"), i.alias("i")))
    return F.transform(
        F.slice(F.array_sort(ranked), 1, 3),
        lambda s: F.struct(_classes(classes)[s["i"]].alias("cls"), (-s["np"]).alias("p")),
    )


def margin(proba: Column) -> Column:
    """Lead of the likeliest class over the next; zero with a single class."""
    best = F.sort_array(proba, asc=False)
    return F.when(F.size(proba) > 1, best[0] - F.try_element_at(best, F.lit(2))).otherwise(F.lit(0.0))


def with_stage(df: DataFrame, classes: Sequence[str], *, proba: str = "proba", title: str = "title") -> DataFrame:
    """Add modelClass, modelConfidence and stageSource (model, title or manual).

    Where the pair of stages is likely as a group but undecided, the title decides; a title that
    does not say leaves it to a person. A row without a prediction gets blanks and zero.
    """
    p = F.col(proba)
    top, best = top_class(p, classes), F.array_max(p)
    if all(c in classes for c in V.STAGE_CLASSES):
        base, finish = (p[list(classes).index(c)] for c in V.STAGE_CLASSES)
        group = base + finish
        open_ = (group >= V.STAGE_GROUP) & (F.try_divide(F.greatest(base, finish), group) < V.STAGE_SHARE)
        stage = title_stage(F.col(title))
        source = F.when(~open_, F.lit("model")).when(stage != "", F.lit("title")).otherwise(F.lit("manual"))
    else:
        group, stage, source = best, F.lit(""), F.lit("model")
    ready = df.withColumn("stageSource", F.when(p.isNull(), F.lit("")).otherwise(source))
    by_title = F.col("stageSource") == "title"
    return ready.withColumn(
        "modelClass", F.when(p.isNull(), F.lit("")).when(by_title, stage).otherwise(top)
    ).withColumn("modelConfidence", F.when(p.isNull(), F.lit(0.0)).when(by_title, group).otherwise(best))


def low_confidence(confidence: Column, source: Column) -> Column:
    return (confidence < V.REVIEW_CONFIDENCE) | (source == "manual")


def prediction_id(file_id: Column, image_hash: Column, model_hash: Column) -> Column:
    return F.sha2(F.concat_ws(":", file_id, image_hash, model_hash), 256)


def work_item_key(report: Column, title: Column) -> Column:
    """Photos of one report under one title belong together; without a report there is no item."""
    return F.when(blank(report) != "", F.concat_ws("|", report, blank(title))).otherwise(F.lit(""))


def defect_labels(df: DataFrame, human: DataFrame, marks: DataFrame) -> DataFrame:
    """Add `defect` (0/1): a person's mark wins; else a title that says so or a human defect class."""
    said = human.select("fileId", F.col("cls").alias("__cls"))
    mark = marks.select("fileId", F.col("defect").alias("__mark"))
    weak = blank("title").rlike(V.DEFECT_TITLE) | F.coalesce(F.col("__cls") == V.DEFECT_CLASS, F.lit(False))
    out = df.join(said, "fileId", "left").join(mark, "fileId", "left")
    return out.withColumn("defect", F.coalesce("__mark", weak).cast("int")).drop("__cls", "__mark")
