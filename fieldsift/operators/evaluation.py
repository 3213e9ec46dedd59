"""Scores of a classifier, fair exams between two versions, and the gates built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift import fixed_values as V
from fieldsift.operators import scoring
from fieldsift.functions.rules import RuleSet
from fieldsift.functions.text import blank
from fieldsift.scale import running_totals


def _cells(df: DataFrame, true: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    return _cells(df, true, pred)


def class_report(df: DataFrame, true: str = "true", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; rows are reduced to class pairs first."""
    hit = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("true").alias("cls"), F.col("n").alias("s"), none.alias("g"), hit.cast("long").alias("h")),
        F.struct(F.col("pred").alias("cls"), none.alias("s"), F.col("n").alias("g"), none.alias("h")),
    )
    per = _cells(df, true, pred, by).select(*by, F.inline(sides)).groupBy(*by, "cls").agg(
        F.sum("s").alias("support"), F.sum("g").alias("__g"), F.sum("h").alias("__h")
    )
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return per.select(
        *by, "cls", zero(F.col("__h"), F.col("__g")).alias("precision"), zero(F.col("__h"), F.col("support")).alias("recall"),
        zero(2 * F.col("__h"), F.col("support") + F.col("__g")).alias("f1"), "support",
    )


def run_metrics(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Top-1, macro-F1 over classes that were really there, and how many were only guessed."""
    real = F.col("support") > 0
    return report.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("top1"),
        F.avg(F.when(real, F.col("f1"))).alias("macroF1"),
        F.count_if(real).alias("classes"),
        F.count_if(~real).alias("ghosts"),
        F.sum("support").alias("support"),
    )


def fused_and_single(df: DataFrame, classes: Sequence[str], *, true: str = "true", key: str = "itemKey", proba: str = "proba", identity: str = "fileId", weight: float = 1.0) -> DataFrame:
    """`kind, top1, macroF1, classes, ghosts, support`: one exam marked twice, each photo alone and with its work item.

    Rows `single` take the likeliest class of a photo's own scores, rows `fused` that after `pool_siblings`. A photo
    without scores or without a true class is not marked; photos without work item count alike in both.
    """
    marked = df.filter(F.col(proba).isNotNull() & F.col(true).isNotNull()).withColumn("__own", F.col(proba))
    pooled = scoring.pool_siblings(marked, len(classes), key=key, proba=proba, identity=identity, weight=weight)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), scoring.top_class(F.col(c), classes).alias("pred")) for k, c in (("single", "__own"), ("fused", proba))])
    answers = pooled.select(F.col(true).alias("true"), F.inline(kinds))
    return run_metrics(class_report(answers, by=["kind"]), by=["kind"])


def _curve(df: DataFrame, confidence: str, correct: str, abstained: str | None) -> DataFrame:
    counts = F.lit(True) if abstained is None else ~F.coalesce(F.col(abstained), F.lit(False))
    return df.filter(counts).groupBy(F.col(confidence).alias("conf")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("good")
    )


def coverage_at_precision(
    df: DataFrame, *, confidence: str = "conf", correct: str = "correct", abstained: str | None = None, bar: float = V.PRECISION_BAR, **running
) -> DataFrame:
    """One row: the largest share that can be accepted at the precision bar.

    Equal confidences are taken or left together; abstentions stay in the denominator.
    """
    if not 0 < bar <= 1:
        raise ValueError("the bar must be in (0, 1]")
    c = F.col(confidence).cast("double")
    facts = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(c.isNull() | F.isnan(c) | (c < 0) | (c > 1)).alias("invalid"),
    )
    checked = facts.withColumn(
        "total", F.when(F.col("invalid") > 0, F.raise_error(F.lit("confidence must be in [0, 1]")).cast("long")).otherwise(F.col("total"))
    )
    run = running_totals(_curve(df, confidence, correct, abstained), "conf", {"n": "accepted", "good": "hits"}, **running)
    best = run.filter(F.col("hits") / F.col("accepted") >= bar).agg(F.coalesce(F.max("accepted"), F.lit(0)).alias("covered"))
    return checked.crossJoin(F.broadcast(best)).select(  # one row each
        "total", "covered", F.coalesce(F.try_divide("covered", "total"), F.lit(0.0)).alias("coverage")
    )


def threshold_curve(df: DataFrame, *, confidence: str = "conf", correct: str = "correct", thresholds: Sequence[float] = V.CURVE_THRESHOLDS) -> DataFrame:
    """Coverage and accuracy at fixed thresholds, in one pass; thresholds nobody reaches are left out."""
    totals = [F.count(F.lit(1)).alias("total")]
    for i, t in enumerate(thresholds):
        over = F.col(confidence) >= t
        totals += [F.count_if(over).alias(f"n{i}"), F.count_if(over & F.col(correct)).alias(f"g{i}")]
    steps = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("n"), F.col(f"g{i}").alias("good"))
            for i, t in enumerate(thresholds)
        ]
    )
    return df.agg(*totals).select("total", F.inline(steps)).filter("n > 0").select(
        "threshold", F.round(F.col("n") / F.col("total"), 3).alias("coverage"), F.round(F.col("good") / F.col("n"), 3).alias("accuracy"), "n"
    )


def outside_answer(df: DataFrame, rules: RuleSet, valid: Sequence[str], *, answer: str = "predWorkItem", truth: str = "cls", local: str = "pred") -> DataFrame:
    """How a third party's free-text answers fare after the same rules, next to the local model.

    An answer outside the classes in play counts as the fallback. Only rows with an answer are compared.
    """
    total = df.agg(F.count(F.lit(1)).alias("total"))
    normal = rules.with_class(df.filter(blank(answer) != ""), answer, "__n")
    named = F.coalesce("__n", F.lit(rules.fallback))
    named = F.when(named.isin(*valid), named).otherwise(F.lit(rules.fallback))
    n = F.count(F.lit(1))
    out = normal.agg(
        n.alias("support"),
        F.round(F.try_divide(F.count_if(named == F.col(truth)), n), 3).alias("top1"),
        F.round(F.try_divide(F.count_if(F.col(local) == F.col(truth)), n), 3).alias("localTop1SameSubset"),
        F.count_distinct(answer).alias("distinctRawStrings"),
    )
    return out.crossJoin(F.broadcast(total)).withColumn(  # one row each
        "coverage", F.round(F.col("support") / F.greatest("total", F.lit(1)), 3)
    ).drop("total")


def score_card(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """One row: n, top-1, macro-F1 and recall per class; nulls for an empty exam."""
    return class_report(df, true, pred).agg(
        F.coalesce(F.sum("support"), F.lit(0)).alias("n"),
        F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("top1"),
        F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macroF1"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("support") > 0, F.struct("cls", F.struct("support", "recall")))))
        ).alias("recall"),
    )


def fair_exam(candidate: DataFrame, baseline: DataFrame, known: DataFrame, pool: DataFrame, *features: DataFrame) -> DataFrame:
    """(fileId, cls) of the exam neither version has an unfair edge on.

    `candidate`, `baseline`: splits (fileId, part, cls). `known` (cls): classes the baseline can answer.
    """
    paper = (
        candidate.filter("part = 'test'").select("fileId", "cls")
        .join(baseline.filter("part = 'train'").select("fileId"), "fileId", "left_anti")
        .join(known.select("cls"), "cls", "left_semi")
        .join(pool.select("fileId"), "fileId", "left_semi")
    )
    for table in features:
        paper = paper.join(table.select("fileId"), "fileId", "left_semi")
    return paper.select("fileId", "cls")


def exam_leakage(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """How much of the candidate's test part the baseline was trained on."""
    test = candidate.filter("part = 'test'").select("fileId").distinct()
    trained = baseline.filter("part = 'train'").select("fileId").distinct().withColumn("__t", F.lit(True))
    return test.join(trained, "fileId", "left").agg(
        F.count(F.lit(1)).alias("candidateTest"), F.count("__t").alias("candidateTestInBaselineTrain")
    )


def verdict(exam: DataFrame, *, true: str = "true", candidate: str = "candidate", baseline: str = "baseline", catalogue_same: bool = True) -> DataFrame:
    """One row: may the candidate replace the baseline, and every reason why not."""
    cand = score_card(exam, true, candidate).select(F.struct("n", "top1", "macroF1", "recall").alias("c"))
    base = score_card(exam, true, baseline).select(F.struct("n", "top1", "macroF1", "recall").alias("b"))
    both = cand.crossJoin(F.broadcast(base))  # one row each

    def worse(metric: str) -> Column:
        c, b = F.col(f"c.{metric}"), F.col(f"b.{metric}")
        return F.when(c < b - V.TOLERANCE, F.format_string(V.VERDICT_WORSE, F.lit(metric), c, b, F.lit(str(V.TOLERANCE))))

    drops = F.transform(
        F.filter(
            F.map_entries("b.recall"),
            lambda e: (e["value"]["support"] >= V.MIN_CLASS_SUPPORT)
            & (e["value"]["recall"] - F.col("c.recall")[e["key"]]["recall"] > V.MAX_CLASS_DROP),
        ),
        lambda e: F.format_string(
            V.VERDICT_DROP, e["key"], e["value"]["recall"], F.col("c.recall")[e["key"]]["recall"],
            100 * (e["value"]["recall"] - F.col("c.recall")[e["key"]]["recall"]),
        ),
    )
    catalogue = F.lit(None).cast("string") if catalogue_same else F.lit(V.VERDICT_CATALOGUE)
    small = F.when(F.col("c.n") < V.MIN_EXAM, F.format_string(V.VERDICT_SMALL, F.col("c.n"), F.lit(V.MIN_EXAM)))
    scores = F.when(small.isNull(), F.concat(F.array_compact(F.array(worse("top1"), worse("macroF1"))), drops))
    reasons = F.concat(F.array_compact(F.array(catalogue, small)), F.coalesce(scores, F.array().cast("array<string>")))
    return both.withColumn("reasons", reasons).select(
        (F.size("reasons") == 0).alias("promote"), "reasons", F.col("c.n").alias("n"), F.col("c.top1").alias("candidateTop1"),
        F.col("b.top1").alias("baselineTop1"), F.col("c.macroF1").alias("candidateMacroF1"), F.col("b.macroF1").alias("baselineMacroF1"),
    )


def gold_problems(gold: DataFrame, manifest: DataFrame, splits: dict[str, DataFrame], today: str) -> DataFrame:
    """(problem, n): what keeps a gold set from being an independent exam.

    `gold`: fileId, cls. `manifest`: fileId (unique), source, active, constrId, reportDate.
    `splits`: version -> (fileId, dataset).
    """
    facts = manifest.select(
        "fileId", F.concat_ws("|", "constrId", "reportDate").alias("grp"),
        (
            (F.col("source") == V.WORK_ITEM) & F.lower("active").isin("true", "1") & (blank("constrId") != "")
            & (blank("reportDate") != "") & (F.col("reportDate") <= today)
        ).alias("ok"),
    )
    per_id = gold.groupBy("fileId").agg(F.count(F.lit(1)).alias("copies"), F.max(F.trim(blank("cls")) == "").alias("unnamed"))
    placed = per_id.join(facts, "fileId", "left")
    n = placed.agg(
        F.when(F.sum("copies") < V.GOLD_MINIMUM, F.sum("copies")).alias(f"fewer than {V.GOLD_MINIMUM} answers"),
        F.count_if((F.col("copies") > 1) | F.col("unnamed") | (F.trim(blank("fileId")) == "")).alias("blank or repeated answers"),
        F.count_if(F.col("ok").isNull()).alias("not in the manifest"),
        F.count_if(~F.col("ok")).alias("not a valid work item"),
    )
    out = n.select(F.inline(F.array(*[F.struct(F.lit(c).alias("problem"), F.col(f"`{c}`").cast("long").alias("n")) for c in n.columns])))
    groups = placed.filter("grp is not null").select("grp").distinct()
    for version, split in splits.items():
        used = split.select(F.substring_index("fileId", "#", 1).alias("fileId")).distinct().join(facts, "fileId").select("grp")
        overlap = groups.join(used, "grp", "left_semi").agg(F.count(F.lit(1)).alias("n"))
        foreign = split.filter(~F.col("dataset").isin(*V.GOLD_DATASETS)).agg(F.count(F.lit(1)).alias("n"))
        out = out.union(overlap.select(F.lit(f"site days shared with {version}"), "n")).union(
            foreign.select(F.lit(f"foreign rows in {version}"), "n")
        )
    return out.filter("n > 0")


def gold_gate(answers: DataFrame, folds: DataFrame) -> DataFrame:
    """One row: candidate against baseline on a gold set.

    `answers`: fileId, true, cand, cand_conf, base, base_conf. `folds`: fileId, fold.
    """
    sides = {}
    for side in ("cand", "base"):
        rows = answers.select(F.col(f"{side}_conf").alias("conf"), (F.col(side) == F.col("true")).alias("correct"))
        sides[side] = coverage_at_precision(rows).select(F.round("coverage", 4).alias(f"{side}_coverage"))
    zero = class_report(answers, "true", "cand").agg(
        F.count_if((F.col("recall") == 0) & (F.col("support") >= V.GATE_SUPPORT)).alias("zero_recall")
    )
    out = sides["cand"].crossJoin(F.broadcast(sides["base"])).crossJoin(F.broadcast(zero))  # one row each
    placed = answers.join(folds, "fileId")
    for side in ("cand", "base"):
        out = out.crossJoin(F.broadcast(fold_macro_f1(placed, "true", side).agg(
            F.avg("macroF1").alias(f"{side}_f1"), F.stddev_pop("macroF1").alias(f"{side}_f1_std"))))
    return out.select(
        "*",
        ((F.col("cand_coverage") > 0) & (F.col("cand_coverage") >= F.col("base_coverage") - V.COVERAGE_SLACK)).alias("coverage_ok"),
        (F.col("zero_recall") == 0).alias("recall_ok"),
        (F.col("cand_f1") >= F.col("base_f1") - F.col("base_f1_std") * V.F1_SLACK_SIGMA).alias("f1_ok"),
    )


def fold_macro_f1(df: DataFrame, true: str, pred: str, fold: str = "fold") -> DataFrame:
    """Macro-F1 per fold, over the classes present in the fold."""
    report = class_report(df, true, pred, [fold])
    return report.filter("support > 0").groupBy(fold).agg(F.round(F.avg("f1"), 4).alias("macroF1"))


def class_recalls(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """Recall per true class, with whether there are enough rows to judge it."""
    return class_report(df, true, pred).filter("support > 0").select(
        "cls", F.col("support").alias("n"), F.round("recall", 3).alias("recall"), (F.col("support") >= V.GATE_SUPPORT).alias("gated")
    )


def _score_groups(df: DataFrame, score: str, positive: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.col(positive).cast("long")).alias("p"), F.sum(1 - F.col(positive).cast("long")).alias("q")
    )


def roc_auc(df: DataFrame, score: str = "score", positive: str = "y", **running) -> DataFrame:
    """`auc`: chance that a positive outranks a negative; ties count half. One row."""
    run = running_totals(_score_groups(df, score, positive), "s", {"p": "pp", "q": "qq"}, descending=False, **running)
    # negatives strictly below, plus half of those level
    wins = F.sum(F.col("p").cast("double") * (F.col("qq") - F.col("q") / 2))
    return run.agg((F.try_divide(wins, F.sum("p").cast("double") * F.sum("q"))).alias("auc"))


def average_precision(df: DataFrame, score: str = "score", positive: str = "y", **running) -> DataFrame:
    """`ap`: precision averaged over the steps of recall, equal scores as one step. One row."""
    run = running_totals(_score_groups(df, score, positive), "s", {"p": "pp", "q": "qq"}, **running)
    return run.agg(F.try_divide(F.sum(F.col("p") * F.col("pp") / (F.col("pp") + F.col("qq"))), F.sum("p")).alias("ap"))


def site_auc(df: DataFrame, *, site: str = "site", score: str = "score", positive: str = "y", least: int = 5) -> DataFrame:
    """AUC inside each site that has enough positives and at least one negative.

    Ranks need the rows of a site in score order; they are reduced to distinct scores first, and the
    counts below a score come from per-bucket totals so that a big site is not one task's work.
    """
    from pyspark.sql import Window

    per = df.groupBy(site, F.col(score).alias("s")).agg(
        F.sum(F.col(positive).cast("long")).alias("p"), F.sum(1 - F.col(positive).cast("long")).alias("q")
    )
    bucketed = per.withColumn("b", F.floor(F.col("s") * 1024))
    below = Window.partitionBy(site).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy(site, "b").agg(F.sum("q").alias("bq")).select(
        site, "b", F.coalesce(F.sum("bq").over(below), F.lit(0)).alias("off")
    )
    inside = Window.partitionBy(site, "b").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    ranked = bucketed.join(offsets, [site, "b"]).withColumn("qq", F.col("off") + F.sum("q").over(inside))
    return (
        ranked.groupBy(site)
        .agg(
            F.sum(F.col("p") + F.col("q")).alias("n"), F.sum("p").alias("pos"), F.sum("q").alias("__q"),
            F.sum(F.col("p").cast("double") * (F.col("qq") - F.col("q") / 2)).alias("__w"),
        )
        .filter((F.col("pos") >= least) & (F.col("pos") < F.col("n")))
        .select(site, "n", "pos", (F.col("__w") / (F.col("pos").cast("double") * F.col("__q"))).alias("auc"))
    )


def precision_at(df: DataFrame, ks: Sequence[int] = (50, 100, 200), *, score: str = "score", positive: str = "y", identity: str = "fileId") -> DataFrame:
    """Share of positives among the best k, for every k the table can fill."""
    from pyspark.sql import Window

    top = df.orderBy(F.col(score).desc(), identity).limit(max(ks))  # a bounded report: the best max(ks)
    ranked = top.withColumn("__r", F.row_number().over(Window.orderBy(F.col(score).desc(), identity)))
    steps = ranked.select(positive, F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: F.col("__r") <= k)).alias("k"))
    return steps.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(positive), 3).alias("precision")).filter("n = k").select("k", "precision")


def first_errors(df: DataFrame, n: int = 24, *, true: str = "true", pred: str = "pred", identity: str = "fileId") -> DataFrame:
    """The first `n` wrong answers (a report of fixed size)."""
    return df.filter(F.col(true) != F.col(pred)).orderBy(identity).limit(n).select(identity, true, pred)
