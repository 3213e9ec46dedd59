"""One query per operator family over the given tables, and its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsift.operators import agreement as A
from fieldsift.operators import deident, evaluation, journal, labelling, merge, mining, pool, replay, routing, sampling, scoring, splitting
from fieldsift.plans import bindings as B
from fieldsift.scale import hash_rank, latest_by, ordered_rank
from fieldsift.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


MANIFEST = """
    m AS (
        SELECT CAST(doc_id AS VARCHAR) AS fileId, split_part(text, chr(10), 1) AS title, lang, source AS site, n_chars, doc_id AS seq,
               strftime(DATE '2024-01-01' + CAST(n_chars % 365 AS INTEGER), '%Y-%m-%d') AS reportDate
        FROM documents
    ), ruled AS (
        SELECT *, CASE WHEN length(title) < 8 OR title IN ('The.', 'Le.') THEN NULL
            WHEN regexp_matches(title, ' und | der | die |Der |Die ') THEN 'german'
            WHEN regexp_matches(title, ' the | of | and |The |Of ') THEN 'english'
            WHEN regexp_matches(title, ' les | des | le |Le |Les ') THEN 'french'
            WHEN regexp_matches(title, ' el | del | y |El |Del ') THEN 'spanish'
            ELSE 'other' END AS rule
        FROM (SELECT * REPLACE (trim(title) AS title) FROM m) WHERE site <> 'src3'
    ), said AS (
        SELECT CAST(doc_id AS VARCHAR) AS fileId,
               CASE lang WHEN 'de' THEN 'german' WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' ELSE 'spanish' END AS cls
        FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
    )
"""


@query(f"WITH {MANIFEST} SELECT rule AS cls, count(*) AS photos FROM ruled WHERE rule IS NOT NULL GROUP BY rule")
def rule_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelling.class_counts(
        labelling.apply_rules(B.manifest(spark, sf_dir), B.LANGUAGE_RULES, drop_small=False, today=B.TODAY)
    )


@query(f"""WITH {MANIFEST} SELECT fileId, rule AS cls FROM ruled WHERE rule IN (
    SELECT rule FROM ruled WHERE rule IS NOT NULL AND rule <> 'other' GROUP BY rule HAVING count(*) >= 60)""")
def rule_apply_min_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelling.apply_rules(B.manifest(spark, sf_dir), B.LANGUAGE_RULES, today=B.TODAY).select("fileId", "cls")


@query(f"""WITH {MANIFEST} SELECT cls, count(*) AS photos FROM (
    SELECT coalesce(s.cls, r.rule) AS cls FROM ruled r LEFT JOIN said s USING (fileId)) WHERE cls IS NOT NULL GROUP BY cls""")
def rule_override_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    human = B.language_verdicts(spark, sf_dir)
    return labelling.class_counts(
        labelling.apply_rules(B.manifest(spark, sf_dir), B.LANGUAGE_RULES, human=human, drop_small=False, today=B.TODAY)
    )


@query(f"""WITH {MANIFEST} SELECT rule AS cls, count(*) AS photos, 60 - count(*) AS need, max(reportDate) AS latest
    FROM ruled WHERE rule IS NOT NULL AND rule <> 'other' GROUP BY rule HAVING count(*) < 60""")
def waiting_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelling.waiting_classes(B.manifest(spark, sf_dir), B.LANGUAGE_RULES, today=B.TODAY)


@query(f"WITH {MANIFEST} SELECT m.title, count(*) AS photos FROM m JOIN ruled USING (fileId) WHERE rule = 'other' GROUP BY m.title")
def unclaimed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelling.title_counts(labelling.unclaimed(B.manifest(spark, sf_dir), B.LANGUAGE_RULES, today=B.TODAY))


@query(f"""WITH {MANIFEST}, r AS (SELECT m.fileId, CASE WHEN length(trim(title)) < 8 OR trim(title) IN ('The.', 'Le.') THEN NULL
            WHEN regexp_matches(title, ' und | der | die |Der |Die ') THEN 'german' WHEN regexp_matches(title, ' the | of | and |The |Of ') THEN 'english'
            WHEN regexp_matches(title, ' les | des | le |Le |Les ') THEN 'french' WHEN regexp_matches(title, ' el | del | y |El |Del ') THEN 'spanish'
            ELSE 'other' END AS rule FROM (SELECT * REPLACE (trim(title) AS title) FROM m) m)
    SELECT count(*) AS reviewed, count(*) FILTER (rule = cls) AS ruleMatches, count(*) FILTER (rule = cls) / count(*) AS ruleAccuracy
    FROM r JOIN said USING (fileId) WHERE fileId NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""")
def rule_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = B.table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("fileId"))
    return labelling.rule_calibration(B.manifest(spark, sf_dir), B.LANGUAGE_RULES, B.language_verdicts(spark, sf_dir), held)


@query("""SELECT label, CASE WHEN label IN ('german','english','french','spanish') THEN 'labels.yaml' ELSE 'human-approved' END AS origin,
    CASE label WHEN 'german' THEN 1 WHEN 'english' THEN 1 WHEN 'french' THEN 1 WHEN 'spanish' THEN 1 ELSE 0 END AS patterns
    FROM (SELECT unnest(['german','english','french','spanish']) AS label UNION SELECT DISTINCT event_type FROM events)""")
def class_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    approved = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("label")).distinct()
    out = labelling.catalogue(B.LANGUAGE_RULES, approved)
    return out.select("label", "origin", F.size("patterns").alias("patterns"))


@query("SELECT CAST(doc_id AS VARCHAR) AS fileId, lang AS cls FROM documents WHERE lang NOT IN (SELECT DISTINCT lang FROM documents WHERE lang <> 'en')")
def orphan_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents")
    human = docs.select(F.col("doc_id").cast("string").alias("fileId"), F.col("lang").alias("cls"))
    known = docs.filter("lang <> 'en'").select(F.col("lang").alias("label")).distinct()
    return labelling.orphan_verdicts(human, known, B.LANGUAGE_RULES)


# --- logs


@query("""SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS entity, max(event_id) AS seq, arg_max(value, event_id) AS value
    FROM events GROUP BY ALL""")
def latest_event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = B.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("entity"), F.col("event_id").alias("seq"), "value"
    )
    return replay.latest_events(log)


@query("""SELECT CAST(user_id AS VARCHAR) AS fileId, arg_max(event_type, event_id) AS cls FROM events WHERE value >= 10 GROUP BY user_id""")
def last_nonblank_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.last_verdicts(B.event_reviews(spark, sf_dir))


@query("""WITH t AS (SELECT user_id, max_by(event_type, event_id) AS kind, max_by(value, event_id) AS value
        FROM events WHERE event_type <> 'click' GROUP BY user_id)
    SELECT CAST(user_id AS VARCHAR) AS fileId, CAST(floor(value) AS INTEGER) AS x0, CAST(floor(value) AS INTEGER) + 50 AS y1
    FROM t WHERE kind <> 'error'""")
def last_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = replay.last_boxes(B.event_reviews(spark, sf_dir))
    return boxes.select("fileId", F.col("boxes")[0][0].alias("x0"), F.col("boxes")[0][3].alias("y1"))


@query("""WITH d AS (SELECT user_id, max(event_id) AS seq, arg_max(event_type, event_id) AS action FROM events
        WHERE event_type IN ('purchase', 'error', 'signup') GROUP BY user_id),
    r AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'click' GROUP BY user_id),
    b AS (SELECT d.*, (SELECT max(event_id) FROM events e WHERE e.user_id = d.user_id AND e.event_type = 'click' AND e.event_id < d.seq) AS seen FROM d)
    SELECT CAST(b.user_id AS VARCHAR) AS fileId, b.seq, b.action FROM b LEFT JOIN r USING (user_id) WHERE b.seen IS NOT DISTINCT FROM r.last""")
def active_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = B.table(spark, sf_dir, "events")
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).over(before)
    rows = e.withColumn("reviewSeq", seen).select(
        F.col("user_id").cast("string").alias("fileId"), F.col("event_id").alias("seq"), "reviewSeq", F.col("event_type").alias("action")
    )
    reviews = rows.filter("action = 'click'").select("fileId", "seq")
    return replay.active_decisions(rows.filter("action in ('purchase', 'error', 'signup')"), reviews).select("fileId", "seq", "action")


# --- merging


@query("""SELECT CAST(doc_id AS VARCHAR) AS fileId, CASE WHEN n_chars > 1000 THEN 'true' ELSE 'false' END AS active,
    CASE WHEN n_chars > 1000 THEN n_chars + 1 ELSE n_chars END AS size FROM documents""")
def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = B.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("fileId"), F.lit("true").alias("active"), F.col("n_chars").alias("size")
    )
    new = old.filter("size > 1000").withColumn("size", F.col("size") + 1)
    return merge.merge_manifest(old, new, partial=False)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END AS version FROM orders""")
def watermark_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders")
    old = o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit(1).alias("version"))
    fresh = o.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").cast("string").alias("id"), F.lit(2).alias("version"))
    return merge.upsert(old, fresh, ["id"])


@query("""SELECT CAST(user_id AS VARCHAR) AS fileId, event_type AS defectType, min(event_id) AS pos FROM events e
    WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.value < 2 AND s.user_id = e.user_id AND s.event_type = e.event_type) GROUP BY ALL""")
def append_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "events")
    rows = e.select(
        F.col("user_id").cast("string").alias("fileId"), F.lit("s").alias("source"), F.col("event_type").alias("defectType"),
        F.lit(None).cast("string").alias("box"), F.col("event_id").alias("pos"), "value",
    )
    stored = rows.filter("value < 2").select("fileId", "source", "defectType", "box").distinct()
    return merge.new_defects(rows, stored).select("fileId", "defectType", "pos")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS dailyReportInfoId FROM orders
    WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 1000 AND o_orderpriority <> '1-URGENT')""")
def incremental_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey").cast("string"))
    done = F.when(F.col("o_orderstatus") == "F", F.lit("SUBMITTED")).otherwise(F.lit("DRAFT"))
    listed = o.select(F.col("id").alias("dailyReportInfoId"), done.alias("status"), F.lit(1).alias("version"))
    index = o.select(F.col("id").alias("dailyReportInfoId"), done.alias("status"), F.when(F.col("o_totalprice") > 1000, 1).otherwise(0).alias("version"))
    cached = o.filter("o_orderpriority <> '1-URGENT'").select(F.col("id").alias("dailyReportInfoId"))
    return merge.reports_to_fetch(listed, index, cached).select("dailyReportInfoId")


# --- splits and samples

DAYS = """
    x AS (SELECT CAST(o_orderkey AS VARCHAR) AS fileId, CAST(o_custkey AS VARCHAR) AS constrId, strftime(o_orderdate, '%Y-%m-%d') AS reportDate,
                 o_orderpriority AS cls FROM orders),
    d AS (SELECT DISTINCT constrId, reportDate FROM x),
    n AS (SELECT *, count(*) OVER (PARTITION BY constrId) AS n, row_number() OVER (PARTITION BY constrId ORDER BY reportDate DESC) AS back FROM d),
    t AS (SELECT constrId, reportDate FROM n WHERE back <= least(greatest(1, ceil(n * 0.2)), greatest(n - 1, 0)))
"""


@query(f"WITH {DAYS} SELECT * FROM t")
def latest_days_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.latest_test_days(B.site_days(spark, sf_dir), fraction=0.2, today=B.TODAY)


@query(f"""WITH {DAYS}, p AS (SELECT x.cls, t.constrId IS NOT NULL AS test FROM x LEFT JOIN t USING (constrId, reportDate))
    SELECT cls, count(*) FILTER (NOT test) AS train, count(*) FILTER (test) AS test,
    count(*) FILTER (NOT test) > 0 AND count(*) FILTER (test) = 0 AS missing_in_test, count(*) FILTER (NOT test) < count(*) FILTER (test) AS starved
    FROM p GROUP BY cls""")
def split_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.site_days(spark, sf_dir)
    days = splitting.latest_test_days(rows, fraction=0.2, today=B.TODAY)
    return splitting.split_counts(splitting.assemble_split(rows, days))


@query()
def rare_floor_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.site_days(spark, sf_dir)
    counts = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    days = splitting.latest_test_days(rows, fraction=0.3, today=B.TODAY)
    return splitting.rare_class_floor(rows, days, floor=int(0.72 * counts))[1]


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS fileId FROM orders
    WHERE CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 5""")
def audit_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = B.site_days(spark, sf_dir).select("fileId")
    return ids.filter(splitting.audit_pick(F.col("fileId")))


@query()
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.group_folds(B.site_days(spark, sf_dir), "constrId")


@query()
def stratified_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.site_days(spark, sf_dir).withColumn("hit", (F.col("cls") == "1-URGENT").cast("int"))
    return splitting.stratified_group_folds(rows, "constrId", "hit")


@query("""SELECT fileId, cls FROM (SELECT CAST(doc_id AS VARCHAR) AS fileId, lang AS cls FROM documents)
    ORDER BY sha256(fileId), fileId LIMIT 150""")
def simple_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.manifest(spark, sf_dir).select("fileId", F.col("lang").alias("cls"))
    return sampling.simple_sample(rows, 150)


@query()
def stratified_floor_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.manifest(spark, sf_dir).select("fileId", F.col("lang").alias("cls"))
    return sampling.stratified_floor(rows, 120, 20)


@query("""WITH x AS (SELECT CAST(doc_id AS VARCHAR) AS fileId, source AS stratum FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256(fileId), fileId) AS n, count(*) OVER (PARTITION BY stratum) AS k FROM x)
    SELECT stratum, fileId, CAST(least(k, CASE WHEN k > 20 THEN 30 ELSE k END) >= 30 AS INTEGER) AS gateEligible FROM r
    WHERE n <= CASE WHEN k > 20 THEN least(k, 30) ELSE k END""")
def capped_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.manifest(spark, sf_dir).select("fileId", F.col("constrId").alias("stratum"))
    return sampling.capped_strata(rows, 20)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS fileId, o_orderpriority AS cls,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256(CAST(o_orderkey AS VARCHAR)), CAST(o_orderkey AS VARCHAR)) AS rank FROM orders""")
def hash_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_rank(B.site_days(spark, sf_dir).select("fileId", "cls"), ["cls"], "fileId")


# --- scores


@query("""WITH x AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fileId, l_orderkey, (l_discount + 0.01) / 0.12 AS p FROM lineitem),
    l AS (SELECT *, ln(least(greatest(p, 1e-9), 1.0)) AS a, ln(least(greatest(1 - p, 1e-9), 1.0)) AS b FROM x),
    s AS (SELECT l_orderkey, count(*) AS n, sum(a) AS sa, sum(b) AS sb FROM l GROUP BY 1),
    m AS (SELECT fileId, CASE WHEN n > 1 THEN (a + (sa - a) / (n - 1)) / 2 ELSE a END AS a, CASE WHEN n > 1 THEN (b + (sb - b) / (n - 1)) / 2 ELSE b END AS b
          FROM l JOIN s USING (l_orderkey))
    SELECT fileId, round(exp(a) / (exp(a) + exp(b)), 6) AS p0 FROM m""")
def sibling_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("d") + 0.01) / 0.12
    rows = B.shipments(spark, sf_dir).select("fileId", "itemKey", F.array(p, 1 - p).alias("proba"))
    return scoring.pool_siblings(rows, 2).select("fileId", F.round(F.col("proba")[0], 6).alias("p0"))


@query("""WITH x AS (SELECT l_orderkey, (l_discount + 0.01) / 0.12 AS p FROM lineitem),
    s AS (SELECT l_orderkey, count(*) AS n, avg(ln(least(greatest(p, 1e-9), 1.0))) AS a, avg(ln(least(greatest(1 - p, 1e-9), 1.0))) AS b FROM x GROUP BY 1)
    SELECT CAST(l_orderkey AS VARCHAR) AS itemKey, n AS photos, round(exp(a) / (exp(a) + exp(b)), 6) AS p0 FROM s""")
def item_geomean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("d") + 0.01) / 0.12
    rows = B.shipments(spark, sf_dir).select("itemKey", F.array(p, 1 - p).alias("proba"))
    return scoring.item_geomean(rows, 2).select("itemKey", "photos", F.round(F.col("proba")[0], 6).alias("p0"))


@query("""WITH z AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) + embedding[2] AS a, 2 * CAST(embedding[3] AS DOUBLE) + 0.1 AS b, CAST(embedding[4] AS DOUBLE) - embedding[5] AS c FROM embeddings),
    e AS (SELECT vec_id, exp(a) AS a, exp(b) AS b, exp(c) AS c FROM z)
    SELECT vec_id, round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1,
        CASE WHEN a >= b AND a >= c THEN 'x' WHEN b >= c THEN 'y' ELSE 'z' END AS top FROM e""")
def linear_head_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = np.zeros((3, 64))
    head[0, :2], head[1, 2], head[2, 3], head[2, 4] = 1, 2, 1, -1
    scored = scoring.linear_scores(B.table(spark, sf_dir, "embeddings"), head, np.array([0, 0.1, 0]), emb="embedding")
    p = F.col("proba")
    return scored.select("vec_id", F.round(p[0], 6).alias("p0"), F.round(p[1], 6).alias("p1"), scoring.top_class(p, ["x", "y", "z"]).alias("top"))


@query("""SELECT fileId, p[1] AS first, round(p[1] - p[2], 6) AS margin FROM (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fileId,
        list_reverse_sort([l_discount, l_tax, 0.3 - l_discount - l_tax]) AS p FROM lineitem)""")
def top3_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = B.table(spark, sf_dir, "lineitem")
    p = F.array("l_discount", "l_tax", 0.3 - F.col("l_discount") - F.col("l_tax"))
    rows = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("fileId"), p.alias("p"))
    top = scoring.top_three(F.col("p"), ["a", "b", "c"])
    return rows.select("fileId", top[0]["p"].alias("first"), F.round(scoring.margin(F.col("p")), 6).alias("margin"))


# --- evaluation

PAIRS = """x AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fileId, l_returnflag AS t,
    CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity > 25 THEN 'A' ELSE 'R' END AS p, l_tax * 10 AS conf,
    CAST(year(l_shipdate) AS VARCHAR) AS run FROM lineitem)"""
REPORT = f"""{PAIRS}, c AS (SELECT DISTINCT t AS cls FROM x UNION SELECT DISTINCT p FROM x), r AS (
    SELECT cls, (SELECT count(*) FROM x WHERE t = cls) AS support, (SELECT count(*) FROM x WHERE p = cls) AS g,
    (SELECT count(*) FROM x WHERE t = cls AND p = cls) AS h FROM c)"""


@query(f"WITH {PAIRS} SELECT t AS true, p AS pred, count(*) AS n FROM x GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(B.shipments(spark, sf_dir))


@query(f"""WITH {REPORT} SELECT cls, round(CASE WHEN g = 0 THEN 0 ELSE h / g END, 6) AS precision, round(CASE WHEN support = 0 THEN 0 ELSE h / support END, 6) AS recall,
    round(2 * h / (support + g), 6) AS f1, support FROM r""")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.class_report(B.shipments(spark, sf_dir))
    return rows.select("cls", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"""WITH {REPORT} SELECT round(sum(h) / sum(support), 6) AS top1, round(avg(2 * h / (support + g)) FILTER (support > 0), 6) AS macroF1,
    count(*) FILTER (support > 0) AS classes, count(*) FILTER (support = 0) AS ghosts, CAST(sum(support) AS BIGINT) AS support FROM r""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = evaluation.run_metrics(evaluation.class_report(B.shipments(spark, sf_dir)))
    return row.select(F.round("top1", 6).alias("top1"), F.round("macroF1", 6).alias("macroF1"), "classes", "ghosts", "support")


@query(f"""WITH {PAIRS}, s AS (SELECT conf, count(*) AS n, count(*) FILTER (t = p) AS g FROM x GROUP BY conf),
    c AS (SELECT sum(n) OVER (ORDER BY conf DESC) AS acc, sum(g) OVER (ORDER BY conf DESC) AS hit FROM s)
    SELECT (SELECT count(*) FROM x) AS total, CAST(coalesce(max(acc), 0) AS BIGINT) AS covered, coalesce(max(acc), 0) / (SELECT count(*) FROM x) AS coverage
    FROM c WHERE hit / acc >= 0.33""")
def coverage_at_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.shipments(spark, sf_dir).select("conf", (F.col("true") == F.col("pred")).alias("correct"))
    return evaluation.coverage_at_precision(rows, bar=0.33)


@query(f"""WITH {PAIRS}, t AS (SELECT unnest([0.1, 0.2, 0.4, 0.6]) AS threshold)
    SELECT CAST(threshold AS DOUBLE) AS threshold, round(count(*) FILTER (conf >= threshold) / count(*), 3) AS coverage,
        round(count(*) FILTER (conf >= threshold AND t = p) / count(*) FILTER (conf >= threshold), 3) AS accuracy, count(*) FILTER (conf >= threshold) AS n
    FROM x, t GROUP BY threshold""".replace("AND t = p", "AND x.t = x.p"))
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.shipments(spark, sf_dir).select("conf", (F.col("true") == F.col("pred")).alias("correct"))
    return evaluation.threshold_curve(rows, thresholds=(0.1, 0.2, 0.4, 0.6))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS fileId, o_orderpriority AS cls FROM orders
    WHERE o_totalprice > 200000 AND o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def fair_exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders").withColumn("fileId", F.col("o_orderkey").cast("string"))
    part = lambda test: F.when(test, F.lit("test")).otherwise(F.lit("train")).alias("part")
    candidate = o.select("fileId", part(F.col("o_totalprice") > 200_000), F.col("o_orderpriority").alias("cls"))
    baseline = o.select("fileId", part(F.col("o_orderstatus") != "F"), F.col("o_orderpriority").alias("cls"))
    known = o.filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderpriority").alias("cls")).distinct()
    rich = B.table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    return evaluation.fair_exam(candidate, baseline, known, o.join(rich, o["o_custkey"] == rich["c_custkey"], "left_semi"))


@query("""SELECT count(*) AS candidateTest, count(*) FILTER (o_orderstatus = 'F') AS candidateTestInBaselineTrain FROM orders WHERE o_totalprice > 200000""")
def exam_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders").withColumn("fileId", F.col("o_orderkey").cast("string"))
    part = lambda test: F.when(test, F.lit("test")).otherwise(F.lit("train")).alias("part")
    return evaluation.exam_leakage(o.select("fileId", part(F.col("o_totalprice") > 200_000)), o.select("fileId", part(F.col("o_orderstatus") != "F")))


@query(f"""WITH {PAIRS}, y AS (SELECT *, CASE WHEN conf > 0.4 THEN t ELSE p END AS q FROM x),
    c AS (SELECT unnest(['A', 'N', 'R']) AS cls), r AS (SELECT cls, (SELECT count(*) FROM y WHERE t = cls) AS s,
        (SELECT count(*) FROM y WHERE p = cls) AS gp, (SELECT count(*) FROM y WHERE q = cls) AS gq,
        (SELECT count(*) FROM y WHERE t = cls AND p = cls) AS hp, (SELECT count(*) FROM y WHERE t = cls AND q = cls) AS hq FROM c)
    SELECT true AS promote, CAST(0 AS INTEGER) AS reasons, CAST(sum(s) AS BIGINT) AS n, round(sum(hq) / sum(s), 6) AS candidateTop1, round(sum(hp) / sum(s), 6) AS baselineTop1 FROM r""")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    better = F.when(F.col("conf") > 0.4, F.col("true")).otherwise(F.col("pred"))
    exam = B.shipments(spark, sf_dir).select("true", better.alias("candidate"), F.col("pred").alias("baseline"))
    row = evaluation.verdict(exam)
    return row.select("promote", F.size("reasons").alias("reasons"), "n", F.round("candidateTop1", 6).alias("candidateTop1"), F.round("baselineTop1", 6).alias("baselineTop1"))


@query(f"""WITH {PAIRS}, y AS (SELECT conf AS s, (t = p)::INT AS y FROM x), g AS (SELECT s, sum(y) AS p, sum(1 - y) AS q FROM y GROUP BY s),
    c AS (SELECT *, sum(q) OVER (ORDER BY s) AS qq, sum(p) OVER (ORDER BY s DESC) AS pp, sum(p + q) OVER (ORDER BY s DESC) AS nn FROM g)
    SELECT round(sum(p * (qq - q / 2)) / (sum(p) * sum(q)), 6) AS auc, round(sum(p * pp / nn) / sum(p), 6) AS ap FROM c""")
def auc_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.shipments(spark, sf_dir).select(F.col("conf").alias("score"), (F.col("true") == F.col("pred")).cast("int").alias("y"))
    both = evaluation.roc_auc(rows).crossJoin(evaluation.average_precision(rows))  # one row each
    return both.select(F.round("auc", 6).alias("auc"), F.round("ap", 6).alias("ap"))


@query(f"""WITH {PAIRS}, e AS (SELECT DISTINCT run, t, p FROM x WHERE t <> p) SELECT t AS true, p AS pred, count(*) AS runs FROM e GROUP BY ALL HAVING count(*) >= 2""")
def recurring_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.recurring_confusions(B.shipments(spark, sf_dir).filter(F.col("true") != F.col("pred")))


@query(f"""WITH {PAIRS}, s AS (SELECT run, count(*) AS support, round(count(*) FILTER (t = p) / count(*), 6) AS top1 FROM x GROUP BY run)
    SELECT run, support, top1, round(top1 - lag(top1) OVER (ORDER BY run), 4) AS delta FROM s""")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = evaluation.class_report(B.shipments(spark, sf_dir), by=["run"])
    runs = evaluation.run_metrics(report, ["run"]).select("run", F.col("run").alias("finished"), F.round("top1", 6).alias("top1"), "support")
    return journal.run_history(runs, report).select("run", "support", "top1", "delta")


@query("""WITH x AS (SELECT quality AS a, toxic AS b FROM labels)
    SELECT count(*) AS total, count(*) AS pair, count(*) FILTER (a = b) AS agree, CAST(0 AS BIGINT) AS one_sided, CAST(0 AS BIGINT) AS unlabelled,
    round(count(*) FILTER (a = b) / count(*), 3) AS ceiling FROM x""")
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda c: B.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("fileId"), F.col(c).cast("string").alias("cls"))
    return A.label_summary(A.label_pairs(side("quality"), side("toxic")))


@query("""WITH x AS (SELECT CAST(quality AS VARCHAR) AS a, CAST(toxic AS VARCHAR) AS b FROM labels), e AS (
        SELECT a AS cls, a = b AS same FROM x UNION ALL SELECT b, false FROM x WHERE a <> b)
    SELECT cls, count(*) AS n, count(*) FILTER (same) AS agree, round(count(*) FILTER (same) / count(*), 3) AS rate, count(*) >= 30 AS gated FROM e GROUP BY cls""")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda c: B.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("fileId"), F.col(c).cast("string").alias("cls"))
    return A.label_agreement(A.label_pairs(side("quality"), side("toxic")))


# --- mining

TERMS = """w AS (SELECT p_name AS title, count(*) AS photos FROM part GROUP BY 1),
    r AS (SELECT title, photos, unnest(regexp_extract_all(title, '[a-z]+')) AS run FROM w),
    k AS (SELECT DISTINCT title, photos, substr(run, CAST(i AS INTEGER), CAST(n AS INTEGER)) AS term FROM r, range(1, 40) AS s(i), range(2, 5) AS z(n) WHERE i + n - 1 <= length(run))"""


def _part_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelling.title_counts(B.table(spark, sf_dir, "part").withColumnRenamed("p_name", "title"))


@query(f"WITH {TERMS} SELECT term, CAST(sum(photos) AS BIGINT) AS photos FROM k GROUP BY term")
def term_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.term_support(_part_titles(spark, sf_dir), "[a-z]+")


@query(f"""WITH {TERMS}, u AS (SELECT term, sum(photos) AS photos FROM k WHERE title LIKE '%ring%' GROUP BY 1), c AS (SELECT term, sum(photos) AS claimed FROM k WHERE title NOT LIKE '%ring%' GROUP BY 1)
    SELECT term, CAST(photos AS BIGINT) AS photos, CAST(coalesce(claimed, 0) AS BIGINT) AS claimed FROM u LEFT JOIN c USING (term) WHERE photos >= 3 AND photos / (photos + coalesce(claimed, 0)) >= 0.9""")
def term_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _part_titles(spark, sf_dir)
    return mining.term_purity(titles.filter("title like '%ring%'"), titles.filter("title not like '%ring%'"), min_photos=3, run="[a-z]+")


@query()
def greedy_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _part_titles(spark, sf_dir)
    return mining.cover_titles(titles.filter("title like '%ring%'"), titles.filter("title not like '%ring%'"), min_photos=3, run="[a-z]+", top=5)


# --- pool, de-identification, routing


@query("""SELECT CAST(doc_id AS VARCHAR) AS fileId, strftime(DATE '2024-01-01' + CAST(n_chars % 365 AS INTEGER), '%Y-%m-%d') AS reportDate
    FROM documents WHERE n_chars >= 100 AND source <> 'src3'
    AND strftime(DATE '2024-01-01' + CAST(n_chars % 365 AS INTEGER), '%Y-%m-%d') <= '2024-10-01'""")
def pool_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.valid_pool(B.manifest(spark, sf_dir), B.LANGUAGE_RULES, today="2024-10-01").select("fileId", "reportDate")


@query("""SELECT CASE WHEN regexp_full_match(text_key, '[A-Za-z0-9][A-Za-z0-9_-]{0,127}') THEN 'not in pool' ELSE 'malformed' END AS problem, count(*) AS n
    FROM (SELECT DISTINCT url AS text_key FROM pages UNION SELECT DISTINCT 'x' || page_id FROM pages) GROUP BY 1""")
def photo_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = B.table(spark, sf_dir, "pages")
    wanted = pages.select(F.col("url").alias("fileId")).union(pages.select(F.concat(F.lit("x"), F.col("page_id").cast("string"))))
    found = pool.photo_problems(wanted, B.manifest(spark, sf_dir))
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT source AS constrId, 'site-' || lpad(CAST(row_number() OVER (ORDER BY source) AS VARCHAR), 3, '0') AS siteBucket FROM (SELECT DISTINCT source FROM documents)""")
def site_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deident.site_buckets(B.manifest(spark, sf_dir))


@query("SELECT substr(sha256('pepper:' || CAST(doc_id AS VARCHAR)), 1, 16) AS sampleId, n_chars FROM documents")
def salted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.manifest(spark, sf_dir)
    return rows.select(deident.salted_id(F.col("fileId"), "pepper").alias("sampleId"), "n_chars")


@query("SELECT c_name, row_number() OVER (ORDER BY c_name) AS rank FROM customer")
def ordered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_rank(B.table(spark, sf_dir, "customer").select("c_name"), "c_name")


ROUTE = """x AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS rule, o_orderpriority AS model, (o_totalprice % 1000) / 1000 AS conf,
        o_orderstatus AS st, o_totalprice AS price FROM orders), b AS (SELECT *, CASE WHEN st = 'P' AND price > 300000 THEN 'done'
        WHEN st = 'P' THEN 'held' WHEN price < 20000 THEN 'quarantine' WHEN rule = '5-LOW' OR conf < 0.9 THEN 'queue'
        WHEN CAST('0x' || substr(sha256(id), 1, 8) AS BIGINT) % 100 < 5 THEN 'audit' ELSE 'auto' END AS bucket FROM x)"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = B.table(spark, sf_dir, "orders"), F.col
    rows = o.select(
        c("o_orderkey").cast("string").alias("fileId"), c("o_orderpriority").alias("ruleClass"), c("o_orderpriority").alias("modelClass"),
        ((c("o_totalprice") % 1000) / 1000).alias("modelConfidence"), F.lit("model").alias("stageSource"), F.lit("2024-05-05").alias("reportDate"),
        F.when((c("o_orderstatus") == "P") & (c("o_totalprice") > 300_000), F.lit("x")).otherwise(F.lit("")).alias("humanClass"),
        F.when(c("o_orderstatus") == "P", F.lit("excluded")).otherwise(F.lit("")).alias("reviewState"), (c("o_totalprice") >= 20_000).alias("hasPhoto"),
    )
    known = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    return routing.route(rows, known, today=B.TODAY)


@query(f"WITH {ROUTE} SELECT id AS fileId, bucket FROM b")
def route_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("fileId", "bucket")


@query(f"WITH {ROUTE} SELECT bucket, count(*) AS photos FROM b GROUP BY bucket")
def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.bucket_counts(_routed(spark, sf_dir))


@query(f"""WITH {ROUTE} SELECT count(*) AS sampled, count(*) FILTER (st = 'F') AS reviewed, count(*) FILTER (st = 'F' AND rule = '2-HIGH') AS agree,
    round(count(*) FILTER (st = 'F' AND rule = '2-HIGH') / nullif(count(*) FILTER (st = 'F'), 0), 4) AS precision FROM b WHERE bucket = 'audit'""")
def audit_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "fileId string")
    recorded = routing.first_audits(_routed(spark, sf_dir), none, "v1", "2024-06-01")
    o = B.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    human = o.select(F.col("o_orderkey").cast("string").alias("fileId"), F.lit("2-HIGH").alias("cls"))
    return routing.audit_precision(recorded, human)


@query("SELECT l_partkey, max_by(l_quantity, l_orderkey * 10 + l_linenumber) AS quantity FROM lineitem GROUP BY l_partkey")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = B.table(spark, sf_dir, "lineitem").withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return latest_by(li.select("l_partkey", "o", F.col("l_quantity").alias("quantity")), ["l_partkey"], "o").select("l_partkey", "quantity")


# --- streaming


@query("SELECT event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_feedback_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is delivered twice; each is taken once."""
    one, two = (feeds.file_stream(spark, sf_dir, "events.parquet") for _ in range(2))
    rows = feeds.drained(feeds.once_only(one.unionByName(two), late="60 days"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = feeds.file_stream(spark, sf_dir, "events.parquet").select("user_id", "event_type", "event_id", "value")
    return feeds.drained(feeds.latest_state(stream, ["user_id", "event_type"], "event_id"), ["user_id", "event_type"])


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.drained(feeds.rates(feeds.file_stream(spark, sf_dir, "events.parquet")), ["start", "event_type"])
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("total", 4).alias("total"))


@query("SELECT e.event_id, e.user_id FROM events e WHERE e.user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def stream_known_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = lambda: B.table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    stream = feeds.file_stream(spark, sf_dir, "events.parquet").select("event_id", "user_id")
    return feeds.drained(feeds.accepted(stream, known, "user_id")).select("event_id", "user_id")
