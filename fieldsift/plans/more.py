"""Further queries: parsing, paging, agreement on boxes, pack rows, per-site scores, training (rows only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsift import fixed_values as V
from fieldsift.operators import agreement, checks, deident, detection, evaluation, hints, journal, merge, neighbours, pool, routing, sampling, splitting, standards, training
from fieldsift.plans import bindings as B
from fieldsift.plans.catalogue import MANIFEST, PAIRS, ROUTE, _routed, query
from fieldsift.session import scratch_path
from fieldsift.sources import sectioned, sinks


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectioned text made of the tables: an order opens a document, its line items are the entries."""
    o, li = B.table(spark, sf_dir, "orders"), B.table(spark, sf_dir, "lineitem")
    key = F.col("o_orderkey").cast("string")
    head = o.select(key.alias("file"), F.lit(-1).cast("long").alias("pos"), F.concat_ws("\t", F.lit("#DOC"), key, F.lit("iso"), "o_orderpriority").alias("text"))
    status = F.when(F.col("l_returnflag") == "N", F.lit("R")).when(F.col("l_returnflag") == "A", F.lit("O")).otherwise(F.lit("X"))
    entry = F.concat_ws("\t", F.concat_ws(".", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")), status, "l_linestatus")
    pos = F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")
    body = li.select(F.col("l_orderkey").cast("string").alias("file"), pos.cast("long").alias("pos"), entry.alias("text"))
    return head.unionByName(body.join(o.select(key.alias("file")), "file", "left_semi")).withColumn("block", F.lit(0).cast("long"))


ENTRY = "concat_ws('.', l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER))"


@query(f"""SELECT CAST(l_orderkey AS VARCHAR) AS docNo, {ENTRY} AS itemNo, CASE l_returnflag WHEN 'N' THEN 'R' ELSE 'O' END AS status, l_linestatus AS name
    FROM lineitem WHERE l_returnflag <> 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders)""")
def doc_tsv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sectioned.parse_standards(_order_lines(spark, sf_dir)).rows.select("docNo", "itemNo", "status", "name")


@query("""SELECT 'status is neither O nor R' AS problem, count(*) AS lines FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders)""")
def doc_tsv_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sectioned.parse_standards(_order_lines(spark, sf_dir)).problems
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT 4 AS depth, status, count(*) AS items FROM (SELECT CASE l_returnflag WHEN 'N' THEN 'R' ELSE 'O' END AS status FROM lineitem WHERE l_returnflag <> 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders)) GROUP BY status")
def item_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = standards.describe_items(sectioned.parse_standards(_order_lines(spark, sf_dir)).rows)
    return items.groupBy("depth", "status").agg(F.count(F.lit(1)).alias("items"))


@query("""SELECT CASE WHEN m % 3 = 0 THEN 'x' || d WHEN m % 3 = 1 THEN '2099-' || d ELSE '' END AS day,
    CASE WHEN m % 3 = 1 THEN '日報日期在未來' ELSE '日報日期無法解析' END AS why, count(*) AS n
    FROM (SELECT month(o_orderdate) AS m, strftime(o_orderdate, '%m-%d') AS d FROM orders) GROUP BY 1, 2""")
def bad_date_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders")
    d, kind = F.date_format("o_orderdate", "MM-dd"), F.month("o_orderdate") % 3
    day = F.when(kind == 0, F.concat(F.lit("x"), d)).when(kind == 1, F.concat(F.lit("2099-"), d)).otherwise(F.lit(""))
    rows = o.select(day.alias("day")).withColumn("why", pool.bad_date(F.col("day"), B.TODAY))
    return rows.groupBy("day", "why").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {MANIFEST} SELECT fileId, reportDate FROM m WHERE lang = 'en' AND contains(title, 'th') ORDER BY reportDate DESC, fileId LIMIT 50 OFFSET 50")
def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pool.list_view(B.manifest(spark, sf_dir), equals={"lang": "en"}, search="th", page=2, page_size=50)
    return rows.select("fileId", "reportDate")


@query(f"""WITH {ROUTE}, w AS (SELECT unnest(CASE bucket WHEN 'quarantine' THEN ['{V.REASON_NO_PHOTO}'] WHEN 'audit' THEN ['{V.REASON_AUDIT}']
        ELSE list_filter([CASE WHEN rule = '5-LOW' THEN '{V.REASON_UNTRAINED}' END, CASE WHEN conf < 0.9 THEN '{V.REASON_LOW}' END], lambda x: x IS NOT NULL) END) AS reason
    FROM b WHERE bucket IN ('queue', 'audit', 'quarantine')) SELECT reason, count(*) AS photos FROM w GROUP BY reason""")
def open_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.open_reasons(_routed(spark, sf_dir))


@query("""WITH l AS (SELECT c_custkey AS k FROM customer), r AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
    SELECT coalesce(l.k, r.k) AS k, CASE WHEN r.k IS NULL THEN 'missing' WHEN l.k IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem
    FROM l FULL JOIN r USING (k) WHERE r.k IS NULL OR l.k IS NULL OR r.n > 1""")
def set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return merge.set_differences(left, B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def missing_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = B.table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return merge.missing_artefacts(B.table(spark, sf_dir, "part").select("p_partkey"), have.distinct(), "p_partkey")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two annotators' boxes on each order: one from the quantity of a line, one from its discount and tax."""
    li = B.table(spark, sf_dir, "lineitem").withColumn("seq", F.col("l_linenumber") * 10_000_000 + F.col("l_partkey"))
    a, b = F.col("l_quantity").cast("int") * 5, (F.col("l_discount") * 1000 + F.col("l_tax") * 1000).cast("int")
    text = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    # as format_string writes it, in half the time
    box = lambda x: F.concat(F.lit("[["), F.array_join(F.array(*map(text, (x, x, x + 300, x + 300))), ", "), F.lit("]]"))
    one = lambda name, x: li.select(F.col("l_orderkey").cast("string").alias("fileId"), F.lit(name).alias("source"), F.lit("t").alias("defectType"), box(x).alias("box"), "seq")
    return one("a", a).unionByName(one("b", b))


@query("""WITH x AS (SELECT l_orderkey AS f, l_linenumber * 10000000 + l_partkey AS s, CAST(l_quantity AS INTEGER) * 5 AS a, CAST(trunc(l_discount * 1000 + l_tax * 1000) AS INTEGER) AS b FROM lineitem),
    p AS (SELECT x.f, x.s AS i, y.s AS j, greatest(300 - abs(x.a - y.b), 0) AS w FROM x JOIN x y ON x.f = y.f)
    SELECT CAST(f AS VARCHAR) AS fileId, i, j, round(w * w / (180000.0 - w * w), 6) AS iou FROM p WHERE w * w / (180000.0 - w * w) >= 0.5""")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir)
    found = agreement.close_pairs(agreement.numbered_boxes(rows, "a"), agreement.numbered_boxes(rows, "b"), crowded=agreement.crowded_photos(rows, "a", "b"))
    return found.select("fileId", F.col("i.__o").alias("i"), F.col("j.__o").alias("j"), F.round("iou", 6).alias("iou"))


@query()
def box_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.box_pairs(_boxes(spark, sf_dir), "a", "b").groupBy("kind").agg(F.count(F.lit(1)).alias("boxes"))


JUDGED = f"""WITH {MANIFEST}, r AS (SELECT fileId, site, reportDate, CASE WHEN length(title) < 8 OR title IN ('The.', 'Le.') THEN ''
            WHEN regexp_matches(title, ' und | der | die |Der |Die ') THEN 'german' WHEN regexp_matches(title, ' the | of | and |The |Of ') THEN 'english'
            WHEN regexp_matches(title, ' les | des | le |Le |Les ') THEN 'french' WHEN regexp_matches(title, ' el | del | y |El |Del ') THEN 'spanish'
            ELSE 'other' END AS rule FROM (SELECT * REPLACE (trim(title) AS title) FROM m)),
    n AS (SELECT source AS site, 'site-' || lpad(CAST(row_number() OVER (ORDER BY source) AS VARCHAR), 3, '0') AS siteBucket FROM (SELECT DISTINCT source FROM documents))
    SELECT substr(sha256('pepper:' || fileId), 1, 16) AS sampleId, siteBucket, substr(reportDate, 1, 7) AS yearMonth, cls AS humanClass, rule AS ruleClass,
        CASE WHEN rule <> '' AND rule <> cls THEN '1' ELSE '0' END AS humanOverrode, '0' AS hasBox
    FROM said JOIN r USING (fileId) JOIN n USING (site)"""


@query(JUDGED)
def deident_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, none = B.manifest(spark, sf_dir), spark.createDataFrame([], "fileId string")
    allowed = deident.taxonomy(B.LANGUAGE_RULES, spark.createDataFrame([], "label string"))
    human = B.language_verdicts(spark, sf_dir)
    return deident.judgements(human, none, rows, B.LANGUAGE_RULES, deident.site_buckets(rows), allowed, "pepper")[0]


@query(f"""WITH {PAIRS}, y AS (SELECT run AS site, conf AS s, (t = p)::INT AS y FROM x), g AS (SELECT site, s, sum(y) AS p, sum(1 - y) AS q FROM y GROUP BY ALL),
    c AS (SELECT *, sum(q) OVER (PARTITION BY site ORDER BY s) AS qq FROM g)
    SELECT site, CAST(sum(p + q) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS pos, round(sum(p * (qq - q / 2)) / (sum(p) * sum(q)), 6) AS auc FROM c
    GROUP BY site HAVING sum(p) >= 5 AND sum(q) > 0""")
def site_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.shipments(spark, sf_dir).select(F.col("run").alias("site"), F.col("conf").alias("score"), (F.col("true") == F.col("pred")).cast("int").alias("y"))
    return evaluation.site_auc(rows).withColumn("auc", F.round("auc", 6))


@query(f"""WITH {PAIRS}, r AS (SELECT (t = p)::INT AS y, row_number() OVER (ORDER BY conf DESC, fileId) AS n FROM x)
    SELECT CAST(k AS INTEGER) AS k, round(avg(y), 3) AS precision FROM r, (SELECT unnest([50, 100, 200]) AS k) WHERE n <= k GROUP BY k""")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.shipments(spark, sf_dir).select("fileId", F.col("conf").alias("score"), (F.col("true") == F.col("pred")).cast("int").alias("y"))
    return evaluation.precision_at(rows)


@query(f"""WITH {PAIRS}, c AS (SELECT DISTINCT run, t AS cls FROM x), f AS (SELECT run, cls, (SELECT count(*) FROM x WHERE x.run = c.run AND t = cls) AS s,
        (SELECT count(*) FROM x WHERE x.run = c.run AND p = cls) AS g, (SELECT count(*) FROM x WHERE x.run = c.run AND t = cls AND p = cls) AS h FROM c),
    v AS (SELECT run, cls, 2 * h / (s + g) AS f1 FROM f)
    SELECT a.cls, round(a.f1 - b.f1, 6) AS delta FROM v a JOIN v b ON a.cls = b.cls AND a.run = '1998' AND b.run = '1997' WHERE abs(a.f1 - b.f1) >= 0.005""")
def class_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = evaluation.class_report(B.shipments(spark, sf_dir), by=["run"])
    found = journal.class_delta(report.filter("run = '1998'"), report.filter("run = '1997'"))
    return found.select("cls", F.round("delta", 6).alias("delta"))


@query()
def even_over_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.even_over_groups(B.manifest(spark, sf_dir).select("fileId", F.col("constrId").alias("group")), 90)


@query()
def group_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splitting.train_val_groups(B.site_days(spark, sf_dir), "constrId", 0.1)
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("photos"), F.count_distinct("constrId").alias("groups"))


# --- training: iterative fits, so only rows and shape are checked


def _probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").cast("string").alias("fileId"), F.col("embedding").alias("emb"), F.col("label").cast("string").alias("cls"),
        (F.col("vec_id") % 23).cast("string").alias("site"), F.concat_ws("|", F.col("vec_id") % 101, "label").alias("itemKey"),
        (F.col("label") == 0).cast("int").alias("defect"),
    )


@query()
def oof_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _probe_rows(spark, sf_dir)
    scored, _ = training.out_of_fold(rows, splitting.group_folds(rows, "site"), group="site")
    return scored.select("fileId", "cls", "fold", F.array_max("proba").alias("best"))


@query()
def tune_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.tune_c(_probe_rows(spark, sf_dir), group="site")


@query()
def defect_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.rank_defects(_probe_rows(spark, sf_dir), group="site")[0]


@query()
def defect_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.rank_defects(_probe_rows(spark, sf_dir), group="site")[1]


# --- box sizes


@query("""WITH b AS (SELECT CAST(l_quantity AS INTEGER) * 7 AS dx, 10 + l_linenumber * 37 AS dy, 800 + l_suppkey % 9 * 100 AS w, 600 + l_partkey % 7 * 111 AS h FROM lineitem),
    p AS (SELECT side, least(dx / 1000.0 * w * side / greatest(w, h), dy / 1000.0 * h * side / greatest(w, h)) AS px FROM b, (SELECT unnest([640, 1280]) AS side)),
    r AS (SELECT side, count(*) AS boxes, round(quantile_cont(px, 0.5), 1) AS median_px, round(quantile_cont(px, 0.1), 1) AS p10_px, round(avg((px < 8)::INT), 3) AS lt8, round(avg((px < 16)::INT), 3) AS lt16 FROM p GROUP BY side)
    SELECT *, lt16 < 0.05 AS usable FROM r""")
def pixel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = B.table(spark, sf_dir, "lineitem")
    whole = lambda c: c.cast("int")
    boxes = li.select(
        F.lit(0).alias("x0"), F.lit(0).alias("y0"), (whole(F.col("l_quantity")) * 7).alias("x1"), (10 + F.col("l_linenumber") * 37).alias("y1"),
        (800 + F.col("l_suppkey") % 9 * 100).alias("w"), (600 + F.col("l_partkey") % 7 * 111).alias("h"),
    )
    return detection.pixel_report(boxes)


# --- near-duplicates among embeddings


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label % 2 AS part FROM embeddings),
    v AS (SELECT vec_id AS id, x, part FROM e UNION ALL SELECT vec_id + 2000000000, x, 1 - part FROM e WHERE vec_id % 9 = 0
        UNION ALL SELECT vec_id + 1000000000, list_transform(x, lambda y, i: CASE WHEN (i - 1 + vec_id) % 4 = 0 THEN CAST(CAST(y * (1 + (vec_id % 11) * 0.06) AS FLOAT) AS DOUBLE) ELSE y END), (vec_id // 5) % 2 FROM e WHERE vec_id % 5 = 0),
    f AS (SELECT x, min(id) AS id, arg_min(part, id) AS part FROM v GROUP BY x),
    p AS (SELECT f.id AS a, v.id AS b, 1.0 AS cosine, f.part <> v.part AS "crossPart" FROM v JOIN f USING (x) WHERE v.id <> f.id
        UNION ALL SELECT a.id, b.id, list_cosine_similarity(a.x, b.x), a.part <> b.part FROM f a JOIN f b ON a.id < b.id WHERE list_cosine_similarity(a.x, b.x) > 0.98)
    SELECT a, b, round(cosine, 6) AS cosine, "crossPart" FROM p""")
def embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings with some copied and some slightly changed, in two parts."""
    e = B.table(spark, sf_dir, "embeddings").withColumn("part", F.col("label") % 2)
    own = lambda more, emb, part: [(F.col("vec_id") + more).alias("fileId"), emb.alias("emb"), part.cast("int").alias("part")]
    factor = 1 + (F.col("vec_id") % 11) * 0.06
    changed = F.transform("embedding", lambda y, i: F.when((i + F.col("vec_id")) % 4 == 0, (y * factor).cast("float")).otherwise(y))
    rows = e.select(*own(0, F.col("embedding"), F.col("part")))
    rows = rows.unionByName(e.filter("vec_id % 9 = 0").select(*own(2_000_000_000, F.col("embedding"), 1 - F.col("part"))))
    rows = rows.unionByName(e.filter("vec_id % 5 = 0").select(*own(1_000_000_000, changed, F.floor(F.col("vec_id") / 5) % 2)))
    return neighbours.near_duplicates(rows).withColumn("cosine", F.round("cosine", 6))


def _hints(spark: SparkSession, sf_dir: str, visits: int | None = None) -> DataFrame:
    rows = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fileId"), F.col("embedding").alias("emb"), F.col("label").alias("cls"))
    return hints.neighbour_hints(rows, rows.filter("fileId % 50 = 0"), visits=visits).withColumn("cosine", F.round("cosine", 6))


@query()
def neighbour_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index as it is used; its recall is tested against all pairs."""
    return _hints(spark, sf_dir)


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
    p AS (SELECT q.vec_id AS "fileId", e.vec_id AS near, round(list_cosine_similarity(q.x, e.x), 12) AS c, e.label AS cls FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "fileId" ORDER BY c DESC, near) AS INTEGER) AS rank FROM p)
    SELECT "fileId", rank, near, round(c, 6) AS cosine, cls FROM r WHERE rank <= 5""")
def neighbour_hints_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell visited."""
    return _hints(spark, sf_dir, visits=hints.MOST_CELLS)


# --- the published pack


def _published(spark: SparkSession, sf_dir: str) -> str:
    """A pack of the language verdicts, of a box a line item and of a criterion a part; returns its folder."""
    li, part = B.table(spark, sf_dir, "lineitem"), B.table(spark, sf_dir, "part")
    at, pattern = F.col("l_quantity").cast("int") * 5, F.array(*[F.lit(x) for x in V.DEFECT_PATTERNS])
    defects = li.select(
        F.col("l_orderkey").cast("string").alias("fileId"), F.lit("human").alias("source"), pattern[F.col("l_linenumber") % len(V.DEFECT_PATTERNS)].alias("defectType"),
        F.format_string("[[%d, 0, %d, 300]]", at, at + 300).alias("box"), F.concat(F.lit("QS"), F.lpad((F.col("l_suppkey") % 10000).cast("string"), 4, "0")).alias("qsCode"),
    )
    items = part.select(
        F.concat(F.lit("QS0101-"), "p_partkey").alias("itemKey"), F.lit("A").alias("kind"), F.lit("R").alias("status"),
        (F.col("p_size") % 2 == 0).alias("billing"), (F.col("p_size") % 3 == 0).alias("penalty"), F.lit(False).alias("contract"),
    )
    tables = {"judgements": deident_judgements(spark, sf_dir), "defect_boxes": deident.defect_box_rows(defects, "pepper")[0], "qs_criteria": deident.criteria_rows(items)}
    allowed = {"taxonomy": [*B.LANGUAGE_RULES.labels(), B.LANGUAGE_RULES.fallback], "defectPattern": [*V.DEFECT_PATTERNS, *V.DEFECT_BUTTON_ONLY]}
    path = scratch_path(spark, "pack")
    sinks.publish_pack(tables, allowed, path, version="p1", boundary="what may leave")
    return path


@query(f"""WITH j AS ({JUDGED}) SELECT (SELECT count(*) FROM j) AS judgements, (SELECT count(*) FROM lineitem) AS defect_boxes, (SELECT count(*) FROM part) AS qs_criteria,
    (SELECT count(*) FROM j WHERE "ruleClass" = '') AS silent, (SELECT count(*) FROM j WHERE "ruleClass" <> '' AND "humanOverrode" = '0') AS agree,
    (SELECT count(*) FROM j WHERE "humanOverrode" = '1') AS overridden, 'internal-only' AS distribution, sha256('what may leave') AS boundary""")
def pack_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = sinks.pack_manifest(spark, _published(spark, sf_dir))
    of = F.col("judgementBreakdown")
    return said.select(*[F.col("counts")[t].alias(t) for t in V.PACK_TABLES], of["ruleSilent"].alias("silent"), of["agree"].alias("agree"), of["overridden"].alias("overridden"), "distribution", F.col("boundarySha256").alias("boundary"))


@query("""SELECT substr(sha256('pepper:' || l_orderkey), 1, 16) AS "sampleId", 'QS' || lpad(CAST(l_suppkey % 10000 AS VARCHAR), 4, '0') AS "qsCode", 'human' AS source,
    '[' || q || ', 0, ' || (q + 300) || ', 300]' AS box FROM (SELECT *, CAST(l_quantity AS INTEGER) * 5 AS q FROM lineitem)""")
def pack_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.read_pack(spark, _published(spark, sf_dir))["defect_boxes"].select("sampleId", "qsCode", "source", "box")


# --- integrity checks


@query(f"""WITH i AS (SELECT CAST(l_orderkey AS VARCHAR) AS d, CAST(l_orderkey AS VARCHAR) || '-' || {ENTRY} AS k, l_returnflag = 'N' AS due FROM lineitem WHERE l_returnflag <> 'R'),
    o AS (SELECT CAST(o_orderkey AS VARCHAR) AS d, o_orderkey AS n FROM orders), s AS (SELECT d, count(*) FILTER (due) AS r FROM o LEFT JOIN i USING (d) GROUP BY d),
    m AS (SELECT 1 AS no, 'enough documents' AS c, count(*) AS n, count(*) >= 100 AS ok FROM o
        UNION ALL SELECT 2, 'document numbers are unique', 0, true UNION ALL SELECT 3, 'catalogue numbers are unique', 0, true
        UNION ALL SELECT 4, 'nothing is only listed', 0, true UNION ALL SELECT 5, 'nothing is only parsed', count(*), count(*) = 0 FROM o WHERE n % 97 = 0
        UNION ALL SELECT 6, 'document ids agree', count(*), count(*) = 0 FROM o WHERE n % 97 <> 0 AND n % 89 = 0
        UNION ALL SELECT 7, 'every document has items', count(*), count(*) = 0 FROM o WHERE d NOT IN (SELECT d FROM i)
        UNION ALL SELECT 8, 'item keys are well formed', 0, true UNION ALL SELECT 9, 'item keys are unique', count(*), count(*) = 0 FROM (SELECT k FROM i GROUP BY k HAVING count(*) > 1)
        UNION ALL SELECT 10, 'items are nested deep enough', 4, true UNION ALL SELECT 11, 'enough billing items', 0, true UNION ALL SELECT 12, 'billing items lie where they may', 0, true
        UNION ALL SELECT 13, 'enough penalty items', 0, false
        UNION ALL SELECT 14, 'fixed documents are as expected', count(*), count(*) = 0 FROM s JOIN orders ON d = CAST(o_orderkey AS VARCHAR) WHERE o_orderkey % 31 = 0 AND (r <> 2 OR o_orderpriority NOT LIKE '%H%'))
    SELECT no, c AS "check", CASE WHEN ok THEN 'pass' ELSE 'fail' END AS status, CAST(n AS VARCHAR) AS detail FROM m""")
def standards_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as standards; some are not in the catalogue, others there under another id."""
    parsed, n = sectioned.parse_standards(_order_lines(spark, sf_dir)), F.col("docNo").cast("long")
    docs, items = parsed.docs, standards.describe_items(parsed.rows)
    listed = docs.filter(n % 97 != 0).select("docNo", F.when(n % 89 == 0, F.lit("other")).otherwise(F.col("isoInfoId")).alias("id"), "name")
    fixed = docs.filter(n % 31 == 0).select("docNo", F.lit(2).cast("long").alias("required"), F.lit(None).cast("long").alias("stages"), F.lit(None).cast("string").alias("shape"), F.lit("H").alias("word"))
    return checks.check_standards(docs, items, listed, fixed, docs_least=100, depth_least=4, billing_least=0, penalty_least=1)


# --- one exam, photos alone and with their work items


@query("""WITH x AS (SELECT l_orderkey, CASE WHEN l_quantity > 25 THEN 'much' ELSE 'little' END AS t, (l_discount + 0.013) / 0.127 AS p FROM lineitem),
    l AS (SELECT *, ln(p) AS a, ln(1 - p) AS b FROM x), s AS (SELECT l_orderkey, count(*) AS n, sum(a) AS sa, sum(b) AS sb FROM l GROUP BY 1),
    m AS (SELECT t, p, CASE WHEN n > 1 THEN a + (sa - a) / (n - 1) ELSE a END AS a, CASE WHEN n > 1 THEN b + (sb - b) / (n - 1) ELSE b END AS b FROM l JOIN s USING (l_orderkey)),
    y AS (SELECT 'single' AS kind, t, CASE WHEN p >= 1 - p THEN 'much' ELSE 'little' END AS g FROM m UNION ALL SELECT 'fused', t, CASE WHEN a >= b THEN 'much' ELSE 'little' END FROM m),
    f AS (SELECT kind, c, 2 * count(*) FILTER (t = c AND g = c) / (count(*) FILTER (t = c) + count(*) FILTER (g = c)) AS f1 FROM y, (SELECT unnest(['much', 'little']) AS c) GROUP BY ALL)
    SELECT kind, round(avg((t = g)::INT), 6) AS top1, round((SELECT avg(f1) FROM f WHERE f.kind = y.kind), 6) AS "macroF1", count(*) AS support FROM y GROUP BY kind""")
def fused_and_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = (F.col("l_discount") + 0.013) / 0.127, F.col("l_orderkey").cast("string")
    rows = B.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("fileId"), key.alias("itemKey"),
        F.when(F.col("l_quantity") > 25, F.lit("much")).otherwise(F.lit("little")).alias("true"), F.array(p, 1 - p).alias("proba"),
    )
    marks = evaluation.fused_and_single(rows, ["much", "little"])
    return marks.select("kind", F.round("top1", 6).alias("top1"), F.round("macroF1", 6).alias("macroF1"), "support")


# --- contracts


def _contract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract text made of the tables: a part opens a contract of its brand, its line items are the clauses."""
    part, li = B.table(spark, sf_dir, "part"), B.table(spark, sf_dir, "lineitem")
    file = F.col("p_partkey").cast("string")
    head = F.concat_ws("\t", F.lit("#DOC"), F.lit("P"), "p_brand", "p_type", file, F.lit("work"))
    text = F.when(F.col("l_linenumber") % 4 == 0, F.lit("付款10%")).when(F.col("l_linenumber") % 4 == 1, F.lit("厚度誤差3mm以內")).when(F.col("l_linenumber") % 4 == 2, F.lit("罰款")).otherwise(F.lit("其餘"))
    body = F.concat_ws("\t", F.concat_ws(".", "l_orderkey", "l_linenumber"), F.lit("s"), text)
    pos = F.col("l_orderkey").cast("long") * 100 + F.col("l_linenumber")
    heads = part.select(file.alias("file"), F.lit(-1).cast("long").alias("pos"), head.alias("text"))
    clauses = li.join(part.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").select(F.col("l_partkey").cast("string").alias("file"), pos.alias("pos"), body.alias("text"))
    return heads.unionByName(clauses).withColumn("block", F.lit(0).cast("long"))


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standards.describe_clauses(sectioned.parse_contracts(_contract_lines(spark, sf_dir)).rows)


_CLAUSES = """c AS (SELECT p_brand AS trade, p_type AS vendor, CAST(p_partkey AS VARCHAR) AS d, l_linenumber % 4 AS k FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(f"""WITH {_CLAUSES} SELECT 'P' AS project, trade, vendor, d AS "docDate", CASE k WHEN 0 THEN 'payment' WHEN 1 THEN 'tolerance' WHEN 2 THEN 'penalty' ELSE 'other' END AS kind,
    count(*) AS clauses, count(*) FILTER (k < 2) AS with_number FROM c GROUP BY ALL""")
def clause_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standards.clause_summary(_clauses(spark, sf_dir))


@query(f"""WITH {_CLAUSES}, i AS (SELECT p_brand AS trade, count(*) FILTER (p_size % 2 = 0) AS items FROM part GROUP BY 1)
    SELECT trade, d AS "docDate", '厚度' AS topic, items, count(*) AS clauses FROM c JOIN i USING (trade) WHERE k = 1 AND items > 0 GROUP BY ALL""")
def topic_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a brand are also its standard's items; every other one gives a thickness."""
    part = B.table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") % 2 == 0, F.lit("厚度10mm")).otherwise(F.lit("清潔"))
    items = part.select(F.concat(F.lit("QS"), "p_brand").alias("docNo"), F.col("p_partkey").cast("string").alias("itemNo"), F.lit("R").alias("status"), name.alias("name"))
    trades = part.select(F.col("p_brand").alias("trade"), F.concat(F.lit("QS"), "p_brand").alias("docNo")).distinct()
    found = standards.conflict_candidates(standards.describe_items(items), _clauses(spark, sf_dir), trades)
    return found.select("trade", "docDate", "topic", "items", "clauses")
