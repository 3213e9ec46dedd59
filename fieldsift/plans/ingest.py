"""Queries of the readers' side: nested reports, box annotations, trees, checklists, file checks, stored defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsift import fixed_values as V
from fieldsift.functions.text import safe_name, suffix
from fieldsift.operators import detection, merge, pool
from fieldsift.plans import bindings as B
from fieldsift.plans.catalogue import query
from fieldsift.sources import annotations, reports, trees

# --- daily reports: an order is a report of one page, its line items are the photos

_LINE = "o_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s"


def _photo() -> Column:
    """A line item as a photo entry; now and then without its first id, its name or its annotation."""
    n, key = F.col("l_linenumber"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    text = lambda c: F.lit(c).cast("string")
    anno = F.map_filter(
        F.create_map(
            F.lit("workItem"), F.when(n % 4 != 0, F.concat(F.lit("w"), n.cast("string"))),
            F.lit("pv"), F.when(n % 5 == 0, F.lit("p9")).when(n % 5 == 1, F.lit("")),
            F.lit("workAction"), F.when(n % 2 == 0, F.lit("fit")).otherwise(F.lit("[]")),
            F.lit("wmPos"), F.when(n % 3 == 0, F.lit("")).otherwise(F.lit("left")),
            F.lit("watermarkPosition"), F.lit("right"),
            F.lit("nat"), F.lit('{"w": 640, "h": 480}'),
            F.lit("extra"), F.when(n % 3 == 1, F.lit("?")),
        ),
        lambda _, value: value.isNotNull(),
    )
    return F.struct(
        F.when(n % 3 == 0, F.lit("")).when(n % 7 != 0, key).alias("id"), F.when(n % 7 != 0, key).alias("fileId"),
        F.when(n % 2 == 0, F.lit("a.b.JPG")).otherwise(F.lit("noname")).alias("name"), F.when(n % 4 == 1, F.lit("image/png")).alias("type"),
        F.col("l_partkey").alias("size"), F.when(n % 6 == 0, F.lit("")).when(n % 6 == 1, F.lit("own")).alias("pathCategory"), text(None).alias("url"),
        F.when(n % 2 == 0, F.lit(0)).otherwise(n).cast("long").alias("serial"), (n + 100).cast("long").alias("sortOrder"),
        text(None).alias("desc"), text(None).alias("remark"), F.when(n % 6 != 5, anno).alias("anno"),
    )


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested reports; the photos of a page are the line items of one order, a handful."""
    o = B.table(spark, sf_dir, "orders")
    own = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(_photo()).alias("photos"))
    k, none = F.col("o_orderkey"), F.array().cast(f"array<{reports._PHOTO}>")
    filed = k % 2 == 1
    chips = F.concat(F.lit('[{"label":"'), F.col("o_orderpriority"), F.lit('","on":true},{"name":"b","on":false,"custom":"own"},{"text":"c","on":"1","custom":"true"},5]'))
    item = F.struct(F.concat(F.lit("t"), (k % 3).cast("string")).alias("workforceTradeId"), F.col("o_orderstatus").alias("tradeName"), F.col("photos").alias("photos"))
    meta = F.struct(F.lit("paint").alias("specKey"), F.lit("roof").alias("location"), F.when(k % 4 != 0, chips).otherwise(F.lit("none")).alias("pool"))
    content = F.struct(
        F.col("o_orderpriority").alias("title"), meta.alias("feMeta"),
        F.when(filed, none).otherwise(F.col("photos")).alias("photos"), F.when(filed, F.array(item)).alias("items"),
    )
    kind = F.when(k % 5 == 0, F.lit("NOTES")).when(filed, F.lit("WORKFORCE")).otherwise(F.lit("WORK_ITEM"))
    page = F.struct((k % 9).alias("pageSort"), kind.alias("contentKind"), content.alias("content"))
    return o.join(own, "o_orderkey").select(
        k.cast("string").alias("dailyReportInfoId"), F.col("o_custkey").cast("string").alias("constrId"),
        F.struct(F.when(k % 2 == 0, F.lit("")).otherwise(F.lit("site")).alias("name")).alias("constr"), F.lit("plain").alias("constrName"),
        F.to_date("o_orderdate").cast("string").alias("reportDate"), F.lit("SUBMITTED").alias("status"), F.lit("1").alias("stage"),
        F.lit("me").alias("createdBy"), F.lit("3").alias("version"), F.array(page).alias("pages"),
    )


@query(f"""WITH x AS (SELECT {_LINE}, o_orderpriority AS title, o_orderstatus AS st FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 5 <> 0 AND l_linenumber % 7 <> 0),
    y AS (SELECT *, CASE WHEN n % 6 = 1 THEN 'own' ELSE 'daily-report' END AS cat, k || '-' || n || '-' || p || '-' || s AS id FROM x)
    SELECT id AS "fileId", CASE WHEN k % 2 = 1 THEN 'WORKFORCE' ELSE 'WORK_ITEM' END AS source, title, CASE WHEN k % 2 = 1 THEN st END AS "tradeName",
    cat || '/' || id || CASE WHEN n % 2 = 0 THEN '.jpg' WHEN n % 4 = 1 THEN '.png' ELSE '.bin' END AS "objectKey",
    CASE WHEN n % 2 = 0 THEN n + 100 ELSE n END AS serial, p AS size, CASE WHEN k % 2 = 1 THEN 'site' ELSE 'plain' END AS "constrName" FROM y""")
def report_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = reports.flatten_reports(_reports(spark, sf_dir), "2024-05-05T00:00:00")
    return flat.select("fileId", "source", "title", "tradeName", "objectKey", "serial", "size", "constrName")


@query(f"""WITH x AS (SELECT {_LINE}, o_orderpriority AS title FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 5 <> 0 AND l_linenumber % 7 <> 0)
    SELECT k || '-' || n || '-' || p || '-' || s AS "fileId", CASE WHEN n % 6 <> 5 AND n % 4 <> 0 THEN 'w' || n END AS "predWorkItem",
    CASE WHEN n % 6 = 5 THEN NULL WHEN n % 3 = 0 THEN 'right' ELSE 'left' END AS "predPos", CASE WHEN n % 6 <> 5 THEN '640' END AS "natW",
    CASE WHEN n % 6 = 5 THEN NULL WHEN n % 5 = 0 THEN 'p9' WHEN n % 4 = 0 THEN NULL WHEN n % 2 = 0 THEN 'v2-guess' ELSE 'v1-guess' END AS "promptVersion" FROM x""")
def report_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = reports.flatten_reports(_reports(spark, sf_dir), "2024-05-05T00:00:00")
    return flat.select("fileId", "predWorkItem", "predPos", "natW", "promptVersion")


@query("""WITH x AS (SELECT o_orderkey AS k, o_orderpriority AS title FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 5 <> 0 AND l_linenumber % 7 <> 0)
    SELECT CASE WHEN k % 4 <> 0 THEN title || '|c' ELSE '' END AS "chipsOn", CASE WHEN k % 4 <> 0 THEN 'own|c' ELSE '' END AS "chipsCustom", count(*) AS photos FROM x GROUP BY ALL""")
def report_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = reports.flatten_reports(_reports(spark, sf_dir), "2024-05-05T00:00:00")
    return flat.groupBy("chipsOn", "chipsCustom").agg(F.count(F.lit(1)).alias("photos"))


@query("""SELECT 'extra' AS key, count(*) AS photos FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber % 3 = 1 AND l_linenumber % 6 <> 5 HAVING count(*) > 0""")
def unknown_annotation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.unknown_annotation_keys(_reports(spark, sf_dir))


# --- boxes


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item as an image of 800 x 400 with two boxes; some sizes and corners are broken."""
    li, n = B.table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    q, kinds = F.col("l_quantity"), F.array(*[F.lit(x) for x in V.DEFECT_PATTERNS])
    side = lambda c: c.cast("string")
    box = lambda label, x0, y0, x1, y1: F.struct(label.alias("_label"), side(x0).alias("_xtl"), side(y0).alias("_ytl"), side(x1).alias("_xbr"), side(y1).alias("_ybr"))
    first = box(F.concat(F.lit(" "), kinds[n % 10]), q * 4, q, q * 4 + 100, q + F.col("l_partkey") % 10)
    second = box(F.lit("bird"), q * 16, F.when(n % 5 == 0, F.lit("x")).otherwise(F.lit("-3")), q * 32, F.lit(30))
    return li.select(
        F.concat(F.lit("in/"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.lit(".jpg")).alias("_name"),
        F.lit("800").alias("_width"), F.when(n % 6 == 0, F.lit("0")).otherwise(F.lit("400")).alias("_height"), F.array(first, second).alias("box"),
    )


_KINDS = "[" + ", ".join(f"'{x}'" for x in V.DEFECT_PATTERNS) + "]"
_THOUSAND = "greatest(0, least(1000, CAST(round_even({} * 1000, 0) AS INTEGER)))"
_DRAWN = f"""x AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_quantity AS q, l_linenumber AS n, l_partkey AS p FROM lineitem WHERE l_linenumber % 6 <> 0),
    y AS (SELECT id, {_KINDS}[n % 10 + 1] AS t, q * 4 / 800 AS a, q / 400 AS b, (q * 4 + 100) / 800 AS c, (q + p % 10) / 400 AS d FROM x
        UNION ALL SELECT id, 'bird', q * 16 / 800, -3 / 400, q * 32 / 800, 30 / 400 FROM x WHERE n % 5 <> 0),
    z AS (SELECT id, t, {_THOUSAND.format("a")} AS a, {_THOUSAND.format("b")} AS b, {_THOUSAND.format("c")} AS c, {_THOUSAND.format("d")} AS d FROM y),
    w AS (SELECT * FROM z WHERE c - a >= 6 AND d - b >= 6)"""


@query(f"""WITH {_DRAWN} SELECT id AS "fileId", t AS "defectType", a AS x0, b AS y0, c AS x1, d AS y1 FROM w""")
def drawn_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn, b = annotations.drawn_boxes(_images(spark, sf_dir)), F.col("box")
    return drawn.select("fileId", "defectType", *[b[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


@query(f"""WITH {_DRAWN} SELECT t AS "defectType", count(*) AS boxes FROM w WHERE t = 'bird' GROUP BY t""")
def rejected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.rejected_labels(annotations.drawn_boxes(_images(spark, sf_dir)))


@query("""SELECT l_orderkey || '-' || l_linenumber AS "fileId", CASE WHEN l_linenumber % 3 = 0 THEN 'a' ELSE 'b' END AS pattern, round(l_quantity / 200 * 1000, 6) AS x0,
    round((l_quantity + 10) / 200 * 1000, 6) AS x1, 'gdino-correct/' || l_suppkey % 5 AS source FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber % 3 < 2""")
def confirmed_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item is one detector run's answer of two boxes; a third of the verdicts points past them."""
    li, q = B.table(spark, sf_dir, "lineitem"), F.col("l_quantity")
    run, photo = (F.col("l_suppkey") % 5).alias("runId"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("photoId")
    place = F.concat_ws("/", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber").alias("place")
    box = lambda p, at: F.struct(F.lit(p).alias("pattern"), F.array(at, at, at + 10, at + 20).alias("box"))
    given = li.select(F.concat_ws("#", run, place).alias("runId"), photo, F.lit(200).alias("width"), F.lit(100).alias("height"), F.array(box("a", q), box("b", q)).alias("boxes"))
    said = F.when(F.col("l_returnflag") == "A", F.lit("correct")).otherwise(F.lit("wrong"))
    verdicts = li.select(F.concat_ws("#", run, place).alias("runId"), photo, (F.col("l_linenumber") % 3).alias("boxIdx"), said.alias("verdict"))
    hits = annotations.confirmed_detections(verdicts, given)
    return hits.select("fileId", "pattern", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"), F.substring_index("source", "#", 1).alias("source"))


_STORED = f"{_KINDS}[l_partkey % 10 + 1]"


def _defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as stored defects, with one or two boxes as JSON text; some texts are broken."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    text = F.when(n % 4 == 0, F.format_string('[[%d, 1, 900, "40"]]', q)).when(n % 4 == 1, F.format_string("[[1, 2, 3, 4], [%d, 5, 60, 70], [1, 2]]", q)).when(n % 4 == 2, F.lit("[[1, 2")).otherwise(F.lit(""))
    kind = F.array(*[F.lit(x) for x in V.DEFECT_PATTERNS])[(F.col("l_partkey") % 10).cast("int")]
    return B.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fileId"), kind.alias("defectType"),
        F.when(F.col("l_returnflag") == "A", F.lit("cvat-2")).otherwise(F.lit("human")).alias("source"), text.alias("box"),
    )


_BOXED = f"""x AS (SELECT l_orderkey || '-' || l_linenumber AS id, {_STORED} AS t, CAST(l_quantity AS INTEGER) AS q, l_linenumber % 4 AS n, l_returnflag = 'A' AS drawn FROM lineitem WHERE l_linenumber % 4 < 2),
    y AS (SELECT id, t, drawn, CASE WHEN n = 0 THEN q ELSE 1 END AS x0, CASE WHEN n = 0 THEN 1 ELSE 2 END AS y0, CASE WHEN n = 0 THEN 900 ELSE 3 END AS x1, CASE WHEN n = 0 THEN 40 ELSE 4 END AS y1 FROM x
        UNION ALL SELECT id, t, drawn, q, 5, 60, 70 FROM x WHERE n = 1)"""


@query(f"""WITH {_BOXED} SELECT id AS "fileId", t AS pattern, x0, y0, x1, y1, 'cvat-2' AS source FROM y WHERE drawn""")
def detection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.drawn_box_rows(_defects(spark, sf_dir))


@query(f"""WITH {_BOXED}, n AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, c FROM (SELECT t, count(*) AS c FROM y GROUP BY t))
    SELECT t AS pattern, CAST(i AS INTEGER) AS "classId", c AS boxes FROM n WHERE c >= 10""")
def detection_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers go to all patterns in name order; patterns of fewer than ten boxes are not trained on."""
    counts = detection.pattern_counts(detection.boxes_by_pattern(_defects(spark, sf_dir)))
    return counts.filter("boxes >= 10").join(detection.class_ids(counts), "pattern").select("pattern", "classId", "boxes")


# --- trees, checklists, names of error pictures


@query("""SELECT DISTINCT r_name AS l1, 'land ' || n_name AS l2, c_mktsegment AS l3 FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND n_nationkey % 4 > 0
    WHERE coalesce(c_mktsegment, 'land ' || n_name) LIKE '%N%'""")
def tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, their nations and the customers' segments there as the tree; every fourth nation is a leaf itself."""
    segments = B.table(spark, sf_dir, "customer").filter("c_nationkey % 4 > 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_set(F.struct(F.col("c_mktsegment").alias("name"))).alias("children"))
    nations = B.table(spark, sf_dir, "nation").join(segments, "n_nationkey", "left")
    named = F.concat(F.lit('{"en": "x", "zh-TW": " land '), F.col("n_name"), F.lit('"}'))
    middle = nations.groupBy("n_regionkey").agg(F.collect_list(F.struct(named.alias("name"), "children")).alias("children"))
    tree = B.table(spark, sf_dir, "region").join(middle, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("name"), "children")
    return trees.search_tree(trees.flatten_tree(tree), "N")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS "itemNo", CASE WHEN p_size % 3 = 0 THEN 'O' ELSE 'R' END AS status, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS name
    FROM part WHERE p_size % 3 < 2 AND p_partkey % 7 <> 0""")
def checklist_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    status = F.when(size % 3 == 0, F.lit("OPTIONAL")).when(size % 3 == 1, F.lit("REQUIRED")).otherwise(F.lit("HEADING"))
    entries = B.table(spark, sf_dir, "part").select(
        F.when(key % 14 == 0, F.lit("")).when(key % 7 != 0, key.cast("string")).alias("docNo"), status.alias("status"), F.when(size % 5 != 0, F.col("p_name")).alias("name")
    )
    return trees.checklist_rows(entries)


@query("""SELECT p_brand AS "true", p_type AS pred, count(*) AS pictures FROM part WHERE p_size % 4 <> 0 GROUP BY ALL""")
def error_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of error pictures, made of the parts; every fourth is not one."""
    name = F.format_string("真%s_猜%s_%08d.%s", "p_brand", "p_type", "p_partkey", F.when(F.col("p_size") % 4 == 0, F.lit("png")).otherwise(F.lit("jpg")))
    parts = trees.error_name(F.col("name"))
    said = B.table(spark, sf_dir, "part").select(name.alias("name")).select(*[c.alias(k) for k, c in parts.items()]).filter("prefix is not null")
    return said.groupBy("true", "pred").agg(F.count(F.lit(1)).alias("pictures"))


# --- names, files, stored defects

_SAFE = """CASE WHEN regexp_replace(trim(regexp_replace(h, '[/\\\\:*?"<>|\\n\\r\\t]+', '_', 'g'), E' \\t\\n\\r'), '^\\.+|\\.+$', '', 'g') = '' THEN '_'
    ELSE regexp_replace(trim(regexp_replace(h, '[/\\\\:*?"<>|\\n\\r\\t]+', '_', 'g'), E' \\t\\n\\r'), '^\\.+|\\.+$', '', 'g') END"""


@query(f"""SELECT page_id, {_SAFE} AS name, CASE WHEN h LIKE '%.%' THEN lower(regexp_extract(h, '(\\.[^.]*)$', 1)) ELSE '.png' END AS suffix FROM (SELECT page_id, url AS h FROM pages)""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, url = B.table(spark, sf_dir, "pages"), F.col("url")
    return pages.select("page_id", safe_name(url).alias("name"), suffix(url, F.lit("image/png")).alias("suffix"))


def _file_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as photos, their line items as raw files, every other order with a prepared file."""
    o, li = B.table(spark, sf_dir, "orders"), B.table(spark, sf_dir, "lineitem")
    key = F.col("o_orderkey").cast("string").alias("fileId")
    manifest = o.select(key, F.lit("WORK_ITEM").alias("source"), F.lit("true").alias("active"))
    size = F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_quantity") * 50).cast("long"))
    raw = li.select(F.col("l_orderkey").cast("string").alias("fileId"), size.alias("size"))
    prepared = o.filter("o_orderkey % 2 = 0").select(key, (F.col("o_custkey") * 20).alias("size"))
    return pool.audit_files(manifest, raw, prepared, o.filter("o_orderstatus = 'F'").select(key))


_ISSUES = """p AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber % 3 = 0 THEN 'missing' WHEN l_quantity * 50 < 1024 THEN 'too_small:' || CAST(l_quantity * 50 AS BIGINT) END AS w FROM lineitem),
    r AS (SELECT k, bool_and(w IS NOT NULL) AS bad, array_to_string(list_sort(list_distinct(list(w) FILTER (w IS NOT NULL))), '|') AS w FROM p GROUP BY k),
    i AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS t, CASE WHEN bad IS NULL THEN 'missing' WHEN bad THEN w ELSE '' END AS rp,
        CASE WHEN o_orderkey % 2 = 1 THEN 'missing' WHEN o_custkey * 20 < 1024 THEN 'too_small:' || o_custkey * 20 ELSE '' END AS pp FROM orders LEFT JOIN r ON k = o_orderkey),
    j AS (SELECT k, t, rp, CASE WHEN rp = '' THEN pp ELSE '' END AS pp FROM i)"""


@query(f"""WITH {_ISSUES} SELECT CAST(k AS VARCHAR) AS "fileId", rp AS "rawProblem", pp AS "preparedProblem", t AS "trainingRelevant" FROM j WHERE rp <> '' OR pp <> ''""")
def file_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_issues(spark, sf_dir).select("fileId", "rawProblem", "preparedProblem", "trainingRelevant")


@query(f"""WITH {_ISSUES}, a AS (SELECT 'raw' AS stage, rp AS problem, t FROM j WHERE rp <> '' UNION ALL SELECT 'prepared', pp, t FROM j WHERE pp <> '')
    SELECT stage, problem, count(*) AS photos, count(*) FILTER (t) AS training FROM a GROUP BY stage, problem""")
def file_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.audit_summary(_file_issues(spark, sf_dir))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS "fileId" FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def living_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("fileId"))
    wanted = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("fileId")).distinct()
    return merge.living_artefacts(have, wanted)
