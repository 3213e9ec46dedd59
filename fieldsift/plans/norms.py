"""Queries over standards, contracts and what depends on them, and over whole routing, workbench and gate runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsift import fixed_values as V
from fieldsift.operators import deident, evaluation, labelling, routing, standards
from fieldsift.plans import bindings as B
from fieldsift.plans.catalogue import MANIFEST, query
from fieldsift.plans.more import _clauses, _contract_lines
from fieldsift.sources import sectioned

# --- standards: five parts in a row are one item and its sub-items; in some groups nothing hangs below. A document has four such groups, at every size

NAMES = ["請款憑證：", "逾期罰款", "依合約圖說", "磁磚間隙3mm", "每日清潔", "抗壓試驗", '厚度誤差5%"', "外觀"]

_KIND = "CASE " + " ".join(f"WHEN regexp_matches(name, '{p}') THEN '{k}'" for p, k in V.ITEM_KINDS) + f" ELSE '{V.ITEM_KIND_DEFAULT}' END"
_ITEMS = f"""g AS (SELECT p_partkey AS k, p_partkey // 5 AS g FROM part), b AS (SELECT k, 'QS' || lpad(CAST(g % 12 AS VARCHAR), 2, '0') || '-' || g // 48 AS doc,
        CASE WHEN k % 5 = 0 THEN '' || k ELSE (k - k % 5) || '.' || k % 5 END AS no, CASE WHEN k % 5 = 0 THEN 1 ELSE 2 END AS depth,
        CASE WHEN k % 5 = 0 AND g % 3 = 0 OR k % 5 > 0 AND k % 4 = 0 THEN 'O' ELSE 'R' END AS status, [{", ".join(f"'{x}'" for x in NAMES)}][k % 8 + 1] AS name FROM g WHERE k % 5 = 0 OR g % 7 > 0),
    i AS (SELECT *, doc || '-' || no AS key, {_KIND} AS kind FROM b), d AS (SELECT DISTINCT doc FROM i)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    g = F.floor(k / 5)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    top, optional = k % 5 == 0, F.when(k % 5 == 0, g % 3 == 0).otherwise(k % 4 == 0)
    rows = B.table(spark, sf_dir, "part").filter(top | (g % 7 > 0)).select(
        F.concat(F.lit("QS"), two(g % 12), F.lit("-"), F.floor(g / 48)).alias("docNo"),
        F.when(top, k.cast("string")).otherwise(F.concat_ws(".", k - k % 5, k % 5)).alias("itemNo"),
        F.when(optional, F.lit("O")).otherwise(F.lit("R")).alias("status"), F.array(*[F.lit(x) for x in NAMES])[(k % 8).cast("int")].alias("name"),
        F.lit("f").alias("file"), F.lit(0).alias("block"), k.alias("pos"),
    )
    return standards.describe_items(rows)


def _docs(items: DataFrame) -> DataFrame:
    return items.select("docNo").distinct().select("docNo", F.concat(F.lit("n"), "docNo").alias("name"), F.concat(F.lit("id"), "docNo").alias("isoInfoId"))


@query(f"WITH {_ITEMS} SELECT kind, count(*) AS items, round(count(*) / (SELECT count(*) FROM i WHERE status = 'R'), 6) AS share FROM i WHERE status = 'R' GROUP BY kind")
def item_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standards.kind_shares(_items(spark, sf_dir))


@query(f"WITH {_ITEMS} SELECT key AS \"itemKey\", name FROM i WHERE status = 'R' AND depth = 1 AND no NOT IN (SELECT split_part(no, '.', 1) FROM i WHERE depth = 2)")
def orphan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standards.orphan_items(_items(spark, sf_dir)).select("itemKey", "name")


_SHAPES = "s AS (SELECT doc, count(*) AS items, count(*) FILTER (status = 'R') AS required, count(*) FILTER (status = 'O' AND depth = 1) AS stages FROM i GROUP BY doc)"


@query(f"WITH {_ITEMS}, {_SHAPES} SELECT doc AS \"docNo\", items, required, stages, CASE WHEN stages > 0 THEN 'A' ELSE 'C' END AS shape FROM s")
def document_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return standards.document_shapes(_docs(items), items).select("docNo", "items", "required", "stages", "shape")


@query(f"""WITH {_ITEMS}, t AS (SELECT doc, string_agg(no || '=' || regexp_replace(replace(name, '"', ''''), '[:：]+$', ''), ';' ORDER BY k) AS stages FROM i WHERE status = 'O' AND depth = 1 GROUP BY doc),
    o AS (SELECT doc, count(*) AS orphans FROM i WHERE status = 'R' AND depth = 1 AND no NOT IN (SELECT split_part(no, '.', 1) FROM i WHERE depth = 2) GROUP BY doc)
    SELECT doc AS "docNo", t.stages IS NULL AS needs_inference, t.stages, CAST(CASE WHEN t.stages IS NOT NULL THEN o.orphans END AS INTEGER) AS orphans FROM d LEFT JOIN t USING (doc) LEFT JOIN o USING (doc)""")
def stage_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    shown = F.array_join(F.transform("stages", lambda s: F.concat_ws("=", s["itemNo"], s["name"])), ";")
    return standards.stage_lists(_docs(items), items).select("docNo", "needs_inference", shown.alias("stages"), F.when(F.col("orphans").isNotNull(), F.size("orphans")).alias("orphans"))


_LISTED = """l AS (SELECT 'QS' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '-0' AS doc, CASE WHEN n_nationkey % 4 = 0 THEN 'other' ELSE 'idQS' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '-0' END AS id, n_name FROM nation)"""


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as a catalogue of documents, some of which nobody has parsed."""
    key, doc = F.col("n_nationkey"), F.concat(F.lit("QS"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit("-0"))
    return B.table(spark, sf_dir, "nation").select(doc.alias("docNo"), F.when(key % 4 == 0, F.lit("other")).otherwise(F.concat(F.lit("id"), doc)).alias("id"), F.col("n_name").alias("name"))


@query(f"""WITH {_ITEMS}, {_LISTED} SELECT coalesce(l.doc, d.doc) AS "docNo", CASE WHEN l.doc IS NULL THEN 'parsed only' WHEN d.doc IS NULL THEN 'listed only' WHEN id <> 'id' || d.doc THEN 'id differs' ELSE 'same' END AS status
    FROM l FULL JOIN d ON l.doc = d.doc""")
def catalogue_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standards.catalogue_alignment(_listed(spark, sf_dir), _docs(_items(spark, sf_dir))).select("docNo", "status")


@query(f"""WITH {_ITEMS}, {_SHAPES}, {_LISTED} SELECT substr(coalesce(l.doc, s.doc), 3, 2) AS category, coalesce(l.doc, s.doc) AS "docNo", coalesce(n_name, 'n' || s.doc) AS name, coalesce(required, 0) AS required,
    coalesce(stages, 0) AS stages, CASE WHEN s.doc IS NULL THEN '—' WHEN stages > 0 THEN 'A' ELSE 'C' END AS shape, CASE WHEN l.doc IS NULL THEN 'not in the catalogue' WHEN s.doc IS NULL THEN 'no items' ELSE 'present' END AS raw
    FROM l FULL JOIN s ON l.doc = s.doc""")
def standards_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return standards.standards_index(_listed(spark, sf_dir), _docs(items), items)


_ANSWERED = """a AS (SELECT key, CAST(k % 3 AS INTEGER) AS pos, 'c' || k % 10 AS clause FROM i WHERE k % 3 > 0 UNION ALL SELECT key, 0, 'c' || k % 7 FROM i WHERE k % 6 = 1)"""
_FAMILY = "coalesce(CASE substr(doc, 1, 4) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.DOC_FAMILIES.items()) + f" END, '{V.DOC_FAMILY_DEFAULT}')"
_GAPS = f"""{_ANSWERED}, p AS (SELECT doc, count(*) AS dependent, count(*) FILTER (key IN (SELECT key FROM a)) AS mapped FROM i WHERE status = 'R' AND regexp_matches(name, '{V.CONTRACT}') GROUP BY doc),
    q AS (SELECT {_FAMILY} AS family, doc, dependent, mapped, dependent - mapped AS unmapped, doc < 'QS05' AS has_contract FROM p)"""


def _answers(items: DataFrame) -> DataFrame:
    """Which clauses answer an item; some items have two, some none."""
    k, clause = F.col("pos"), lambda n: F.concat(F.lit("c"), (F.col("pos") % n).cast("string"))
    one = items.filter(k % 3 > 0).select("itemKey", clause(10).alias("clauseKey"), (k % 3).cast("int").alias("pos"))
    return one.union(items.filter(k % 6 == 1).select("itemKey", clause(7).alias("clauseKey"), F.lit(0).alias("pos")))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return standards.contract_gaps(items, _answers(items), items.filter("docNo < 'QS05'").select("docNo"))


@query(f"""WITH {_ITEMS}, {_GAPS} SELECT family, doc AS "docNo", dependent, mapped, unmapped, has_contract FROM q""")
def contract_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir)


@query(f"""WITH {_ITEMS}, {_GAPS} SELECT family, CAST(sum(unmapped) AS BIGINT) AS unmapped, CAST(sum(dependent) AS BIGINT) AS dependent, bool_and(has_contract) AS has_contract,
    CASE WHEN bool_and(has_contract) THEN 'mapping' ELSE 'contract' END AS need FROM q GROUP BY family HAVING sum(unmapped) > 0""")
def gap_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standards.gap_ranking(_gaps(spark, sf_dir))


@query(f"""WITH {_ITEMS}, {_ANSWERED} SELECT i.key AS "itemKey", coalesce(string_agg(clause, '、' ORDER BY pos, clause), '') AS clauses FROM i LEFT JOIN a USING (key) WHERE status = 'R' AND regexp_matches(name, '{V.CONTRACT}') GROUP BY i.key""")
def gap_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return standards.gap_table(items, _answers(items)).select("itemKey", "clauses")


# --- contracts

_LINES = """c AS (SELECT 'P/' || p_brand || '/' || l_orderkey || '.' || l_linenumber AS key, p_brand AS trade, p_type AS vendor, CAST(p_partkey AS VARCHAR) AS d, l_orderkey || '.' || l_linenumber AS no,
    CASE l_linenumber % 4 WHEN 0 THEN '付款10%' WHEN 1 THEN '厚度誤差3mm以內' WHEN 2 THEN '罰款' ELSE '其餘' END AS text FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(f"""WITH {_LINES} SELECT key AS "clauseKey", trade, vendor, d AS "docDate", no, text FROM c""")
def contract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sectioned.parse_contracts(_contract_lines(spark, sf_dir)).rows.select("clauseKey", "trade", "vendor", "docDate", "no", "text")


@query(f"""WITH {_LINES} SELECT 'item' || l_linenumber AS "itemKey", c.key AS "clauseKey", text FROM lineitem JOIN part ON l_partkey = p_partkey AND l_quantity > 40
    JOIN c ON c.key = 'P/' || p_brand || '/' || l_orderkey || '.' || l_linenumber""")
def answering_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger line items name the clauses of their own number."""
    li, part = B.table(spark, sf_dir, "lineitem").filter("l_quantity > 40"), B.table(spark, sf_dir, "part")
    named = li.join(part, li["l_partkey"] == part["p_partkey"]).select(
        F.concat(F.lit("item"), "l_linenumber").alias("itemKey"), F.col("l_linenumber").alias("pos"),
        F.concat(F.lit("P/"), "p_brand", F.lit("/"), "l_orderkey", F.lit("."), "l_linenumber").alias("clauseKey"),
    )
    return standards.answering_clauses(named, _clauses(spark, sf_dir)).select("itemKey", "clauseKey", "text")


@query(f"""WITH {_LINES} SELECT 'face' || l_linenumber % 2 AS name, trade, c.no, text, 'n' || l_suppkey % 3 AS note FROM lineitem JOIN part ON l_partkey = p_partkey AND l_quantity > 45
    JOIN c ON c.key = 'P/' || p_brand || '/' || l_orderkey || '.' || l_linenumber""")
def interface_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest line items as places where two trades meet."""
    li, part = B.table(spark, sf_dir, "lineitem").filter("l_quantity > 45"), B.table(spark, sf_dir, "part")
    faces = li.join(part, li["l_partkey"] == part["p_partkey"]).select(
        F.concat(F.lit("face"), F.col("l_linenumber") % 2).alias("name"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("n"), F.col("l_suppkey") % 3).alias("note"),
        F.concat(F.lit("P/"), "p_brand", F.lit("/"), "l_orderkey", F.lit("."), "l_linenumber").alias("clauseKey"),
    )
    return standards.interface_clauses(faces, _clauses(spark, sf_dir)).select("name", "trade", "no", "text", "note")


# --- routing, workbench and gate as a whole

_MODEL = "CASE WHEN seq % 9 = 0 THEN '' WHEN seq % 5 = 0 THEN 'english' WHEN lang = 'de' THEN 'german' WHEN lang = 'en' THEN 'english' WHEN lang = 'fr' THEN 'french' ELSE 'spanish' END"
_BARE = """CASE WHEN length(title) < 8 OR title IN ('The.', 'Le.') THEN '' WHEN regexp_matches(title, ' und | der | die |Der |Die ') THEN 'german' WHEN regexp_matches(title, ' the | of | and |The |Of ') THEN 'english'
    WHEN regexp_matches(title, ' les | des | le |Le |Les ') THEN 'french' WHEN regexp_matches(title, ' el | del | y |El |Del ') THEN 'spanish' ELSE '' END"""
_FACTS = f"""{MANIFEST}, f AS (SELECT fileId, seq, reportDate, {_BARE} AS rule, {_MODEL} AS model, (seq % 100) / 100 AS conf, CASE WHEN fileId IN (SELECT fileId FROM said) THEN (SELECT any_value(cls) FROM said s WHERE s.fileId = t.fileId) ELSE '' END AS human,
    CASE WHEN seq % 13 = 0 THEN 'excluded' WHEN seq % 13 = 1 THEN 'accepted' ELSE '' END AS action FROM (SELECT * REPLACE (trim(title) AS title) FROM m) t)"""


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as the pool, what a model says of them, and decisions on some."""
    pool, seq = B.manifest(spark, sf_dir), F.col("seq")
    names = F.create_map(*[F.lit(x) for pair in B.LANGUAGES.items() for x in pair])
    guess = F.when(seq % 9 == 0, F.lit("")).when(seq % 5 == 0, F.lit("english")).otherwise(names[F.col("lang")])
    said = pool.select("fileId", guess.alias("modelClass"), ((seq % 100) / 100).alias("modelConfidence"), F.lit("model").alias("stageSource"))
    decided = pool.filter("seq % 13 < 2").select("fileId", F.when(seq % 13 == 0, F.lit("excluded")).otherwise(F.lit("accepted")).alias("action"))
    return pool, said, decided


@query(f"""WITH {_FACTS}, b AS (SELECT *, CASE WHEN human <> '' THEN 'done' WHEN action = 'excluded' THEN 'held' WHEN seq % 17 = 0 OR model = '' THEN 'quarantine'
        WHEN rule NOT IN ('german', 'english', 'french') OR rule <> model OR conf < 0.9 THEN 'queue' WHEN CAST('0x' || substr(sha256(fileId), 1, 8) AS BIGINT) % 100 < 5 THEN 'audit' ELSE 'auto' END AS bucket FROM f)
    SELECT fileId, rule AS "ruleClass", human AS "humanClass", bucket FROM b""")
def routing_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals brought to the pool; the model knows three of the four languages."""
    pool, said, decided = _parts(spark, sf_dir)
    photos = pool.filter("seq % 17 > 0").select("fileId")
    out = routing.build_routing(pool, B.LANGUAGE_RULES, said.withColumn("signal", F.lit("live")), B.language_verdicts(spark, sf_dir), decided, photos, ["german", "english", "french"], today=B.TODAY)
    return out.select("fileId", "ruleClass", "humanClass", "bucket")


@query(f"""WITH {_FACTS}, w AS (SELECT *, CASE WHEN human <> '' THEN human ELSE rule END AS label, CASE WHEN action <> '' THEN action WHEN human <> '' THEN 'classified' ELSE 'pending' END AS state FROM f),
    r AS (SELECT *, CASE WHEN human = 'spanish' THEN 'invalid' WHEN label = '' THEN 'unknown' WHEN label NOT IN ('german', 'english') THEN 'known_untrained' ELSE 'known' END AS route FROM w)
    SELECT fileId, "route", state AS "reviewState", CASE seq % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'unseen' END AS part,
    CASE WHEN seq % 8 = 0 THEN 'human' WHEN seq % 4 > 0 AND conf >= 0.7 THEN 'image' ELSE '' END AS "defectSource", CASE WHEN seq % 8 = 0 THEN seq % 16 = 0 ELSE seq % 4 > 0 AND conf >= 0.7 END AS "defectFlag",
    route = 'invalid' OR (state = 'pending' AND seq % 2 = 0) AS "needsReview" FROM r""")
def workbench_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanish is no class of the catalogue any more; the model knows two languages."""
    pool, said, decided = _parts(spark, sf_dir)
    seq, score = F.col("fileId").cast("long"), F.when(F.col("fileId").cast("long") % 4 > 0, F.col("modelConfidence"))
    scores = said.withColumn("modelMargin", F.lit(0.1)).withColumn("defectScore", score)
    catalog = labelling.catalogue(B.LANGUAGE_RULES, B.table(spark, sf_dir, "events").select(F.col("event_type").alias("label")).distinct()).filter("label <> 'spanish'")
    split = pool.filter("seq % 3 < 2").select("fileId", F.when(F.col("seq") % 3 == 0, F.lit("test")).otherwise(F.lit("train")).alias("part"))
    queue = pool.filter("seq % 2 = 0").select("fileId", F.lit(V.REASON_LOW).alias("reason"))
    marks = pool.filter("seq % 8 = 0").select("fileId", (F.col("seq") % 16 == 0).alias("defect"))
    out = routing.workbench(
        pool, B.LANGUAGE_RULES, catalog, B.language_verdicts(spark, sf_dir), decided, scores, split, queue, marks, ["german", "english"], defect_threshold=0.7
    )
    return out.select("fileId", "route", "reviewState", "part", "defectSource", "defectFlag", "needsReview")


_SIDES = """x AS (SELECT l_returnflag AS t, CASE WHEN l_tax > 0.045 THEN l_returnflag WHEN l_quantity > 25 THEN 'A' ELSE 'R' END AS cand, CASE WHEN l_quantity > 25 THEN 'A' ELSE 'R' END AS base,
    l_tax * 10 AS cc, l_discount * 5 AS bc, l_orderkey % 4 AS fold FROM lineitem)"""
_COVER = """(SELECT round(coalesce(max(acc), 0) / (SELECT count(*) FROM x), 4) FROM (SELECT sum(n) OVER (ORDER BY c DESC) AS acc, sum(g) OVER (ORDER BY c DESC) AS hit
    FROM (SELECT {0} AS c, count(*) AS n, count(*) FILTER ({1} = t) AS g FROM x GROUP BY 1)) WHERE hit / acc >= 0.9)"""
_FOLDS = """(SELECT round({2}(f), 6) FROM (SELECT fold, round(avg(f1), 4) AS f FROM (SELECT fold, c, 2 * count(*) FILTER (t = c AND {1} = c) / (count(*) FILTER (t = c) + count(*) FILTER ({1} = c)) AS f1
    FROM x, (SELECT unnest(['A', 'N', 'R']) AS c) GROUP BY fold, c HAVING count(*) FILTER (t = c) > 0) GROUP BY fold))"""


@query(f"""WITH {_SIDES}, m AS (SELECT {_COVER.format("cc", "cand")} AS cand_coverage, {_COVER.format("bc", "base")} AS base_coverage,
        (SELECT count(*) FROM (SELECT t FROM x GROUP BY t HAVING count(*) >= {V.GATE_SUPPORT} AND count(*) FILTER (cand = t) = 0)) AS zero_recall,
        {_FOLDS.format("", "cand", "avg")} AS cand_f1, {_FOLDS.format("", "base", "avg")} AS base_f1, {_FOLDS.format("", "base", "stddev_pop")} AS base_f1_std)
    SELECT *, cand_coverage > 0 AND cand_coverage >= base_coverage - {V.COVERAGE_SLACK} AS coverage_ok, zero_recall = 0 AS recall_ok, cand_f1 >= base_f1 - base_f1_std * {V.F1_SLACK_SIGMA} AS f1_ok FROM m""")
def gold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, key = B.table(spark, sf_dir, "lineitem"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("fileId")
    guess = F.when(F.col("l_quantity") > 25, F.lit("A")).otherwise(F.lit("R"))
    answers = li.select(
        key, F.col("l_returnflag").alias("true"), F.when(F.col("l_tax") > 0.045, F.col("l_returnflag")).otherwise(guess).alias("cand"), guess.alias("base"),
        (F.col("l_tax") * 10).alias("cand_conf"), (F.col("l_discount") * 5).alias("base_conf"),
    )
    row = evaluation.gold_gate(answers, li.select(key, (F.col("l_orderkey") % 4).alias("fold")).distinct())
    return row.select(
        "cand_coverage", "base_coverage", "zero_recall", *[F.round(c, 6).alias(c) for c in ("cand_f1", "base_f1", "base_f1_std")], "coverage_ok", "recall_ok", "f1_ok"
    )


@query(f"""WITH {MANIFEST}, t AS (SELECT trim(title) AS title, title AS raw, CASE lang WHEN 'de' THEN 'german' WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' ELSE 'spanish' END AS cls, seq % 3 = 0 AS hit FROM m WHERE title <> ''),
    x AS (SELECT *, CASE WHEN ({_BARE}) IN ('german', 'english', 'french') THEN ({_BARE}) ELSE 'other' END AS said FROM t)
    SELECT count(*) AS support, round(count(*) FILTER (said = cls) / count(*), 3) AS top1, round(count(*) FILTER (hit) / count(*), 3) AS "localTop1SameSubset",
    count(DISTINCT raw) AS "distinctRawStrings", round(count(*) / (SELECT count(*) FROM m), 3) AS coverage FROM x""")
def outside_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines as a third party's free-text answers; the local model is right on every third."""
    names = F.create_map(*[F.lit(x) for pair in B.LANGUAGES.items() for x in pair])
    rows = B.manifest(spark, sf_dir).withColumn("cls", names[F.col("lang")]).withColumn("predWorkItem", F.col("title"))
    rows = rows.withColumn("pred", F.when(F.col("seq") % 3 == 0, F.col("cls")).otherwise(F.lit("?")))
    return evaluation.outside_answer(rows, B.LANGUAGE_RULES, ["german", "english", "french"])


@query("""WITH x AS (SELECT * FROM customer), c AS (SELECT 'sampleId' AS "column", 'hash16' AS type, count(*) FILTER (c_custkey % 9 = 0) AS rows FROM x
    UNION ALL SELECT 'siteBucket', 'bucket', count(*) FILTER (c_custkey % 7 = 0) FROM x UNION ALL SELECT 'humanClass', 'taxonomy', count(*) FILTER (c_mktsegment = 'FURNITURE') FROM x
    UNION ALL SELECT 'box', 'box1000', count(*) FILTER (c_custkey % 5 = 0 OR c_nationkey > 20) FROM x) SELECT * FROM c WHERE rows > 0""")
def cell_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of a pack with cells planted that may not leave."""
    k, c = F.col("c_custkey"), B.table(spark, sf_dir, "customer")
    segments = ["AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY"]
    rows = c.select(
        F.when(k % 9 == 0, F.lit("short")).otherwise(deident.salted_id(k.cast("string"), "s")).alias("sampleId"),
        F.when(k % 7 == 0, F.lit("")).otherwise(F.lit("site-012")).alias("siteBucket"), F.col("c_mktsegment").alias("humanClass"), F.lit("1").alias("hasBox"),
        F.when(k % 5 == 0, F.lit("[1, 2, 3]")).when(F.col("c_nationkey") > 20, F.lit("[0, 1, 2, 1001]")).otherwise(F.lit("[0, 10, 999, 1000]")).alias("box"),
    )
    kinds = {"sampleId": "hash16", "siteBucket": "bucket", "humanClass": "taxonomy", "hasBox": "flag", "box": "box1000"}
    return deident.cell_violations(rows, kinds, {"taxonomy": segments})
