"""Nested daily reports: scan, and one row per photo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsift import fixed_values as V
from fieldsift.functions.text import first_filled, suffix

_PHOTO = (
    "struct<id:string,fileId:string,name:string,type:string,size:long,pathCategory:string,url:string,"
    "serial:long,sortOrder:long,`desc`:string,remark:string,anno:map<string,string>>"
)
_ITEM = f"struct<workforceTradeId:string,tradeName:string,photos:array<{_PHOTO}>>"
_CONTENT = (
    "struct<title:string,feMeta:struct<specKey:string,location:string,pool:string>,"
    f"photos:array<{_PHOTO}>,items:array<{_ITEM}>>"
)
REPORT_SCHEMA = (
    "dailyReportInfoId string, constrId string, constr struct<name:string>, constrName string, "
    "reportDate string, status string, stage string, createdBy string, version string, "
    f"pages array<struct<pageSort:long,contentKind:string,content:{_CONTENT}>>"
)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report snapshots, one JSON document per file."""
    return spark.read.schema(REPORT_SCHEMA).json(path, multiLine=True)


def _filled(value: Column) -> Column:
    """A value of the annotation blob, null where it counts as empty."""
    return F.when(~value.isin("", "0", "false", "[]", "{}"), value)


def page_photos(content: Column) -> Column:
    """Photos of a page, those filed under its items included and tagged with the item's trade."""
    own = F.transform(
        F.coalesce(content["photos"], F.array()),
        lambda p: F.struct(p.alias("photo"), F.lit(None).cast("string").alias("trade")),
    )
    filed = F.transform(
        F.coalesce(content["items"], F.array()),
        lambda i: F.transform(
            F.coalesce(i["photos"], F.array()),
            lambda p: F.struct(p.alias("photo"), i["workforceTradeId"].alias("trade")),
        ),
    )
    return F.concat(own, F.flatten(filed))


def chip_labels(pool: Column) -> tuple[Column, Column]:
    """(ticked labels, self-written labels) of a chip list given as JSON text; a non-list gives blanks."""
    chips = F.transform(
        F.filter(
            F.transform(F.from_json(pool, "array<string>"), lambda t: F.from_json(t, "map<string,string>")),
            lambda m: m.isNotNull(),
        ),
        lambda m: F.struct(
            F.coalesce(_filled(m["label"]), _filled(m["name"]), _filled(m["text"]), F.lit("")).alias("label"),
            _filled(m["on"]).isNotNull().alias("on"),
            _filled(m["custom"]).alias("custom"),
        ),
    )
    ticked = F.transform(F.filter(chips, lambda c: c["on"]), lambda c: c["label"])
    written = F.transform(
        F.filter(chips, lambda c: c["custom"].isNotNull()),
        lambda c: F.when(c["custom"] == "true", c["label"]).otherwise(c["custom"]),
    )
    join = lambda a: F.coalesce(F.array_join(F.filter(a, lambda x: x != ""), "|"), F.lit(""))
    return join(ticked), join(written)


def prompt_version(anno: Column) -> Column:
    """The written version, else a guess from the fields present, else null."""
    guess = F.when(_filled(anno["workAction"]).isNotNull(), F.lit("v2-guess")).otherwise(F.lit("v1-guess"))
    return F.coalesce(_filled(anno["pv"]), F.when(_filled(anno["workItem"]).isNotNull(), guess))


def _pages(reports: DataFrame, kinds: bool = True) -> DataFrame:
    pages = F.col("pages")
    if kinds:
        pages = F.filter(pages, lambda p: p["contentKind"].isin(*V.PHOTO_KINDS))
    return reports.withColumn("page", F.explode(pages)).drop("pages")


def flatten_reports(reports: DataFrame, synced_at: str, api_host: str = "") -> DataFrame:
    """One row per photo of the wanted page kinds; photos without an id are left out."""
    ticked, written = chip_labels(F.col("page.content.feMeta.pool"))
    photos = (
        _pages(reports)
        .withColumn("chipsOn", ticked)
        .withColumn("chipsCustom", written)
        .withColumn("p", F.explode(page_photos(F.col("page.content"))))
        .withColumn("fileId", first_filled(F.col("p.photo.id"), F.col("p.photo.fileId")))
        .filter(F.col("fileId").isNotNull())
        .withColumn("anno", F.coalesce(F.col("p.photo.anno"), F.create_map().cast("map<string,string>")))
        .withColumn("nat", F.from_json(F.col("anno")["nat"], "struct<w:string,h:string>"))
        .withColumn("pathCategory", F.coalesce(first_filled(F.col("p.photo.pathCategory")), F.lit(V.DEFAULT_PATH_CATEGORY)))
    )
    anno = F.col("anno")
    trade = F.try_element_at(
        F.filter(F.col("page.content.items"), lambda i: i["workforceTradeId"].eqNullSafe(F.col("p.trade"))), F.lit(-1)
    )["tradeName"]
    return photos.select(
        "fileId",
        F.col("page.contentKind").alias("source"),
        F.col("page.content.title").alias("title"),
        F.col("page.content.feMeta.specKey").alias("specKey"),
        F.col("page.content.feMeta.location").alias("location"),
        "chipsOn",
        "chipsCustom",
        anno["workItem"].alias("predWorkItem"),
        F.coalesce(_filled(anno["wmPos"]), anno["watermarkPosition"]).alias("predPos"),
        anno["raw"].alias("annoRaw"),
        anno["v"].alias("annoV"),
        F.col("nat.w").alias("natW"),
        F.col("nat.h").alias("natH"),
        trade.alias("tradeName"),
        anno["workAction"].alias("predAction"),
        F.coalesce(_filled(anno["inspPoints"]), _filled(anno["inspectionPoints"])).alias("predInspPoints"),
        _filled(anno["evidence"]).alias("predBoxes"),
        _filled(anno["secItems"]).alias("predSecondary"),
        anno["loc"].alias("predLocation"),
        anno["wiConf"].alias("predConf"),
        prompt_version(anno).alias("promptVersion"),
        "dailyReportInfoId",
        "constrId",
        F.coalesce(first_filled(F.col("constr.name")), F.col("constrName")).alias("constrName"),
        "reportDate",
        "status",
        "stage",
        "createdBy",
        F.col("page.pageSort").alias("pageSort"),
        F.coalesce(F.nullif(F.col("p.photo.serial"), F.lit(0)), F.col("p.photo.sortOrder")).alias("serial"),
        "pathCategory",
        F.concat("pathCategory", F.lit("/"), "fileId", suffix(F.col("p.photo.name"), F.col("p.photo.type"))).alias("objectKey"),
        F.col("p.photo.name").alias("fileName"),
        F.col("p.photo.type").alias("mimeType"),
        F.col("p.photo.size").alias("size"),
        F.col("p.photo.desc").alias("desc"),
        F.col("p.photo.remark").alias("remark"),
        F.lit("true").alias("active"),
        F.lit(synced_at).alias("syncedAt"),
        F.lit(api_host).alias("apiHost"),
    )


def unknown_annotation_keys(reports: DataFrame) -> DataFrame:
    """Keys of the annotation blob nobody has signed up for, with how often they occur."""
    keys = (
        _pages(reports, kinds=False)
        .select(F.explode(page_photos(F.col("page.content"))).alias("p"))
        .select(F.explode(F.array_except(F.map_keys("p.photo.anno"), F.array(*map(F.lit, V.KNOWN_ANNO_KEYS)))).alias("key"))
    )
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("photos"))
