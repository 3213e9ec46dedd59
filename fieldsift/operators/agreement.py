"""How far two annotators agree, on classes and on boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift import fixed_values as V
from fieldsift.functions.boxes import box_list, iou
from fieldsift.functions.text import blank, strip
from fieldsift.scale import materialise

#: Boxes that an annotator drew on a photo, up to which the photo is settled as a whole; a fuller one goes through grid cells.
FEW = 64


def label_problems(labels: DataFrame) -> DataFrame:
    """Blank or repeated ids; either makes an annotator's list unusable."""
    per = labels.groupBy(blank("fileId").alias("fileId")).agg(F.count(F.lit(1)).alias("n"))
    return per.filter((strip(F.col("fileId")) == "") | (F.col("n") > 1))


def label_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(fileId, a, b, kind) over the photos either annotator listed."""
    for name, side in (("first", a), ("second", b)):
        if label_problems(side).limit(1).count():
            raise ValueError(f"the {name} list has blank or repeated ids")
    side = lambda df, n: df.select("fileId", strip(blank("cls")).alias(n))
    both = side(a, "a").join(side(b, "b"), "fileId", "full").na.fill("", ["a", "b"])
    kind = (
        F.when((F.col("a") != "") & (F.col("b") != ""), F.when(F.col("a") == F.col("b"), "agree").otherwise("differ"))
        .when(F.col("a") != "", F.lit("only first"))
        .when(F.col("b") != "", F.lit("only second"))
        .otherwise(F.lit("unlabelled"))
    )
    return both.withColumn("kind", kind)


def label_summary(pairs: DataFrame) -> DataFrame:
    """One row of counts; the ceiling is agreement over all photos, missing labels included."""
    is_ = lambda *k: F.count_if(F.col("kind").isin(*k))
    total = F.count(F.lit(1))
    return pairs.agg(
        total.alias("total"), is_("agree", "differ").alias("pair"), is_("agree").alias("agree"),
        is_("only first", "only second").alias("one_sided"), is_("unlabelled").alias("unlabelled"),
        F.round(F.try_divide(is_("agree"), total), 3).alias("ceiling"),
    )


def label_agreement(pairs: DataFrame) -> DataFrame:
    """Agreement per class over the photos where either side named it."""
    each = pairs.select("kind", F.explode(F.array_distinct(F.array("a", "b"))).alias("cls")).filter("cls <> ''")
    return _rates(each.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "agree").alias("agree")))


def _rates(per: DataFrame) -> DataFrame:
    return per.withColumn("rate", F.round(F.col("agree") / F.col("n"), 3)).withColumn("gated", F.col("n") >= V.GATE_SUPPORT)


def numbered_boxes(defects: DataFrame, source: str, order: str = "seq") -> DataFrame:
    """(fileId, i, type, box) of one annotator; `i` orders boxes as they were recorded."""
    return (
        defects.filter(F.col("source") == source)
        .select("fileId", F.col("defectType").alias("type"), F.col(order).alias("__o"), F.posexplode_outer(box_list(F.col("box"))).alias("__p", "box"))
        .filter("box is not null")  # with outer, the list is read once and not again for a filter before
        .select("fileId", F.struct("__o", "__p").alias("i"), "type", "box")
    )


def _zones(df: DataFrame, spread: int) -> DataFrame:
    """Grid cells a box may share with a match. At IoU 1/2 sides differ at most twofold and centres by
    at most half the smaller side, so neighbouring cells of neighbouring sizes are enough."""

    def axis(lo: int, hi: int) -> Column:
        side = F.greatest(F.col("box")[hi] - F.col("box")[lo], F.lit(1))
        level = F.floor(F.log2(side)).cast("int")
        levels = F.sequence(level - spread, level + spread)
        centre = (F.col("box")[lo] + F.col("box")[hi]) / 2
        cell = lambda m: F.floor(centre / F.pow(F.lit(2.0), m)).cast("long")
        return F.flatten(
            F.transform(levels, lambda m: F.transform(F.sequence(cell(m) - spread, cell(m) + spread), lambda c: F.struct(m.alias("m"), c.alias("c"))))
        )

    return df.withColumn("zx", F.explode(axis(0, 2))).withColumn("zy", F.explode(axis(1, 3)))


def _full_photos(a: DataFrame, b: DataFrame) -> DataFrame:
    """(fileId) of photos on which either side has more than FEW boxes, stored."""
    per = [x.groupBy("fileId").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FEW).select("fileId") for x in (a, b)]
    return materialise(per[0].union(per[1]).distinct())


def crowded_photos(defects: DataFrame, *sources: str) -> DataFrame:
    """(fileId) of photos on which one of `sources` may have more than FEW boxes, stored; no text is parsed for it.

    A box takes a bracket of its own, or the escape of one, beside the one that opens its list.
    """
    without = lambda sign: F.length(F.replace("box", F.lit(sign), F.lit("")))
    marks = 2 * F.length("box") - without("[") - without("\\")
    most = defects.filter(F.col("source").isin(*sources)).groupBy("fileId", "source").agg(F.sum(F.greatest(marks - 1, F.lit(0))).alias("n"))
    return materialise(most.filter(F.col("n") > FEW).select("fileId").distinct())


def _parted(boxes: DataFrame, full: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes of the other photos, and those of the full ones."""
    return boxes.join(full, "fileId", "left_anti"), boxes.join(full, "fileId", "left_semi")


def _compared(a: DataFrame, b: DataFrame, on: list[str], match: float) -> DataFrame:
    """Pairs of `box` and `other` that meet `on`.

    Corners are columns of their own before boxes meet: with array entries, the code of a comparison is so long that
    the JVM interprets it.
    """
    corners = lambda box, name: [F.col(box)[k].alias(f"{name}{k}") for k in range(4)]
    met = a.select(*on, "i", *corners("box", "p")).join(b.select(*on, "j", *corners("other", "q")), on)
    share = iou(*[[F.col(f"{name}{k}") for k in range(4)] for name in "pq"])
    return met.withColumn("iou", share).filter(F.col("iou") >= match).select("fileId", "i", "j", "iou")


def close_pairs(a: DataFrame, b: DataFrame, *, match: float = V.IOU_MATCH, crowded: DataFrame | None = None) -> DataFrame:
    """(fileId, i, j, iou) of boxes that overlap enough to be the same.

    `crowded` (`crowded_photos`) spares counting the boxes; without it they are read once more for that.

    A photo of a few boxes yields all its combinations as they are compared; on a fuller one, where they would grow
    with the square, boxes meet through grid cells.
    """
    if match < 0.5:
        raise ValueError("the grid is built for overlaps of at least one half")
    full = _full_photos(a, b) if crowded is None else crowded
    slim = a.select("fileId", "i", "box"), b.select("fileId", F.col("i").alias("j"), F.col("box").alias("other"))
    if full.isEmpty():
        return _compared(*slim, ["fileId"], match)
    (few_a, full_a), (few_b, full_b) = _parted(slim[0], full), _parted(slim[1], full)
    return _compared(few_a, few_b, ["fileId"], match).unionByName(_grid_pairs(full_a, full_b, match))


def _grid_pairs(a: DataFrame, b: DataFrame, match: float) -> DataFrame:
    right = _zones(b.select("fileId", "j", F.col("other").alias("box")), 0).withColumnRenamed("box", "other")
    # one level and one cell per box on the right: a pair meets exactly once
    return _compared(_zones(a, 1), right, ["fileId", "zx", "zy"], match)


def match_boxes(pairs: DataFrame) -> DataFrame:
    """Each first-side box, in order, takes its best second-side box that is still free.

    In every round a box settles when it is the earliest one still interested in its favourite; the
    earliest box of each photo always is, and unrelated boxes settle side by side.
    """
    settled, rest = [], materialise(pairs)
    while rest.take(1):
        favourite = rest.groupBy("fileId", "i").agg(F.max_by(F.struct("j", "iou"), F.struct("iou", F.struct(_reverse("j")))).alias("f"))
        earliest = rest.groupBy("fileId", F.col("j").alias("__j")).agg(F.min("i").alias("__first"))
        done = materialise(
            favourite.select("fileId", "i", F.col("f.j").alias("j"), F.col("f.iou").alias("iou"))
            .join(earliest, (F.col("j") == F.col("__j")) & (F.col("i") == F.col("__first")) & (favourite["fileId"] == earliest["fileId"]))
            .select(favourite["fileId"], "i", "j", "iou")
        )
        settled.append(done)
        rest = materialise(
            rest.join(done.select("fileId", "i"), ["fileId", "i"], "left_anti").join(done.select("fileId", "j"), ["fileId", "j"], "left_anti")
        )
    out = settled[0] if settled else pairs
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select("fileId", "i", "j", "iou")


def _reverse(c: str) -> Column:
    """Larger for earlier boxes."""
    return F.struct((-F.col(f"{c}.__o")).alias("o"), (-F.col(f"{c}.__p")).alias("p"))


def _settled(a: DataFrame, b: DataFrame, match: float = V.IOU_MATCH) -> DataFrame:
    """`box_pairs` of photos with few boxes, each photo by itself: one shuffle, and no pair is stored."""
    side = lambda df, first: df.select("fileId", F.lit(first).alias("first"), F.struct("i", "type", "box").alias("x"))
    listed = lambda is_first: F.array_sort(F.collect_list(F.when(F.col("first") == is_first, F.col("x"))))
    lone = F.when(F.col("fileId").isNull(), F.struct("first", "x.i"))  # boxes of no known photo match nothing
    photos = side(a, True).unionByName(side(b, False)).groupBy("fileId", lone.alias("lone")).agg(listed(True).alias("xs"), listed(False).alias("ys"))
    row = lambda kind, one, other, share: F.struct(kind.alias("kind"), one.alias("a"), other.alias("b"), share.alias("iou"))

    def best(x: Column, free: Column) -> Column:
        """The greatest overlap with a free box and minus that box's place: of equal ones the first."""
        each = F.transform(free, lambda y, at: F.struct(iou(x["box"], y["box"]).alias("iou"), (-at).alias("at")))
        return F.array_max(F.filter(each, lambda e: e["iou"] >= match))

    def settle(state: Column, step: Column) -> Column:
        x, found = step["x"], step["found"]
        y = F.get(state["free"], -found["at"])
        kind = F.when(x["type"] == y["type"], F.lit("agree")).otherwise(F.lit("type conflict"))
        done = F.when(found.isNull(), row(F.lit("only first"), x["type"], F.lit(""), F.lit(0.0))).otherwise(row(kind, x["type"], y["type"], F.round(found["iou"], 3)))
        left = F.when(found.isNull(), state["free"]).otherwise(F.filter(state["free"], lambda _, at: at != -found["at"]))
        return F.struct(left.alias("free"), F.concat(state["out"], F.array(done)).alias("out"))

    # what is found is looked up once, by way of a list of one
    one = lambda state, x: F.transform(F.array(F.struct(x.alias("x"), best(x, state["free"]).alias("found"))), lambda step: settle(state, step))[0]
    none = F.array().cast("array<struct<kind:string,a:string,b:string,iou:double>>")
    ended = photos.select("fileId", F.aggregate("xs", F.struct(F.col("ys").alias("free"), none.alias("out")), one).alias("s"))
    alone = F.transform("s.free", lambda y: row(F.lit("only second"), F.lit(""), y["type"], F.lit(0.0)))
    return ended.select("fileId", F.inline(F.concat("s.out", alone)))


def box_pairs(defects: DataFrame, first: str, second: str, *, order: str = "seq") -> DataFrame:
    """(fileId, kind, a, b, iou): matched boxes that agree or conflict in type, and boxes left alone."""
    if not first or not second or first == second:
        raise ValueError("two different sources are needed")
    a, b = numbered_boxes(defects, first, order), numbered_boxes(defects, second, order)
    full = _full_photos(a, b)
    if full.isEmpty():
        return _settled(a, b)
    (few_a, full_a), (few_b, full_b) = _parted(a, full), _parted(b, full)
    return _settled(few_a, few_b).unionByName(_settled_by_rounds(materialise(full_a), materialise(full_b)))


def _settled_by_rounds(a: DataFrame, b: DataFrame) -> DataFrame:
    """`box_pairs` of photos of any number of boxes."""
    matched = match_boxes(close_pairs(a, b))
    types = (
        matched.join(a.select("fileId", "i", F.col("type").alias("a")), ["fileId", "i"])
        .join(b.select("fileId", F.col("i").alias("j"), F.col("type").alias("b")), ["fileId", "j"])
    )
    met = types.select("fileId", F.when(F.col("a") == F.col("b"), "agree").otherwise("type conflict").alias("kind"), "a", "b", F.round("iou", 3).alias("iou"))
    alone_a = a.join(matched.select("fileId", "i"), ["fileId", "i"], "left_anti").select("fileId", F.lit("only first").alias("kind"), F.col("type").alias("a"), F.lit("").alias("b"), F.lit(0.0).alias("iou"))
    alone_b = b.join(matched.select("fileId", F.col("j").alias("i")), ["fileId", "i"], "left_anti").select("fileId", F.lit("only second").alias("kind"), F.lit("").alias("a"), F.col("type").alias("b"), F.lit(0.0).alias("iou"))
    return met.unionByName(alone_a).unionByName(alone_b)


def box_agreement(pairs: DataFrame) -> DataFrame:
    """Per pattern: events, matched, one-sided, agreement rate, enough to judge."""
    each = pairs.select("kind", F.explode(F.array_distinct(F.array("a", "b"))).alias("type")).filter("type <> ''")
    met = F.col("kind").isin("agree", "type conflict")
    return _rates(
        each.groupBy("type").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(met).alias("paired"), F.count_if(~met).alias("one_sided"),
            F.count_if(F.col("kind") == "agree").alias("agree"),
        )
    )
