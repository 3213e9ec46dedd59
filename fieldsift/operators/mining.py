"""Terms in unclaimed titles that would make the next rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift.functions.text import grams
from fieldsift.scale import materialise

CJK_RUN = "[一-鿿]+"


def title_terms(titles: DataFrame, run: str = CJK_RUN, lo: int = 2, hi: int = 4) -> DataFrame:
    """(title, photos, term): each term once per title. `titles` has one row per title."""
    return titles.select("title", "photos", F.explode(grams(F.col("title"), run, lo, hi)).alias("term"))


def term_support(titles: DataFrame, run: str = CJK_RUN, lo: int = 2, hi: int = 4) -> DataFrame:
    return title_terms(titles, run, lo, hi).groupBy("term").agg(F.sum("photos").alias("photos"))


def term_purity(
    unclaimed: DataFrame, claimed: DataFrame, *, min_photos: int, purity: float = 0.9, run: str = CJK_RUN, lo: int = 2, hi: int = 4
) -> DataFrame:
    """(term, photos, claimed): terms with enough unclaimed photos that hardly occur in claimed titles."""
    wanted = term_support(unclaimed, run, lo, hi).filter(F.col("photos") >= min_photos)
    other = term_support(claimed, run, lo, hi).withColumnRenamed("photos", "claimed")
    joined = wanted.join(other, "term", "left").withColumn("claimed", F.coalesce("claimed", F.lit(0)))
    return joined.filter(F.col("photos") / (F.col("photos") + F.col("claimed")) >= purity)


def character_use(claimed: DataFrame) -> DataFrame:
    """(ch, photos): how common each character is in claimed titles."""
    chars = claimed.select("photos", F.explode(F.array_distinct(F.split("title", ""))).alias("ch")).filter("ch <> ''")
    return chars.groupBy("ch").agg(F.sum("photos").alias("photos"))


def term_noise(terms: DataFrame, claimed: DataFrame) -> DataFrame:
    """Add `noise`: summed commonness of the term's characters."""
    use = character_use(claimed).withColumnRenamed("photos", "__use")
    chars = terms.select("term", F.explode(F.split("term", "")).alias("ch")).filter("ch <> ''")
    noise = chars.join(use, "ch", "left").groupBy("term").agg(F.coalesce(F.sum("__use"), F.lit(0)).alias("noise"))
    return terms.join(noise, "term")


def cover_titles(
    unclaimed: DataFrame, claimed: DataFrame, *, min_photos: int, purity: float = 0.9, top: int = 25, run: str = CJK_RUN, lo: int = 2, hi: int = 4
) -> DataFrame:
    """(pos, term, photos, titles): greedy cover of unclaimed titles by pure terms.

    Each round takes the term with the most photos left, then the least noise, then the longest.
    A picked term covers exactly the titles that contain it, so what is left is a plain filter over a
    stored table: rounds share no lineage and join nothing. Only the pick itself reaches the driver.
    """
    spark = unclaimed.sparkSession
    pure = materialise(term_noise(term_purity(unclaimed, claimed, min_photos=min_photos, purity=purity, run=run, lo=lo, hi=hi), claimed))
    pairs = materialise(
        title_terms(unclaimed, run, lo, hi).join(pure.select("term", "noise"), "term").select("title", "photos", "term", "noise")
    )
    picked: list[tuple[int, str, int, int]] = []
    left = pairs
    while len(picked) < top:
        best = (
            left.groupBy("term", "noise").agg(F.sum("photos").alias("photos"), F.count(F.lit(1)).alias("titles"))
            .filter(F.col("photos") >= min_photos)
            .orderBy(F.col("photos").desc(), F.col("noise").asc(), F.length("term").desc(), F.col("term").asc())
            .first()
        )
        if best is None:
            break
        picked.append((len(picked) + 1, best["term"], best["photos"], best["titles"]))
        left = left.filter(~F.contains(F.col("title"), F.lit(best["term"])))
    return spark.createDataFrame(picked, "pos int, term string, photos long, titles long")


def covered_by(titles: DataFrame, picked: DataFrame) -> DataFrame:
    """Titles with the first picked term they contain (null when none does). At most `top` picks."""
    terms = [r["term"] for r in picked.orderBy("pos").collect()]
    case = F.lit(None).cast("string")
    for term in reversed(terms):
        case = F.when(F.contains(F.col("title"), F.lit(term)), F.lit(term)).otherwise(case)
    return titles.withColumn("term", case)


def cover_report(titles: DataFrame, picked: DataFrame) -> DataFrame:
    """One row: photos and titles unclaimed, covered by the picks, and left over."""
    marked = covered_by(titles, picked)
    hit = F.col("term").isNotNull()
    return marked.agg(
        F.sum("photos").alias("photos"), F.count(F.lit(1)).alias("titles"),
        F.coalesce(F.sum(F.when(hit, F.col("photos"))), F.lit(0)).alias("covered"),
        F.coalesce(F.sum(F.when(~hit, F.col("photos"))), F.lit(0)).alias("left_over"),
    )


def new_class_groups(pending: DataFrame, picked: DataFrame) -> DataFrame:
    """Per picked term: photos, titles, sites and days of the pending photos it stands for."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    marked = covered_by(pending, picked).filter("term is not null")
    return marked.groupBy("term").agg(
        F.count(F.lit(1)).alias("photos"), F.count_distinct("title").alias("titles"),
        F.count_distinct(filled("constrId")).alias("sites"), F.count_distinct(filled("reportDate")).alias("days"),
    )
