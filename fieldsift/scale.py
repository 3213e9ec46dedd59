"""Building blocks that keep a plan safe when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldsift.session import shared_dir

HASH_DIGITS = 3  # 4,096 buckets for every group


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_blank_safe(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join where blank keys never match.

    Blank rows get a join key of their own (`spread`), so they do not pile up in one partition.
    """
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    keyed = left.withColumn("__blank", blank).withColumn(
        "__key", F.when(blank, F.col(spread).cast("string")).otherwise(F.col(key))
    )
    other = right.withColumnRenamed(key, "__key").withColumn("__blank", F.lit(False))
    return keyed.join(other, ["__blank", "__key"], "left").drop("__blank", "__key")


def latest_by(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """The whole row with the greatest `order` for each key. Partial aggregation, no window."""
    rest = [c for c in df.columns if c not in keys]
    order = F.col(order) if isinstance(order, str) else order
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def running_totals(scores: DataFrame, order: str, sums: dict[str, str], *, descending: bool = True, ranges: int | None = None) -> DataFrame:
    """Inclusive running sums over the whole table ordered by `order` (unique values; null is one of them).

    `sums` maps a source column to the output name. Rows are dealt into value ranges (as many as shuffle
    partitions by default); each range is summed on its own and shifted by the totals of those before it.
    """
    by = F.col(order).desc() if descending else F.col(order).asc()
    many = ranges or int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # stored with its range number, so that a retry cannot deal the rows otherwise
    ranged = materialise(scores.repartitionByRange(many, by).withColumn("__b", F.spark_partition_id()))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__b").agg(*[F.sum(c).alias(f"__t_{o}") for c, o in sums.items()])
    offsets = totals.select(
        "__b", *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__o_{o}") for o in sums.values()]
    )
    inside = Window.partitionBy("__b").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    # one row per range, so the broadcast side never exceeds their number
    return (
        ranged.join(F.broadcast(offsets), "__b")
        .select("*", *[(F.sum(c).over(inside) + F.col(f"__o_{o}")).alias(o) for c, o in sums.items()])
        .select(*scores.columns, *sums.values())
    )


def ordered_rank(df: DataFrame, order: str, *, out: str = "rank", ranges: int | None = None) -> DataFrame:
    """1-based rank over the whole table by a column with unique values."""
    counted = running_totals(df.withColumn("__one", F.lit(1)), order, {"__one": out}, descending=False, ranges=ranges)
    return counted.select(*df.columns, F.col(out).cast("long").alias(out))


def last_before(df: DataFrame, order: Sequence[str], value: str, out: str, ranges: int | None = None) -> DataFrame:
    """Add `out`: the last non-null `value` in the rows before, over the whole table in the order of `order` (unique).

    Rows are dealt into ranges, as in `running_totals`; only one value a range is carried between them.
    """
    many = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(many, *order).withColumn("__b", F.spark_partition_id()))
    filled = F.when(F.col(value).isNotNull(), F.struct(*order))
    # one row per range, so neither this window nor the broadcast side exceeds their number
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy("__b").agg(F.max_by(value, filled).alias("__e"))
    carried = F.broadcast(ends.select("__b", F.last("__e", ignorenulls=True).over(before).alias("__c")))
    inside = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(carried, "__b").select(*df.columns, F.coalesce(F.last(value, ignorenulls=True).over(inside), "__c").alias(out))


def quantiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row with the interpolated quantile of `column` for each output name (null without values).

    Equal values are counted first; the values at the two ranks beside a quantile are then found among running
    counts over value ranges, so no task holds all values.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    run = running_totals(counts, "__v", {"__n": "__upto"}, descending=False)
    ranks = run.agg(*[(F.lit(q) * (F.sum("__n") - 1)).alias(f"__r_{name}") for name, q in shares.items()])
    at = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col("__v")))
    beside = run.crossJoin(F.broadcast(ranks)).agg(  # one row of ranks
        *[x for name in shares for r in [F.col(f"__r_{name}")] for x in (at(F.floor(r)).alias(f"__l_{name}"), at(F.ceil(r)).alias(f"__h_{name}"), F.max(r - F.floor(r)).alias(f"__p_{name}"))]
    )
    return beside.select(*[(F.col(f"__l_{n}") + F.col(f"__p_{n}") * (F.col(f"__h_{n}") - F.col(f"__l_{n}"))).alias(n) for n in shares])


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which a null key meets a null key."""
    other = right
    for k in keys:
        other = other.withColumnRenamed(k, f"__k_{k}")
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return left.join(other, condition, how).drop(*[f"__k_{k}" for k in keys])


def hash_key(identity: Column, seed: str = "") -> Column:
    """Hexadecimal SHA-256 of `seed` followed by the identity: a stable pseudo-random order."""
    return F.sha2(F.concat(F.lit(seed), F.coalesce(identity.cast("string"), F.lit(""))), 256)


def _bucketed(df: DataFrame, identity: str, seed: str, digits: int) -> DataFrame:
    return df.withColumn("__h", hash_key(F.col(identity), seed)).withColumn(
        "__hb", F.substring("__h", 1, digits)
    )


def _offsets(df: DataFrame, by: Sequence[str]) -> DataFrame:
    before = Window.partitionBy(*by).orderBy("__hb").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*by, "__hb").agg(F.count(F.lit(1)).alias("__n"))
    return counts.select(*by, "__hb", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))


def hash_rank(
    df: DataFrame, by: Sequence[str], identity: str, *, seed: str = "", out: str = "rank", digits: int = HASH_DIGITS
) -> DataFrame:
    """Exact 1-based rank of every row inside its group, in hash order.

    Ranks are built from per-bucket counts, so even a group with a third of all rows is spread
    over thousands of independent sorts.
    """
    rows = _bucketed(df, identity, seed, digits)
    inside = Window.partitionBy(*by, "__hb").orderBy("__h", identity)
    return (
        null_safe_join(rows.withColumn("__rn", F.row_number().over(inside)), _offsets(rows, by), [*by, "__hb"])
        .withColumn(out, (F.col("__off") + F.col("__rn")).cast("long"))
        .select(*df.columns, out)
    )


def take_by_hash(
    df: DataFrame, by: Sequence[str], identity: str, quotas: DataFrame, *, seed: str = "", digits: int = HASH_DIGITS
) -> DataFrame:
    """The first `quota` rows of each group in hash order; `quotas` has the group columns and `quota`.

    Buckets wholly beyond the quota are dropped before anything is sorted.
    """
    rows = _bucketed(df, identity, seed, digits)
    wanted = null_safe_join(_offsets(rows, by), quotas, by).filter(F.col("__off") < F.col("quota"))
    inside = Window.partitionBy(*by, "__hb").orderBy("__h", identity)
    return (
        null_safe_join(rows, wanted, [*by, "__hb"])
        .withColumn("__rn", F.row_number().over(inside))
        .filter(F.col("__off") + F.col("__rn") <= F.col("quota"))
        .select(*df.columns)
    )
