"""Mixing of sources by temperature: exponentiated token shares, met by whole passes and block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldsift.llm.common import keep

#: Wanted entropy of the source weights, as a share of the greatest possible one.
ENTROPY = 0.95
#: A document comes so often at most.
REPEATS = 4.0
#: Documents in a block of a source's permutation, on average.
BLOCK = 1024
SEED = 29
_POINTS = 31  # of an interval looked at together: five halvings of it in one aggregate
_PASSES = 8


def _key(source: str = "source") -> Column:
    """The source as a key that is never null: a missing source is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("~"))


def _order() -> Column:
    return F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"))


def _block(blocks: str = "blocks") -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("doc_id").cast("long")), F.col(blocks))


def _block_order(block: str = "block") -> Column:
    return F.xxhash64(F.lit(SEED + 2), F.col("key"), F.col(block))


def counted(docs: DataFrame) -> DataFrame:
    """`doc_id, key, tokens` of every row: words between ASCII white space (null text: none)."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), F.size(words).cast("long").alias("tokens"))


@dataclass(frozen=True)
class Temperature:
    exponent: float
    entropy: float  # of the weights, as a share of the greatest possible one
    repeats: float  # passes over the source that is repeated most


def temperature(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> Temperature:
    """The largest exponent between 0 and 1 that meets the wanted entropy, raised where `repeats` asks for it.

    `sources` has one row a source with its `tokens`. Weights are the shares to the power of the exponent,
    normalised; their entropy falls as it rises. The interval is halved five times in each pass: one aggregate
    evaluates the points in between, so the sources never leave Spark. The limit on repeats wins over the
    entropy. Sources without tokens have no weight; with one source or none the exponent is 1.
    """
    full = sources.filter("tokens > 0")
    top = full.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("most"), F.min("tokens").alias("least"), F.count("*").alias("n")).first()
    if top.n < 2 or top.most == top.least:
        return Temperature(1.0, 1.0, 1.0)
    p = full.select((F.col("tokens") / F.lit(float(top.all))).alias("p"))
    greatest, spread = math.log(top.n), math.log(top.most / top.least)

    def entropies(points: list[float]) -> list[float]:
        sums = []
        for i, a in enumerate(points):
            sums += [F.sum(F.pow("p", F.lit(a))).alias(f"s{i}"), F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"t{i}")]
        r = p.agg(*sums).first()
        return [(math.log(r[f"s{i}"]) - a * r[f"t{i}"] / r[f"s{i}"]) / greatest for i, a in enumerate(points)]

    low, high = 0.0, 1.0  # at `low` the entropy suffices
    if entropies([1.0])[0] >= entropy:
        low = 1.0
    else:
        for _ in range(_PASSES):
            points = [low + (high - low) * i / (_POINTS + 1) for i in range(1, _POINTS + 1)]
            enough = [a for a, h in zip(points, entropies(points), strict=True) if h >= entropy]
            width = (high - low) / (_POINTS + 1)
            low = max(enough, default=low)
            high = low + width
    # bisect the exponent at which the rarest source is repeated as often as allowed
    under, over = 0.0, 1.0
    for _ in range(60):
        mid = (under + over) / 2
        under, over = (under, mid) if math.exp(spread * (1 - mid)) <= repeats else (mid, over)
    exponent = min(1.0, round(max(low, over if math.exp(spread) > repeats else 0.0), 9))
    return Temperature(exponent, entropies([exponent])[0], math.exp(spread * (1 - exponent)))


def decisions(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """One row a source: how often it is passed through, and where its last, partial pass ends.

    `key, tokens, epochs, whole, blocks, cut_block, cut_order`. The budget is the smallest one that reaches the
    weights with every document at least once, so nothing is lost. The partial pass takes the blocks of the
    source's permutation that its budget holds, and of the next block the documents that still fit.
    """
    rows = keep(counted(docs), "tokens")
    sources = keep(rows.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    heat = temperature(sources, entropy, repeats)
    most = sources.agg(F.max("tokens")).first()[0] or 0
    ratio = F.lit(float(most)) / F.col("tokens")
    epochs = F.when(F.col("tokens") > 0, F.round(F.pow(ratio, F.lit(1 - heat.exponent)), 9)).otherwise(F.lit(1.0))
    plan = sources.select(
        "key",
        "tokens",
        epochs.alias("epochs"),
        F.floor(epochs).alias("whole"),
        F.floor((epochs - F.floor(epochs)) * F.col("tokens")).alias("budget"),
        F.ceil(F.col("docs") / BLOCK).alias("blocks"),
    )
    dealt = rows.join(plan.filter("budget > 0").select("key", "budget", "blocks"), "key").withColumn("block", _block())
    blocks = dealt.groupBy("key", "budget", "block").agg(F.sum("tokens").alias("n")).withColumn("bo", _block_order())
    before = Window.partitionBy("key").orderBy("bo", "block").rowsBetween(Window.unboundedPreceding, -1)
    run = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cut = run.filter("before <= budget and before + n > budget").select("key", "block", "bo", (F.col("budget") - F.col("before")).alias("rest"))
    inside = dealt.select("key", "block", "doc_id", "tokens").join(cut, ["key", "block"]).withColumn("o", _order())
    # rows of equal order (repeated ids) stand or fall together
    so_far = Window.partitionBy("key").orderBy("o").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = inside.withColumn("sum", F.sum("tokens").over(so_far)).filter("sum <= rest")
    ends = fits.groupBy("key").agg(F.max("o").alias("cut_order"))
    out = plan.join(cut.select("key", F.col("bo").alias("cut_block")), "key", "left").join(ends, "key", "left")
    return keep(out.select("key", "tokens", "epochs", "whole", "blocks", "cut_block", "cut_order"), "decisions")


def _repeated(docs: DataFrame, entropy: float, repeats: float) -> DataFrame:
    """The rows of `docs` as often as the mixture has them, with `__pass`, `__block` and `__order`."""
    plan = decisions(docs, entropy, repeats)
    names = {c: f"__{c}" for c in ("key", "whole", "blocks", "cut_block", "cut_order")}
    plan = plan.select(*[F.col(c).alias(n) for c, n in names.items()])
    rows = docs.withColumn("__source", _key()).join(plan, F.col("__source") == F.col("__key"))
    order, block = _order(), F.xxhash64(F.lit(SEED + 2), F.col("__key"), _block("__blocks"))
    taken = (block < F.col("__cut_block")) | ((block == F.col("__cut_block")) & (order <= F.col("__cut_order")))
    count = F.col("__whole") + F.when(taken, 1).otherwise(0)
    passes = F.explode(F.sequence(F.lit(1).cast("long"), count))
    return rows.select(*docs.columns, block.alias("__block"), order.alias("__order"), passes.alias("__pass"))


def mixed(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """`doc_id, source, pass, order_key`: each document as often as the mixture has it, `pass` from 1.

    `order_key` orders a pass at random, by blocks of a source and within them. Documents are sent nowhere
    unless there are very many sources: the table of decisions has a row for each, and Spark broadcasts it only
    while its files are small. A missing source is a source; a null text has no tokens and stays once; repeated
    rows each count; an empty table gives no row.
    """
    own = docs.select("doc_id", "source", "text")
    key = F.xxhash64("__pass", "__block", "__order").alias("order_key")
    return _repeated(own, entropy, repeats).select("doc_id", "source", F.col("__pass").cast("int").alias("pass"), key)


def mixed_rows(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """The rows of `docs`, all columns as they are, each as often as the mixture has it; none is lost."""
    return _repeated(docs, entropy, repeats).select(*docs.columns)
