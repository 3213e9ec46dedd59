"""Near-duplicates among embeddings: banded random hyperplanes propose pairs, the cosine decides."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldsift.scale import materialise

#: Cosine above which two photos count as the same picture.
SAME = 0.98
#: Chance that a pair at the threshold is proposed by no band.
MISS = 1e-9
#: Vectors in a bucket that are compared pair by pair; those of a larger one are told apart by more hyperplanes.
CROWD = 64
#: Hyperplanes of the first bands beyond the binary digits of the table's size: unlike vectors seldom share a bucket,
#: and a pair costs its two vectors, a longer band only some more keys.
MORE_BITS = 5
#: Hyperplanes a band gains at each such turn, and the most it may have: vectors that agree on so many all but coincide.
STEP, MOST_BITS = 6, 40
SEED = 17


def bands_needed(bits: int, cosine: float = SAME, miss: float = MISS) -> int:
    """Bands of `bits` hyperplanes, one of which holds a pair of this cosine together but for `miss`."""
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log1p(-together))


def unit(emb: Column) -> Column:
    """The vector as doubles of length 1; null where it has no direction or a component that is no number."""
    x = emb.cast("array<double>")
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.when((length > 0) & (length < float("inf")), F.transform(x, lambda v: v / length))


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _keys(rows: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    """`id, key` of every vector: the band, and which side of each of its hyperplanes the vector lies on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            flat, sizes = batch.column("u").flatten().to_numpy(), batch.column("u").value_lengths().to_numpy()
            ends = np.append(0, np.cumsum(sizes))
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).standard_normal((size, bands * bits))
                x = flat[(ends[own][:, None] + np.arange(size)).ravel()].reshape(len(own), size)
                # a few bands at a time, so that memory does not grow with their number
                for at in range(0, bands, 16):
                    some = min(16, bands - at)
                    sides = (x @ planes[size][:, at * bits : (at + some) * bits] > 0).reshape(len(own), some, bits)
                    keys = (sides @ weights) | (np.arange(at, at + some, dtype=np.int64) << bits)
                    ids = batch.column("id").take(pa.array(np.repeat(own, some)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(keys.ravel())], ["id", "key"])

    return rows.select("id", "u").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key long")


def candidates(rows: DataFrame, least: float = SAME, miss: float = MISS, crowd: int = CROWD) -> DataFrame:
    """Distinct pairs `a < b` of `rows` (`id`, unit vector `u`) that some bucket holds together.

    The first bands have MORE_BITS hyperplanes more than the table's size has binary digits. Vectors of a crowded bucket
    meet again in bands of more hyperplanes, again enough of them for `miss`, so a crowd costs more bands, not
    more pairs that have nothing in common; no pair is given up.
    """
    bits, turn, pairs = max(8, math.ceil(math.log2(max(2, rows.count()))) + MORE_BITS), 0, None
    while True:
        last, id_ = bits >= MOST_BITS, F.col("id")
        # the keys move once; only buckets of several vectors are stored, and a crowd's rows never meet in one
        size = F.count(F.lit(1)).over(Window.partitionBy("key"))
        held = materialise(_keys(rows, bits, bands_needed(bits, least, miss), SEED + turn).withColumn("n", size).filter("n > 1"))
        small = held if last else held.filter(F.col("n") <= crowd)
        found = small.select("key", id_.alias("a")).join(small.select("key", id_.alias("b")), "key").filter("a < b")
        found = found.select("a", "b").distinct()
        pairs = found if pairs is None else pairs.unionByName(found)
        if last:
            return pairs.distinct()
        crowded = materialise(held.filter(F.col("n") > crowd).select("id").distinct())
        if crowded.isEmpty():
            return pairs.distinct()
        rows = materialise(rows.join(crowded, "id", "left_semi"))
        bits, turn = min(MOST_BITS, bits + STEP), turn + 1


def near_duplicates(vectors: DataFrame, *, key: str = "fileId", emb: str = "emb", part: str = "part", least: float = SAME, crowd: int = CROWD) -> DataFrame:
    """`a, b, cosine, crossPart`: pairs of a cosine above `least`, and whether they lie in different parts.

    Equal vectors are paired with the first of them only (cosine 1); all other pairs are between those firsts.
    Null, empty and zero vectors, and those of different length, are near to nothing.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(part).alias("part"), F.col(emb).alias("raw"), unit(F.col(emb)).alias("u"))
    rows = materialise(rows.filter(F.col("u").isNotNull() & (F.size("u") > 0) & F.col("id").isNotNull()))
    firsts = materialise(rows.groupBy("raw").agg(F.min_by(F.struct("id", "part", "u"), "id").alias("r")).select("raw", "r.*"))
    copies = rows.join(firsts.select("raw", F.col("id").alias("a"), F.col("part").alias("pa")), "raw").filter(F.col("id") != F.col("a"))
    out = copies.select("a", F.col("id").alias("b"), F.lit(1.0).alias("cosine"), (~F.col("pa").eqNullSafe(F.col("part"))).alias("crossPart"))
    side = lambda name: firsts.select(F.col("id").alias(name), F.col("part").alias(f"p{name}"), F.col("u").alias(f"u{name}"))
    compared = candidates(firsts, least, crowd=crowd).join(side("a"), "a").join(side("b"), "b").filter(F.size("ua") == F.size("ub"))
    near = compared.withColumn("cosine", cosine(F.col("ua"), F.col("ub"))).filter(F.col("cosine") > least)
    return out.unionByName(near.select("a", "b", "cosine", (~F.col("pa").eqNullSafe(F.col("pb"))).alias("crossPart")))
