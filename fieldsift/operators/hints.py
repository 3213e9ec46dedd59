"""Nearest-neighbour hints: an index of cells over unit vectors, of which each query visits the nearest few."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldsift.operators.neighbours import unit
from fieldsift.scale import hash_key, materialise

#: Cells an index may have at most, and vectors a cell that its centres are fitted on; all vectors are indexed.
MOST_CELLS, FITTED = 1024, 32
#: Share of the true neighbours of `MEASURED` vectors that a visit of enough cells must hold, and their number.
RECALL, MEASURED = 0.95, 512
#: Vectors, and queries, that one task compares at a time.
BLOCK = 4096
#: Digits of a cosine, so that equal vectors tie.
DIGITS = 12


def fit_centres(rows: DataFrame, *, cells: int | None = None, seed: int = 17) -> np.ndarray:
    """Unit centres of the cells, from the first vectors in hash order: `cells x FITTED` of them at most.

    As many cells as the square root of the table's size by default. `rows`: `id`, unit vector `u`, one length.
    """
    many = rows.count()
    if not many:
        return np.zeros((0, 0))
    cells = min(cells or math.ceil(math.sqrt(many)), MOST_CELLS, many)
    if cells == 1:
        return np.ones((1, len(rows.first()["u"])))
    sample = rows.withColumn("h", hash_key(F.col("id"), str(seed))).orderBy("h").limit(cells * FITTED)
    points = materialise(sample.select(array_to_vector("u").alias("x")))
    model = KMeans(featuresCol="x", k=cells, maxIter=8, seed=seed, distanceMeasure="cosine").fit(points)
    centres = np.array(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def nearest_cells(rows: DataFrame, centres: np.ndarray, visits: int) -> DataFrame:
    """`rows` (`id`, `u`) once for each of the `visits` cells whose centres are nearest; `place` counts them from 1."""
    visits = min(visits, len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("u").flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, centres.shape[1]))
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :visits].astype(np.int32)
            for v in range(visits):
                place = pa.array(np.full(batch.num_rows, v + 1, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("u"), pa.array(near[:, v]), place], ["id", "u", "cell", "place"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "u").mapInArrow(run, f"id {kind}, u array<double>, cell int, place int")


def _dealt(rows: DataFrame, name: str, block: int) -> DataFrame:
    """`rows` with the block of their cell they fall in; a crowded cell has more blocks, not larger ones."""
    blocks = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("many"))
    # one row a cell, so never above MOST_CELLS rows
    return rows.join(F.broadcast(blocks), "cell").withColumn(name, F.pmod(F.xxhash64("id"), F.col("many")).cast("int")).drop("many")


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("cell").agg((F.max(name) + 1).alias("many"))


def nearest_in_cells(index: DataFrame, queries: DataFrame, top: int, *, block: int = BLOCK) -> DataFrame:
    """`id, rank, near, cosine`: the `top` vectors of the visited cells by cosine, ties to the smaller id, never the query itself."""
    data, asked = materialise(_dealt(index, "d", block)), materialise(_dealt(queries, "q", block))
    every = lambda of, name: of.withColumn(name, F.explode(F.sequence(F.lit(0), F.col("many") - 1))).drop("many")
    # each block of queries meets each block of data of its cell; the counts have a row a cell
    left = every(data.join(F.broadcast(_blocks(asked, "q")), "cell"), "q")
    right = every(asked.join(F.broadcast(_blocks(data, "d")), "cell"), "d")
    kind = index.schema["id"].dataType.simpleString()

    def solve(have: pa.Table, ask: pa.Table) -> pa.Table:
        ids, of = have.column("id").combine_chunks(), ask.column("id").combine_chunks()
        if not len(ids) or not len(of):
            return pa.table({"id": of.slice(0, 0), "near": ids.slice(0, 0), "cosine": pa.array([], pa.float64())})
        matrix = lambda t: t.column("u").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        x, order = matrix(have), np.empty(len(ids), np.int64)
        order[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        codes = {v: n for n, v in enumerate(ids.to_pylist())}
        own = np.array([codes.get(v, -1) for v in of.to_pylist()])
        rows, cols, scores = [], [], []
        y = matrix(ask)
        for at in range(0, len(of), 256):
            part = np.round(y[at : at + 256] @ x.T, DIGITS)
            mine = own[at : at + 256]
            part[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -np.inf
            least = np.partition(part, -top, axis=1)[:, -top] if len(ids) > top else np.full(len(part), -2.0)
            r, c = np.nonzero((part >= least[:, None]) & (part > -np.inf))
            by = np.lexsort((order[c], -part[r, c], r))
            r, c = r[by], c[by]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            keep = place < top
            rows.append(r[keep] + at), cols.append(c[keep]), scores.append(part[r, c][keep])
        take = lambda values, at: values.take(pa.array(np.concatenate(at)))
        return pa.table({"id": take(of, rows), "near": take(ids, cols), "cosine": pa.array(np.concatenate(scores))})

    keys = ["cell", "d", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solve, f"id {kind}, near {kind}, cosine double")
    best = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "near")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("id", "rank", "near", "cosine")


def visits_needed(rows: DataFrame, index: DataFrame, centres: np.ndarray, top: int, *, recall: float = RECALL, measured: int = MEASURED, seed: int = 18) -> int:
    """Nearest cells that hold `recall` of the true `top` neighbours of the first `measured` vectors in hash order.

    Those neighbours are found by visiting every cell, so the number follows the data: few cells where vectors
    lie in clusters, most of them where they do not.
    """
    some = materialise(rows.withColumn("h", hash_key(F.col("id"), str(seed))).orderBy("h").limit(measured).select("id", "u"))
    everywhere = nearest_cells(some, centres, len(centres))
    true = nearest_in_cells(index, everywhere, top).select("id", "near")
    held = true.join(index.select(F.col("id").alias("near"), "cell"), "near").join(everywhere.select("id", "cell", "place"), ["id", "cell"])
    places = {r.place: r.n for r in held.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell at most
    so_far, total = 0, sum(places.values())
    for place in sorted(places):
        so_far += places[place]
        if so_far >= recall * total:
            return place
    return 1


def neighbour_hints(
    known: DataFrame, asked: DataFrame, *, key: str = "fileId", emb: str = "emb", cls: str = "cls", top: int = 5, visits: int | None = None, cells: int | None = None, block: int = BLOCK
) -> DataFrame:
    """`key, rank, near, cosine, cls`: for each asked photo the nearest known ones and their classes, as a hint for a reviewer.

    Every known vector is indexed. A query visits the nearest `visits` cells (by default as many as `visits_needed`
    measures); with as many as there are cells the result is exact. Null, empty and zero vectors, those with components that
    are no numbers and rows without key take no part; each length of vector is answered among its own. `key` must
    be unique on either side.
    """
    def clean(rows: DataFrame, *more: str) -> DataFrame:
        out = rows.select(F.col(key).alias("id"), unit(F.col(emb)).alias("u"), *more)
        whole = F.col("u").isNotNull() & (F.size("u") > 0) & ~F.exists("u", lambda v: v.isNull() | F.isnan(v))
        return out.filter(F.col("id").isNotNull() & whole).withColumn("size", F.size("u"))

    data, queries = materialise(clean(known, F.col(cls).alias("cls"))), materialise(clean(asked))
    # the distinct lengths of vectors: one a model
    lengths = [r["size"] for r in queries.select("size").distinct().join(data.select("size").distinct(), "size").orderBy("size").collect()]
    parts = None
    for size in lengths:
        own, ask = data.filter(F.col("size") == size), queries.filter(F.col("size") == size)
        centres = fit_centres(own, cells=cells)
        index = materialise(nearest_cells(own, centres, 1))
        several = visits or visits_needed(own, index, centres, top)
        found = nearest_in_cells(index, nearest_cells(ask, centres, several), top, block=block)
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        parts = queries.select("id", F.lit(1).alias("rank"), F.col("id").alias("near"), F.lit(0.0).alias("cosine")).limit(0)
    named = data.select(F.col("id").alias("near"), "cls")
    return parts.join(named, "near").select(F.col("id").alias(key), "rank", "near", "cosine", "cls")
