"""Exact top-k by inner product: a Voronoi join of queries and data over pivots."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldsift.llm.common import keep

SCALE = 1024
NEIGHBOURS = 10
PIVOTS = 64
#: Rows that a task solves against its queries at once; a larger cell is dealt to several tasks.
BLOCK = 4096
#: Queries handled together, likewise; small query cells are handled together up to this number.
QUERY_BLOCK = 1024
#: Components after scaling are below this, and vectors no longer than this squared: else scores would not fit in a
#: long, which is an error.
LIMIT, LONGEST = 1 << 31, 2.0**62
#: Bounds are widened by this part, for rounding in the distances.
SLACK = 1e-6


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """`vec_id, q`: floor(scale * x) of every component as whole number, of usable vectors only.

    A vector that is null or empty, or holds a null or non-finite component, is left out, and so is a row
    without id. A component too large for a score that is a long is an error, never a changed one.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    own = own.filter("vec_id is not null and size(x) > 0").filter(finite)
    whole = F.transform("x", lambda v: F.floor(v * scale).cast("int"))
    fits = F.forall("x", lambda v: F.abs(v) * scale < float(LIMIT))
    return own.select("vec_id", F.when(fits, whole).otherwise(F.raise_error(F.lit("a component is too large for scores to fit in a long"))).alias("q"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def _lifted(x: np.ndarray, norm2: float, query: bool) -> np.ndarray:
    """One more component, which makes all data vectors equally long, so that near means a high inner product."""
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1), 0))
    return np.concatenate([x, more[:, None]], axis=1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0))


def _celled(rows: DataFrame, pivots: np.ndarray, norm2: float, query: bool) -> DataFrame:
    """Adds the cell (the nearest pivot) of each row and the distance to its pivot."""

    def run(batches):
        for batch in batches:
            q = batch.column("q")
            if not batch.num_rows:
                continue
            d = _distances(_lifted(_matrix(q), norm2, query), pivots)
            cell = d.argmin(axis=1)
            columns = [batch.column("vec_id"), q, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "q", "cell", "far"])

    return rows.mapInArrow(run, "vec_id long, q array<int>, cell int, far double")


def reachable(
    pivots: np.ndarray, data: pd.DataFrame, nearest: pd.DataFrame, queries: pd.DataFrame, k: int, unit: float
) -> pd.DataFrame:
    """`query_cell, cell, low`: the data cells that a query cell needs, and how far from its pivot data must lie.

    `data` has `cell, near, far` (least and greatest distance to the pivot), `nearest` the k + 1 smallest
    distances of each cell over different ids, `queries` the greatest distance of each query cell. For any query of a cell the
    k-th neighbour is at most `bound` away: its distance to its pivot, between the pivots, and from there to
    the data. Data at distance d from its pivot cannot be nearer than pivots' distance - query's radius - d
    nor than d - (pivots' distance + radius).
    """
    out = []
    between = _distances(pivots, pivots)
    for query in queries.itertuples():
        reach = query.far + between[query.cell]
        ways = np.sort(reach[nearest.cell.to_numpy()] + nearest.dist.to_numpy())
        bound = (ways[k] if len(ways) > k else np.inf) * (1 + SLACK) + SLACK * unit
        gap = between[query.cell][data.cell.to_numpy()]
        low, high = gap - query.far - bound, gap + query.far + bound
        need = (data.far.to_numpy() >= low) & (data.near.to_numpy() <= high)
        for cell, a, b in zip(data.cell.to_numpy()[need], low[need], high[need], strict=True):
            out.append((int(query.cell), int(cell), float(a), float(b)))
    return pd.DataFrame(out, columns=["query_cell", "cell", "low", "high"])


def grouped(cells: pd.DataFrame, pivots: np.ndarray, most: int = QUERY_BLOCK) -> dict[int, int]:
    """A group for each query cell; neighbouring cells share one, so that data is sent once to all of them."""
    left = {int(c): int(n) for c, n in zip(cells.cell, cells.n, strict=True)}
    between, groups, number = _distances(pivots, pivots), {}, -1
    at, size = None, most
    while left:
        at = min(left, key=lambda c: (between[at][c] if at is not None else 0.0, c))
        if size + left[at] > most:
            number, size = number + 1, 0
        groups[at], size = number, size + left.pop(at)
    return groups


def _solve(queries: np.ndarray, ids: np.ndarray, data: np.ndarray, names: np.ndarray, k: int) -> list[tuple]:
    """The k best of `data` for each query by whole-number scores, ties to the smaller id, the query itself left out."""
    # products of whole numbers below 2^53 are exact in doubles; larger ones are taken in longs
    small = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * data.shape[1] < 2**53
    out = []
    for at in range(0, len(ids), 256):
        part = queries[at : at + 256]
        s = (part @ data.T).astype(np.int64) if small else part.astype(np.int64) @ data.T.astype(np.int64)
        for row, own in zip(s, ids[at : at + 256], strict=True):
            other = np.nonzero(names != own)[0]
            if other.size > k:
                # everything that ties with the k-th score stays, so that ids decide
                edge = np.partition(row[other], other.size - k)[other.size - k]
                other = other[row[other] >= edge]
            best = other[np.lexsort((names[other], -row[other]))[:k]]
            out += [(int(own), int(names[j]), int(row[j])) for j in best]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, pivots: int = PIVOTS) -> DataFrame:
    """`query_id, rank, vec_id, score`: each query's k best other rows by inner product, ties to the smaller id.

    `is_query` is a condition on `vec_id`. Pivots are `pivots` rows in hash order. Rows are grouped by their
    nearest pivot; from each group's size, distances and k + 1 nearest distances follow the groups, and the part
    of each, that a group of queries can need, and only those are sent to it. A large group is dealt out in
    blocks, each solved on its own to k rows a query, and the blocks' results are merged by an aggregate.

    Vectors of each length are compared among themselves. Unusable rows (see `quantised`) take no part. A query with fewer than k others gets all. A repeated id
    counts as several rows for other queries and asks once for each row; its own rows never answer it. An empty
    table gives no row.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    rows = keep(quantised(vectors), "vectors")
    found = None
    for (length,) in rows.select(F.size("q").alias("n")).distinct().orderBy("n").collect():  # one row a length
        own = _of_one_length(rows.filter(F.size("q") == length), is_query, k, pivots)
        if own is not None:
            found = own if found is None else found.unionByName(own)
    return spark.createDataFrame([], schema) if found is None else found


def _of_one_length(rows: DataFrame, is_query: Column, k: int, pivots: int) -> DataFrame | None:
    spark = rows.sparkSession
    norms = F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    norm2 = rows.agg(F.max(norms)).first()[0]
    if norm2 >= LONGEST:
        raise ValueError("vectors are too long for scores to fit in a long")
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots)
    centre = _lifted(np.array([r.q for r in picked.select("q").collect()], float), norm2, False)
    data = keep(_celled(rows, centre, norm2, False), "cells")
    # a few numbers for each pivot
    summary = data.groupBy("cell").agg(F.min("far").alias("near"), F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).toPandas()
    # one row an id: rows of the query's own id never answer it, so k + 1 ids hold k that do
    each = data.groupBy("vec_id").agg(F.min(F.struct("far", "cell")).alias("x")).select("x.cell", "x.far")
    nearest = _least(each, k + 1).toPandas()
    asked = _celled(rows.filter(is_query), centre, norm2, True)
    asked = keep(asked.withColumn("ask", F.monotonically_increasing_id()), "asked")
    ask_cells = asked.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).toPandas()
    need = reachable(centre, summary, nearest, ask_cells, k, float(np.sqrt(norm2)) + 1)
    if need.empty:
        return None
    # few numbers: one for each pair of cells that need each other, at most pivots x pivots
    groups = grouped(ask_cells, centre)
    need["grp"], ask_cells["grp"] = need.query_cell.map(groups), ask_cells.cell.map(groups)
    ask_blocks = {g: -(-int(n) // QUERY_BLOCK) for g, n in ask_cells.groupby("grp").n.sum().items()}
    data_blocks = {int(c): -(-int(n) // BLOCK) for c, n in zip(summary.cell, summary.n, strict=True)}
    need["ask_blocks"], need["data_blocks"] = need.grp.map(ask_blocks), need.cell.map(data_blocks)
    fields = "cell int, data_blocks int, grp int, ask_blocks int"
    to_group = need.groupby(["cell", "data_blocks", "grp", "ask_blocks"]).agg({"low": "min", "high": "max"}).reset_index()
    to_group = F.broadcast(spark.createDataFrame(to_group, f"{fields}, low double, high double"))
    to_cell = need[["cell", "data_blocks", "grp", "ask_blocks", "query_cell"]]
    to_cell = F.broadcast(spark.createDataFrame(to_cell, f"{fields}, query_cell int"))

    def block(count: str, of: str) -> Column:
        return F.pmod(F.xxhash64(of), F.col(count)).cast("int")

    group = ["grp", "ask_part", "cell", "part"]
    sent = data.join(to_group, "cell").filter("far >= low and far <= high").withColumn("part", block("data_blocks", "vec_id"))
    sent = sent.withColumn("ask_part", F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)))
    sent = sent.select(*group, F.col("vec_id").alias("id"), "q")
    own = asked.withColumnRenamed("cell", "query_cell").join(to_cell, "query_cell")
    own = own.withColumn("ask_part", block("ask_blocks", "ask"))
    own = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("data_blocks") - 1)))
    own = own.select(*group, "ask", F.col("vec_id").alias("id"), "q")

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            # a repeated id asks once here, and its answer is given to each of its rows
            once = left.drop_duplicates("id")
            x, y = (np.array(p["q"].tolist(), float) for p in (once, right))
            out = _solve(x, once["id"].to_numpy(), y, right["id"].to_numpy(), k)
        found = pd.DataFrame(out, columns=["id", "vec_id", "score"])
        return left[["ask", "id"]].merge(found, on="id").rename(columns={"id": "query_id"})

    found = own.groupBy(*group).cogroup(sent.groupBy(*group)).applyInPandas(solve, "ask long, query_id long, vec_id long, score long")
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _least(data: DataFrame, k: int) -> DataFrame:
    """`cell, dist`: the k smallest distances of each cell, each task's own k first."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            cells, far = batch.column("cell").to_numpy(), batch.column("far").to_numpy()
            for c in np.unique(cells):
                held[c] = np.sort(np.concatenate([held.get(c, far[:0]), far[cells == c]]))[:k]
        if held:
            cells = np.concatenate([np.full(len(d), c) for c, d in held.items()])
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int32()), "dist": np.concatenate(list(held.values()))})

    parts = data.select("cell", "far").mapInArrow(run, "cell int, dist double")
    order = Window.partitionBy("cell").orderBy("dist")
    return parts.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("cell", "dist")
