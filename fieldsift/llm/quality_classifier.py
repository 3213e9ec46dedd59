"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.common import LABEL_ROWS, labelled_ids, remainder, texts

BUCKETS = 8192  # words are hashed to so many rows of vectors
WIDTH = 64
NONZERO = 8  # of an index vector, half of them -1
WINDOW = 2  # neighbours on either side
HIDDEN = 32
GOOD_AT = 0.7
HELD_OUT = (4, 2)  # modulus, remainder
_REMEMBERED = 500_000
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")
_STEP = 400_000  # tokens handled at once
#: Marks between documents: a row of zeros.
_GAP = np.full(WINDOW, BUCKETS, np.int64)


class Tokens:
    """Bucket numbers of the tokens of a text: letters, digits and other marks apart, capitals as one token."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _bucket(self, token: str) -> int:
        if len(token) > 1 and token.isupper():
            token = "\x00upper"
        elif token[0].isdigit():
            token = "\x00number"
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        return zlib.crc32(token.lower().encode()) % BUCKETS

    def of(self, text: str) -> list[int]:
        known, out = self.known, []
        for token in _TOKEN.findall(text):
            at = known.get(token)
            if at is None:
                at = self._bucket(token)
                known[token] = at
            out.append(at)
        return out


def index_vectors(seed: int = 17) -> np.ndarray:
    """A sparse ternary vector for each bucket, the same in every task, and one of zeros for gaps."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS + 1, WIDTH), np.int8)
    places = rng.random((BUCKETS, WIDTH)).argsort(axis=1)[:, :NONZERO]
    signs = np.where(np.arange(NONZERO) % 2, 1, -1).astype(np.int8)
    np.put_along_axis(out[:BUCKETS], places, np.broadcast_to(signs, places.shape), axis=1)
    return out


def _context_sums(batches):
    """Per bucket: occurrences and the sum of its neighbours' index vectors, over all batches of a task."""
    index, of = index_vectors(), Tokens().of
    total, count = np.zeros((BUCKETS + 1, WIDTH), np.int64), np.zeros(BUCKETS + 1, np.int64)

    def add(parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        ids, own = (np.concatenate([_GAP, *x, _GAP]) for x in zip(*parts, strict=True))
        vec = index[ids]
        near = np.zeros_like(vec)
        for d in range(1, WINDOW + 1):
            near[d:] += vec[:-d]
            near[:-d] += vec[d:]
        order = np.argsort(own.astype(np.uint16), kind="stable")
        first = np.unique(own[order], return_index=True)[1]
        total[own[order][first]] += np.add.reduceat(near[order], first, axis=0, dtype=np.int64)
        np.add(count, np.bincount(own, minlength=BUCKETS + 1), out=count)

    held, size = [], 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            ids = np.asarray(of(text), np.int64)
            for at in range(0, len(ids), _STEP):
                low, high = max(0, at - WINDOW), min(len(ids), at + _STEP + WINDOW)
                own = np.full(high - low, BUCKETS)  # of a very long text's parts, neighbours only lend their vectors
                own[at - low : at - low + _STEP] = ids[at : at + _STEP]
                own[min(len(ids), at + _STEP) - low :] = BUCKETS
                held += [(ids[low:high], own), (_GAP, _GAP)]
                size += high - low
                if size >= _STEP:
                    add(held)
                    held, size = [], 0
    if held:
        add(held)
    at = np.nonzero(count[:BUCKETS])[0]
    if at.size:
        columns = {"bucket": pa.array(at, pa.int32()), "n": count[at]}
        yield pa.RecordBatch.from_pydict(columns | {f"v{i}": total[at, i] for i in range(WIDTH)})


@dataclass(frozen=True)
class Vectors:
    """Unit word vectors by bucket, and the weight of each in a document's mean (frequent ones count less)."""

    unit: np.ndarray
    weight: np.ndarray


def word_vectors(docs: DataFrame) -> Vectors:
    """Random indexing over the whole corpus: sums in Spark, a table of BUCKETS x WIDTH on the driver."""
    names = [f"v{i}" for i in range(WIDTH)]
    schema = "bucket int, n long, " + ", ".join(f"{c} long" for c in names)
    parts = texts(docs).select("text").mapInArrow(_context_sums, schema)
    got = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).toArrow()
    unit, weight = np.zeros((BUCKETS, WIDTH), np.float32), np.zeros(BUCKETS, np.float32)
    if got.num_rows:
        at, n = got.column("bucket").to_numpy(), got.column("n").to_numpy().astype(float)
        v = np.stack([got.column(c).to_numpy() for c in names], axis=1).astype(float)
        v /= n[:, None]
        v -= (v * n[:, None]).sum(axis=0) / n.sum()  # what all words share tells nothing
        unit[at] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        weight[at] = 1e-2 / (1e-2 + n / n.sum())
    return Vectors(unit, weight)


POOLED = 2 * WIDTH + 3


def pool(texts_: list[str], vectors: Vectors, tokens: Tokens) -> np.ndarray:
    """One row per text: weighted mean and spread of its word vectors, their resultant's length, the log length."""
    out = np.zeros((len(texts_), POOLED), np.float32)
    for row, text in zip(out, texts_, strict=True):
        ids = np.asarray(tokens.of(text), np.int64)
        if not ids.size:
            continue
        total, square, mass = np.zeros(WIDTH), np.zeros(WIDTH), 0.0
        for at in range(0, ids.size, _STEP):
            u, w = vectors.unit[ids[at : at + _STEP]], vectors.weight[ids[at : at + _STEP]]
            total, square, mass = total + w @ u, square + w @ (u * u), mass + float(w.sum())
        mean = total / max(mass, 1e-9)
        row[:WIDTH] = mean
        row[WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(square / max(mass, 1e-9) - mean**2, 0))
        row[2 * WIDTH :] = np.linalg.norm(mean), mass / ids.size, np.log1p(ids.size)
    return out


@dataclass(frozen=True)
class Network:
    """Standardised inputs, tanh units, one logit, divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, *, epochs: int = 60, rate: float = 3e-3, l2: float = 1e-3, seed: int = 5) -> Network:
    """Fit by Adam on four fifths of the rows; the rest stops the training and sets the temperature."""
    rng = np.random.default_rng(seed)
    bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    zero = Network(np.zeros(POOLED), np.ones(POOLED), np.zeros((POOLED, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), bias)
    if len(np.unique(y)) < 2 or len(y) < 10:
        return zero
    order = rng.permutation(len(y))
    test, rows = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[rows].mean(axis=0), x[rows].std(axis=0) + 1e-3
    z = (x - mean) / scale
    p = [rng.normal(0, POOLED**-0.5, (POOLED, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(bias)]
    m, v, step, best = [0.0 * a for a in p], [0.0 * a for a in p], 0, (np.inf, p)

    def loss(logit: np.ndarray, label: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, logit) - label * logit))

    for _ in range(epochs):
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // 128)):
            a, t = z[part], y[part]
            h = np.tanh(a @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - t) / len(part)
            back = np.outer(err, p[2]) * (1 - h * h)
            grads = [a.T @ back + l2 * p[0], back.sum(axis=0), h.T @ err + l2 * p[2], err.sum()]
            step += 1
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        now = loss(np.tanh(z[test] @ p[0] + p[1]) @ p[2] + p[3], y[test]) if len(test) else 0.0
        if now < best[0]:
            best = (now, [np.copy(q) for q in p])
    net = Network(mean, scale, best[1][0], best[1][1], best[1][2], float(best[1][3]))
    grid = np.geomspace(0.25, 8, 61)
    logit = net.logits(x[test])
    temperature = float(grid[np.argmin([loss(logit / t, y[test]) for t in grid])])
    return Network(net.mean, net.scale, net.w1, net.b1, net.w2, net.b2, temperature)


def fit(docs: DataFrame, labels: DataFrame, vectors: Vectors, usable: Column | None = None, rows: int = LABEL_ROWS) -> Network:
    """Train on at most `rows` labelled documents, the first in hash order of the ids that are `usable`.

    A document that comes several times counts once. Without both labels the network gives the prior alone.
    """
    sample = labelled_ids(labels, "quality", usable, rows)
    # at most `rows` ids with a number each, so the broadcast has a proven bound
    named = texts(docs).join(F.broadcast(sample), "doc_id")
    once = named.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def pooled(batches):
        tokens = Tokens()
        for batch in batches:
            x = pool(batch.column("text").to_pylist(), vectors, tokens)
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    got = once.mapInArrow(pooled, "label int, x binary").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, POOLED).astype(float)
    # the rows come in no certain order, but the fit must not depend on it
    order = np.lexsort(x.T[:8])
    return train(x[order], got.column("label").to_numpy().astype(float)[order])


def score(docs: DataFrame, vectors: Vectors, net: Network, good_at: float = GOOD_AT) -> DataFrame:
    """`doc_id, held_out, score, predicted` for every row; null and empty texts are pooled to zeros and scored.

    Only the text counts. Rows are scored one by one: repeated rows alike, rows without id with a null
    `held_out`; an empty table gives no row.
    """

    def run(batches):
        tokens = Tokens()
        for batch in batches:
            p = net.probability(pool(batch.column("text").to_pylist(), vectors, tokens).astype(float))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (remainder(HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"),
        "score",
        (F.col("score") >= good_at).cast("int").alias("predicted"),
    )
