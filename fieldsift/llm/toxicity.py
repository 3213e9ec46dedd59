"""Toxicity: a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.common import by_batch, labelled_ids, remainder, texts

SIZES = (4, 5, 6, 7)
BITS = 20  # n-grams are hashed to so many bits
FEATURES = 8192  # n-grams whose ratio is surest; the linear model has a weight for each
ALPHA = 1.0
TOXIC_AT = 0.5
HELD_OUT = (5, 0)  # modulus, remainder
#: Rows of `labels` for the fit, at most.
SAMPLE = 12_000
_STEP, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)  # odd multipliers, to spread the hash
_NONE = np.empty(0, np.int32)


def grams(text: str) -> np.ndarray:
    """Hashes of all n-grams of the whole text, with repeats.

    Letters alone count, lower-cased; other characters are blanks, and an n-gram may begin or end with one but
    has letters between, so none reaches from one word into the next.
    """
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    letter = ((code >= 97) & (code <= 122)) | (code >= 0xC0)
    letter &= ~(((code >= 0x2000) & (code <= 0x206F)) | ((code >= 0x3000) & (code <= 0x303F)) | (code == 0xD7) | (code == 0xF7))
    code[~letter] = 32
    out = []
    for n in SIZES:
        count = code.size - n + 1
        if count < 1:
            continue
        hashed, inside = code[:count] + np.uint64(n), np.ones(count, bool)
        for i in range(1, n):
            hashed = hashed * _STEP + code[i : i + count]
            if i < n - 1:
                inside &= letter[i : i + count]
        out.append((hashed[inside] * _SPREAD) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int32) if out else _NONE


def weigh(counts: np.ndarray) -> np.ndarray:
    """Weight of an n-gram that occurs so often in a text: 1 for once, rising with the logarithm."""
    return np.log2(1.0 + counts)


def present(text: str, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of the text and their weights; `lookup` maps an n-gram's hash to its feature, or to -1."""
    found = lookup[grams(text)]
    ids, counts = np.unique(found[found >= 0], return_counts=True)
    return ids, weigh(counts)


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # hash of each feature
    weights: np.ndarray  # its coefficient, times its log-count ratio
    bias: float

    def lookup(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int32)
        out[self.features] = np.arange(len(self.features), dtype=np.int32)
        return out


def log_ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Naive Bayes ratio of the weighted counts in the documents of either class, smoothed."""
    return np.log((pos + ALPHA) / (n_pos + 2 * ALPHA)) - np.log((neg + ALPHA) / (n_neg + 2 * ALPHA))


def fit_linear(
    docs: list[np.ndarray], weights: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, l2: float = 1.0, steps: int = 300
) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on weight times ratio, by gradient steps with momentum."""
    n, rows = len(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    cols = np.concatenate([*docs, _NONE]).astype(np.int64)
    x = ratio[cols] * np.concatenate([*weights, np.empty(0)])
    w, v, bias, shift = np.zeros(len(ratio)), np.zeros(len(ratio)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 0.0
    # the norms of the rows bound the curvature
    rate = 1.0 / (0.25 * (np.percentile(np.bincount(rows, x**2, n), 99) + 1) * n**0.5 + l2)
    for _ in range(steps):
        look, at = w + 0.9 * v, bias + 0.9 * shift
        err = 1 / (1 + np.exp(-np.clip(np.bincount(rows, look[cols] * x, n) + at, -40, 40))) - y
        v = 0.9 * v - rate * (np.bincount(cols, err[rows] * x, len(ratio)) + l2 * look)
        shift = 0.9 * shift - rate * float(err.sum())
        w, bias = w + v, bias + shift
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = SAMPLE) -> Model:
    """Fit on at most `rows` labelled documents, the first in hash order of the ids that are `usable`.

    N-gram counts are summed in Spark; the driver gets FEATURES of them and, of each sampled document, the
    features present. A document that comes several times counts once. Without both labels the model is the
    prior alone.
    """
    sample = labelled_ids(labels, "toxic", usable, rows)
    # at most `rows` ids with a number each, so the broadcast has a proven bound
    named = texts(docs).join(F.broadcast(sample), "doc_id")
    once = named.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    count = once.mapInArrow(_counts, "gram int, pos double, neg double, docs_pos long, docs_neg long")
    summed = count.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "docs_pos", "docs_neg")])
    total = summed.filter("gram = -1").first()
    n_pos, n_neg = (total.docs_pos, total.docs_neg) if total else (0, 0)
    bias = float(np.log((n_pos + 1) / (n_neg + 1)))
    if not n_pos or not n_neg:
        return Model(np.empty(0, np.int32), np.empty(0), bias)
    p, n = F.col("pos") + F.lit(ALPHA), F.col("neg") + F.lit(ALPHA)
    ratio = F.log(p / (n_pos + 2 * ALPHA)) - F.log(n / (n_neg + 2 * ALPHA))
    sure = F.abs(ratio) / F.sqrt(1 / p + 1 / n)
    best = summed.filter("gram >= 0 and pos + neg > 2").orderBy(sure.desc(), "gram").limit(FEATURES).toArrow()
    grams = best.column("gram").to_numpy().astype(np.int32)
    if not grams.size:
        return Model(grams, np.empty(0), bias)
    r = log_ratios(best.column("pos").to_numpy(), best.column("neg").to_numpy(), n_pos, n_neg)
    lookup = Model(grams, r, bias).lookup()
    found = by_batch(once, _present, "label int, ids array<int>, weights array<double>", lookup).toArrow()
    y = found.column("label").to_numpy().astype(float)
    ids = [np.asarray(x, np.int32) for x in found.column("ids").to_pylist()]
    w, bias = fit_linear(ids, [np.asarray(x, float) for x in found.column("weights").to_pylist()], y, r)
    return Model(grams, w * r, bias)


def _counts(batches):
    """Document counts of n-grams by class, for all batches of a task; the gram -1 counts the documents."""
    pos, neg, seen = np.zeros(1 << BITS), np.zeros(1 << BITS), [0, 0]
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            ids, counts = np.unique(grams(text), return_counts=True)
            (pos if label else neg)[ids] += weigh(counts)
            seen[label] += 1
    at = np.nonzero(pos + neg)[0]
    if sum(seen):
        yield pa.RecordBatch.from_pydict(
            {
                "gram": pa.array(np.append(at, -1), pa.int32()),
                "pos": np.append(pos[at], 0.0),
                "neg": np.append(neg[at], 0.0),
                "docs_pos": np.append(at * 0, seen[1]),
                "docs_neg": np.append(at * 0, seen[0]),
            }
        )


def _present(columns: dict[str, list], lookup: np.ndarray) -> dict[str, list]:
    ids, weights = zip(*(present(t, lookup) for t in columns["text"]), strict=True) if columns["text"] else ((), ())
    return {"label": columns["label"], "ids": ids, "weights": weights}


def score(docs: DataFrame, model: Model, toxic_at: float = TOXIC_AT) -> DataFrame:
    """`doc_id, held_out, score, predicted` for every row; empty and null texts get the score of the bias.

    Only the text counts. Rows are scored one by one: repeated rows alike, rows without id with a null
    `held_out`; an empty table gives no row.
    """
    weights = model.weights

    def run(batches):
        lookup = model.lookup()
        for batch in batches:
            found = (present(t, lookup) for t in batch.column("text").to_pylist())
            margin = np.array([weights[ids] @ x for ids, x in found], float) + model.bias
            p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (remainder(HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"),
        "score",
        (F.col("score") >= toxic_at).cast("int").alias("predicted"),
    )
