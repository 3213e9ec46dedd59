"""Language-model scores of whole documents: word counts, a recurrent model trained in Spark, and a word join."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift.llm import gru
from fieldsift.llm.common import keep, remainder, texts

HELD_OUT = (7, 2)  # modulus, remainder
END = b""
#: Words whose counts every task holds; the counts of all others come by a join.
KNOWN_WORDS = 65_536
#: Rounds that train the recurrent model, with the step size of each; every document has its turn in one of them.
RATES = (0.01, 0.006, 0.003)
_FLUSH = 250_000
_BLOCK = 64  # parameters in a row of a shuffled average
_MARKS = b".,;:!?"


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered, and the end."""
    out = text.encode("utf-8").lower().split()
    out.append(END)
    return out


def rare_class(word: bytes) -> int:
    """Class of a rarer word, told from its last two letters and the mark behind them."""
    stem = word.rstrip(_MARKS)
    return zlib.crc32(stem.decode("utf-8")[-2:].encode() + b"/" + word[len(stem) :][:1]) % gru.RARE


def _count(batches):
    """Word counts of a task's texts, handed on whenever many words have come together."""

    def out(counts: Counter) -> pa.RecordBatch:
        words = list(counts)
        columns = {"word": pa.array(words, pa.binary()), "rare": pa.array([rare_class(w) for w in words], pa.int32())}
        return pa.RecordBatch.from_pydict(columns | {"c": pa.array(list(counts.values()), pa.int64())})

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update(tokens(text))
            if len(counts) >= _FLUSH:
                yield out(counts)
                counts = Counter()
    if counts:
        yield out(counts)


def word_counts(docs: DataFrame) -> DataFrame:
    """`word binary, rare int, c long` over all tokens of `docs`."""
    parts = texts(docs).select("text").mapInArrow(_count, "word binary, rare int, c long")
    return parts.groupBy("word", "rare").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Model:
    total: int  # tokens learnt from
    distinct: int
    known: dict[bytes, int] = field(repr=False)  # counts of the most frequent words
    frequent: dict[bytes, int] = field(repr=False)  # ids of those that have an output of their own
    rare_counts: np.ndarray = field(repr=False)  # tokens and distinct words in each class of rarer words
    rare_words: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)
    trained: int = 0  # tokens that the weights are trained on

    def with_weights(self, weights: np.ndarray, tokens: int) -> Model:
        return replace(self, weights=weights, trained=self.trained + tokens)


def _untrained(counts: DataFrame) -> Model:
    """Totals, and the most frequent words (a bounded number) with their counts."""
    per = counts.groupBy("rare").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()  # one row a class
    top = counts.orderBy(F.desc("c"), "word").limit(KNOWN_WORDS).toArrow()
    known = dict(zip(top.column("word").to_pylist(), top.column("c").to_pylist(), strict=True))
    frequent = {END: 0}
    for word in known:
        if len(frequent) == gru.WORDS:
            break
        frequent.setdefault(word, len(frequent))
    rare_counts, rare_words, own = np.zeros(gru.RARE), np.zeros(gru.RARE), np.zeros(gru.WORDS)
    for row in per:
        rare_counts[row.rare], rare_words[row.rare] = row.c, row.n
    for word, i in frequent.items():
        own[i] = known.get(word, 0)
        if word in known:
            rare_counts[rare_class(word)] -= known[word]
            rare_words[rare_class(word)] -= 1
    weights = gru.start(own, rare_counts)
    return Model(sum(r.c for r in per), sum(r.n for r in per), known, frequent, rare_counts, rare_words, weights)


class _Codes(dict):
    """A number for each word: its place among the known words, or after them its class, remembered up to a limit."""

    def __init__(self, model: Model) -> None:
        self.known = {w: i for i, w in enumerate(model.known)}
        super().__init__(self.known)

    def __missing__(self, word: bytes) -> int:
        if len(self) > len(self.known) + _FLUSH:
            self.clear()
            self.update(self.known)
        self[word] = found = len(self.known) + rare_class(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def _model_ids(model: Model) -> np.ndarray:
    """The model's id of each code."""
    own = [model.frequent[w] if w in model.frequent else gru.WORDS + rare_class(w) for w in model.known]
    return np.array([*own, *range(gru.WORDS, gru.WORDS + gru.RARE)], np.int32)


def _train_round(docs: DataFrame, model: Model, rate: float, number: int, rounds: int) -> tuple[np.ndarray, int]:
    """One round: every task trains on its documents of the round; the weights are averaged by tokens in Spark."""
    picked = texts(docs).filter(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == number).select("text")
    values = [f"w{i}" for i in range(_BLOCK)]

    def run(batches):
        codes, ids = _Codes(model), _model_ids(model)
        flat, total, held, size = model.weights, 0, [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.append(ids[codes.of(tokens(text))])
                size += len(held[-1])
                if size >= 1_000_000:
                    flat = gru.train(flat, np.concatenate(held), rate)
                    total, held, size = total + size, [], 0
        if held:
            flat = gru.train(flat, np.concatenate(held), rate)
        total += size
        if total:
            padded = np.zeros(-(-gru.PARAMETERS // _BLOCK) * _BLOCK)
            padded[: gru.PARAMETERS] = flat.astype(float) * total
            rows = padded.reshape(-1, _BLOCK)
            columns = {"block": pa.array(np.arange(len(rows)), pa.int32()), "n": np.full(len(rows), total)}
            yield pa.RecordBatch.from_pydict(columns | {c: rows[:, i] for i, c in enumerate(values)})

    schema = "block int, n long, " + ", ".join(f"{c} double" for c in values)
    parts = picked.mapInArrow(run, schema).groupBy("block").agg(*[F.sum(c).alias(c) for c in ("n", *values)])
    got = parts.orderBy("block").toArrow()
    if not got.num_rows:
        return model.weights, 0
    rows = np.stack([got.column(c).to_numpy() for c in values], axis=1) / got.column("n").to_numpy()[:, None]
    return rows.reshape(-1)[: gru.PARAMETERS].astype(np.float32), int(got.column("n")[0].as_py())


def fit(docs: DataFrame, rates: tuple[float, ...] = RATES) -> tuple[Model, DataFrame]:
    """The model learnt from `docs`, and the counts of all their words.

    Counts cover every document, and so does the training: each round takes those documents whose turn it is,
    spread over the tasks that read them, and averages the weights.
    """
    counts = keep(word_counts(docs), "words")
    model = _untrained(counts)
    for number, rate in enumerate(rates):
        model = model.with_weights(*_train_round(docs, model, rate, number, len(rates)))
    return model, counts


_SCORED = "doc_id long, n_tokens long, n_known long, base double, score double, words array<binary>"


def _score(batches, model: Model):
    """Per text: what a task knows of both scores; words that only the join can look up are handed on."""
    codes, ids, unknown = _Codes(model), _model_ids(model), len(model.known)
    unit, within = math.log10(model.total + model.distinct + 1), np.log10(model.rare_counts + model.rare_words + 1)
    log_count = np.append(np.log10(np.fromiter(model.known.values(), float) + 1), np.zeros(gru.RARE))
    # within its class a rarer word has its share of the class's tokens; one count goes to unseen words
    inside = np.zeros(len(ids))
    rare = ids >= gru.WORDS
    inside[rare] = log_count[rare] - within[ids[rare] - gru.WORDS]
    for batch in batches:
        n, seen, base, rest, others, streams = [], [], [], [], [], []
        for text in batch.column("text").to_pylist():
            words = tokens(text)
            own = codes.of(words)
            other = np.nonzero(own >= unknown)[0]
            n.append(len(words))
            seen.append(len(words) - len(other))
            base.append(log_count[own].sum() - unit * len(words))
            rest.append(inside[own].sum())
            others.append([words[i] for i in other.tolist()])
            streams.append(ids[own])
        score = gru.score(model.weights, streams) / math.log(10) + np.array(rest, float)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(seen, pa.int64()), pa.array(base, pa.float64())]
            + [pa.array(score, pa.float64()), pa.array(others, pa.list_(pa.binary()))],
            ["doc_id", "n_tokens", "n_known", "base", "score", "words"],
        )


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """`doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score` for every row.

    Both scores are log10 probabilities of the whole text with its end; a null or blank text is its end alone.
    Repeated rows are scored alike, a row without id has a null `held_out`, an empty table gives no row. With
    nothing learnt every token is unknown and the scores are those of the smoothed prior.
    """
    parts = texts(docs).mapInArrow(lambda batches: _score(batches, model), _SCORED)
    # written once, so that row numbers stay the same and nothing is scored twice
    rows = keep(parts.withColumn("row", F.monotonically_increasing_id()), "scored")
    looked_up = rows.select("row", F.explode("words").alias("word")).join(counts.select("word", "c"), "word")
    extra = looked_up.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count(F.lit(1)).alias("hits"))
    more = F.coalesce("more", F.lit(0.0))
    return (
        rows.drop("words")
        .join(extra, "row", "left")
        .select(
            "doc_id",
            (remainder(HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"),
            "n_tokens",
            (F.col("n_known") + F.coalesce("hits", F.lit(0))).alias("n_known"),
            F.lit(model.total).cast("long").alias("train_tokens"),
            (F.col("base") + more).alias("base_score"),
            (F.col("score") + more).alias("score"),
        )
    )


def learnable(docs: DataFrame) -> DataFrame:
    """Rows outside the held-out part; rows without id are not learnt from."""
    return docs.filter(remainder(HELD_OUT[0]) != HELD_OUT[1])
