"""Quality rules: fixed limits, then boosted trees over statistics of the document."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift.llm import trees
from fieldsift.llm.common import LABEL_ROWS, by_batch, labelled_ids, texts

BLANKS = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
KEEP_AT = 0.5
#: Statistics that the trees read, each with the direction in which it may move the score (0: any).
FEATURES = {
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "top_word_share": -1,
    "upper_share": -1,
    "bang_share": -1,
    "digit_share": 0,
    "mark_share": 0,
    "distinct_share": 0,
    "word_length": 0,
    "line_words": 0,
    "log_words": 0,
    "plain_word_share": 0,
}
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ", ".join(["doc_id long", *(f"{c} long" for c in _COUNTS), *(f"{f} double" for f in FEATURES)])


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of `size` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    twice = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for i in range(size):
        covered[i : i + len(windows)] |= twice
    return int(covered.sum())


def statistics(text: str) -> tuple:
    """The counts and features of one whole text, in the order of SCHEMA."""
    raw = text.encode("utf-8")
    words = raw.split()  # bytes: at ASCII white space only
    n, chars = len(words), len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=5)
    seen = Counter(words)
    letters = kinds[1] + kinds[2] + kinds[4]
    features = (
        symbols / max(1, chars),
        dup_lines / max(1, len(lines)),
        repeats / max(1, n),
        max(seen.values(), default=0) / max(1, n),
        kinds[1] / max(1, letters),
        text.count("!") / max(1, n),
        kinds[3] / max(1, chars),
        (len(raw) - letters - kinds[3] - (len(text) - chars)) / max(1, chars),
        len(seen) / max(1, n),
        chars / max(1, n),
        n / max(1, len(lines)),
        float(np.log1p(n)),
        sum(v for w, v in seen.items() if w.isalpha()) / max(1, n),
    )
    return (n, chars, symbols, dup_lines, repeats, *map(float, features))


#: Of each byte: 1 upper-case letter, 2 lower-case letter, 3 digit, 4 part of a character beyond ASCII, 0 other.
_KIND = np.zeros(256, np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4


def _measure(columns: dict[str, list]) -> dict[str, list]:
    found = [statistics(t) for t in columns["text"]]
    names = [*_COUNTS, *FEATURES]
    return {"doc_id": columns["doc_id"], **{c: [r[i] for r in found] for i, c in enumerate(names)}}


def measured(docs: DataFrame) -> DataFrame:
    """The counts and features of every row (null text: no words)."""
    return by_batch(texts(docs), _measure, SCHEMA)


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABEL_ROWS) -> trees.Forest:
    """Trees for `labels.quality`, fitted on at most `rows` labelled documents.

    A document that comes several times counts once. Without labels the score is the prior of one half.
    """
    sample = labelled_ids(labels, "quality", rows=rows)
    # at most `rows` ids with a number each, so the broadcast has a proven bound
    wanted = docs.join(F.broadcast(sample.select(F.col("doc_id").alias("__id"))), F.col("doc_id") == F.col("__id"), "left_semi")
    stats = measured(wanted).groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("x"))
    got = stats.join(F.broadcast(sample), "doc_id").select("x.*", "label").toArrow()
    x = np.stack([got.column(f).to_numpy() for f in FEATURES], axis=1) if got.num_rows else np.zeros((0, len(FEATURES)))
    return trees.fit(x, got.column("label").to_numpy().astype(float), np.array(list(FEATURES.values())))


def judge(docs: DataFrame, forest: trees.Forest, keep_at: float = KEEP_AT) -> DataFrame:
    """For every row: `doc_id`, the counts, `base_failed`, `score` (chance of good quality) and `kept`.

    Null and empty texts have no words, fail the fixed limits and are not kept. Rows are judged one by one, so
    repeated rows and rows without id are judged like any other; an empty table gives no row.
    """

    def scored(columns: dict[str, list]) -> dict[str, list]:
        out = _measure(columns)
        x = np.array([out[f] for f in FEATURES], float).T.reshape(-1, len(FEATURES))
        out["score"] = forest.probability(x)
        return out

    rows = by_batch(texts(docs), scored, f"doc_id long, {', '.join(f'{c} long' for c in _COUNTS)}, score double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= keep_at))


def kept_rows(docs: DataFrame, forest: trees.Forest, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns, in one pass without a shuffle."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            stats = [statistics(t or "") for t in batch.column(at).to_pylist()]
            if not stats:
                continue
            counts, x = np.array([s[:5] for s in stats]), np.array([s[5:] for s in stats], float)
            failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
            yield batch.filter(pa.array(~failed & (forest.probability(x) >= keep_at)))

    return docs.mapInArrow(run, schema)
