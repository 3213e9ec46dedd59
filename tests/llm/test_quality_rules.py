import re
from collections import Counter

import numpy as np
from tests.llm.conftest import SF, SF_LARGER

from fieldsift.llm import quality_rules, queries, trees
from fieldsift.llm.common import table


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def check(docs, rows):
    want = {}
    for d in docs:
        c = plain_counts(d.text)
        want.setdefault(d.doc_id, []).append((*c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    got = {}
    for r in rows:
        assert not (r.kept and r.base_failed)
        got.setdefault(r.doc_id, []).append(tuple(r[1:6]) + (r.base_failed,))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_query(spark):
    rows = queries.QUERIES["op2_quality_rules"](spark, SF_LARGER).drop("score")
    order = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = rows.select(order).collect()
    check(table(spark, SF_LARGER, "documents").collect(), rows)
    kept = {r.doc_id: r for r in rows}
    labels = [x for x in table(spark, SF_LARGER, "labels").collect() if not kept[x.doc_id].base_failed]
    right = np.mean([kept[x.doc_id].kept == bool(x.quality) for x in labels])
    assert right > 0.97


def test_odd_rows(spark, odd, empty, docs):
    labels = table(spark, SF, "labels")
    for given in (labels, labels.limit(0), labels.selectExpr("doc_id", "1 as quality")):
        forest = quality_rules.fit(table(spark, SF, "documents"), given)
        judged = quality_rules.judge(odd, forest)
        check(odd.collect(), judged.select("doc_id", *quality_rules._COUNTS, "base_failed", "score", "kept").collect())
        kept = quality_rules.kept_rows(odd, forest)
        assert kept.columns == odd.columns
        want = sorted(repr(r.doc_id) for r in judged.filter("kept").collect())
        assert sorted(repr(r.doc_id) for r in kept.collect()) == want
        assert quality_rules.judge(empty, forest).count() == quality_rules.kept_rows(empty, forest).count() == 0
    check(*(lambda d: (d.collect(), quality_rules.judge(d, forest).select("doc_id", *quality_rules._COUNTS, "base_failed", "kept").collect()))(docs(["a b c a b c", "a a a a", "x\ny\nx\n \n \ny", "\x0b\x1c|<>", "é é é ü"])))


def test_trees_are_monotonic_and_flat_scoring_equals_a_walk():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] + 0.4 * np.sin(9 * x[:, 1]) + 0.2 * rng.random(800)) > 0.7).astype(float)
    forest = trees.fit(x, y, np.array([1, 0, -1]), trees=30)
    p = forest.probability(x)
    assert np.mean((p > 0.5) == y) > 0.9
    steps = np.linspace(0, 1, 40)
    for row in x[:40]:
        for j, sign in ((0, 1), (2, -1)):
            line = np.tile(row, (40, 1))
            line[:, j] = steps
            assert (sign * np.diff(forest.margin(line)) >= -1e-12).all()

    def walk(row):
        total = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            while f[node] >= 0:
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += v[node]
        return total

    assert np.allclose(forest.margin(x[:50]), [walk(r) for r in x[:50]])
