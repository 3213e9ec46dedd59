import math
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm.conftest import SF

from fieldsift.llm import gru, lm, queries
from fieldsift.llm.common import table


def plain(docs, text_of=lambda t: (t or "").encode().lower().split() + [b""]):
    counts = Counter()
    for d in docs:
        if d.doc_id is not None and zlib.crc32(str(d.doc_id).encode()) % 7 != 2:
            counts.update(text_of(d.text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d in docs:
        words = text_of(d.text)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        out.append((d.doc_id, len(words), sum(w in counts for w in words), n, base))
    return out


def check(docs, rows):
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(plain(docs), key=key)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=key)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert [x[4] for x in got] == pytest.approx([x[4] for x in want])


def test_query(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN_WORDS", 3000)  # so that many words take the join
    rows = queries.QUERIES["op9_lm_scoring"](spark, SF)
    assert rows.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = rows.collect()
    check(table(spark, SF, "documents").collect(), rows)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 == 2}
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_add_up(spark):
    """Over all words that can come next (one of them unknown for each class), the probabilities add up to one."""
    docs = table(spark, SF, "documents").limit(40)
    model, counts = lm.fit(docs)
    vocabulary = [r.word for r in counts.collect()]
    state = gru.advance(np.zeros((1, gru.STATE), np.float32), gru.gate_table(gru.unpack(model.weights))[[5]], gru.unpack(model.weights)["gates_state"])
    own = lm._model_ids(model)[lm._Codes(model).of([bytes(w) for w in vocabulary])].astype(int)
    ll = gru.log_likelihood(gru.unpack(model.weights), np.repeat(state, len(own), axis=0), own)
    c = {bytes(r.word): r.c for r in counts.collect()}
    inside = [0.0 if i < gru.WORDS else math.log((c[bytes(w)] + 1) / (model.rare_counts[i - gru.WORDS] + model.rare_words[i - gru.WORDS] + 1)) for w, i in zip(vocabulary, own, strict=True)]
    total = np.exp(ll + np.array(inside)).sum()
    rare = gru.WORDS + np.arange(gru.RARE)
    unseen = gru.log_likelihood(gru.unpack(model.weights), np.repeat(state, gru.RARE, axis=0), rare) - np.log(model.rare_counts + model.rare_words + 1)
    unused = np.arange(len(model.frequent), gru.WORDS)
    spare = gru.log_likelihood(gru.unpack(model.weights), np.repeat(state, len(unused), axis=0), unused)
    assert total + np.exp(unseen).sum() + np.exp(spare).sum() == pytest.approx(1.0, abs=1e-3)


def test_odd_rows(spark, odd, empty):
    rows = lm.score(odd, *lm.fit(lm.learnable(odd))).collect()
    check(odd.collect(), rows)
    assert all(r.score < 0 for r in rows) and {r.held_out for r in rows if r.doc_id is None} == {None}
    nothing = lm.fit(empty)
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in lm.score(odd, *nothing).collect())
    assert lm.score(empty, *nothing).count() == 0


def test_state_is_carried_and_gradients_are_right():
    rng = np.random.default_rng(3)
    flat = gru.start(rng.random(gru.WORDS) * 9, rng.random(gru.RARE) * 9)
    flat += rng.normal(0, 0.1, flat.shape).astype(np.float32)
    texts = [np.append(rng.integers(1, gru.WORDS + gru.RARE, n), 0) for n in (300, 1, 130, 64, 63)]
    whole = gru.score(flat, texts, window=1000)
    assert np.allclose(whole, gru.score(flat, texts, window=7, together=2), rtol=1e-4)
    p, state, want = gru.unpack(flat), np.zeros((1, gru.STATE), np.float32), 0.0
    for before, i in zip([0, *texts[0][:-1]], texts[0], strict=True):
        state = gru.advance(state, gru.gate_table(p)[[before]], p["gates_state"])
        want += gru.log_likelihood(p, state, np.array([i]))[0]
    assert whole[0] == pytest.approx(want, rel=1e-4)
    stream = np.concatenate(texts * 30)
    after = gru.train(flat, stream, 0.005)
    assert gru.score(after, texts).sum() > whole.sum()


def test_every_learnable_token_is_trained_on(spark, docs):
    rng = np.random.default_rng(1)
    rows = docs([" ".join(f"w{x}" for x in rng.zipf(1.5, 900) % 5000) for _ in range(300)])
    model, _ = lm.fit(lm.learnable(rows), rates=(0.01, 0.003))
    assert model.trained == model.total > 200_000
