import hashlib
import random

import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import SF

from fieldsift.llm import byte_bpe, queries
from fieldsift.llm.common import table

RANKS = byte_bpe.read_ranks(byte_bpe.vocabulary_path())
LIBRARY = tiktoken.Encoding("own", pat_str=byte_bpe.split_pattern(), mergeable_ranks=RANKS, special_tokens={})
ENCODER = byte_bpe.Encoder(RANKS, byte_bpe.split_pattern())


def ids(text, encoder=ENCODER):
    return list(memoryview(encoder.encode(text)).cast("i"))


def want(text):
    text = text or ""
    got = LIBRARY.encode_ordinary(text)
    return len(got), hashlib.sha256(" ".join(map(str, got)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def key(row):
    return tuple("" if v is None else str(v) for v in row)


def test_query_equals_the_library_and_decodes_to_the_text(spark):
    got = queries.QUERIES["op11_byte_bpe"](spark, SF).collect()
    rows = table(spark, SF, "documents").collect()
    assert sorted(tuple(r) for r in got) == sorted((r.doc_id, *want(r.text)) for r in rows)


def test_odd_rows(spark, odd, empty):
    got = byte_bpe.decode(byte_bpe.encode(odd)).collect()
    expected = [(r.doc_id, LIBRARY.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in odd.collect()]
    assert sorted([(r.doc_id, r.ids, bytes(r.decoded)) for r in got], key=key) == sorted(expected, key=key)
    assert byte_bpe.decode(byte_bpe.encode(empty)).collect() == []


def test_decoding_null_unknown_and_cut_ids(spark):
    cut = LIBRARY.encode_ordinary("漢")[:1]
    rows = spark.createDataFrame([(1, None), (2, []), (3, cut)], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(rows).collect()}
    assert got == {1: b"", 2: b"", 3: LIBRARY.decode_bytes(cut)}
    with pytest.raises(Exception, match="99999999"):
        byte_bpe.decode(spark.createDataFrame([(1, [99999999])], "doc_id long, ids array<int>")).collect()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab 'sé\n1.\xa0\x1c", max_size=200))
def test_any_text(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_long_pieces_without_a_break():
    rng = random.Random(3)
    for piece in ("a" * 30_000, "ab" * 20_000, " " * 30_000, "".join(rng.choices("etaoinsh", k=60_000)), "漢" * 10_000, "=" * 9_999):
        assert ids(piece) == LIBRARY.encode_ordinary(piece)


def test_join_is_associative_and_right_wherever_a_piece_is_cut():
    rng = random.Random(5)
    for _ in range(400):
        raw = "".join(rng.choices("aeinrst", k=rng.randint(3, 60))).encode()
        i, j = sorted(rng.sample(range(len(raw) + 1), 2))
        x, y, z = (ENCODER.merges(part) for part in (raw[:i], raw[i:j], raw[j:]))
        left, right = ENCODER.join(ENCODER.join(x, y), z), ENCODER.join(x, ENCODER.join(y, z))
        assert left == right == ENCODER.merges(raw)


def test_both_ways_of_merging_agree():
    rng = random.Random(7)
    for _ in range(300):
        raw = "".join(rng.choices("thein go", k=60)).encode()
        by_queue = ENCODER.merges(raw)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while True:
            ranked = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in RANKS]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert by_queue == [RANKS[p] for p in parts]


def test_forgetting_changes_nothing():
    small = byte_bpe.Encoder(RANKS, byte_bpe.split_pattern(), remembered=3)
    text = "one two three four five one two six seven unforeseeable"
    assert ids(text, small) == ids(text)


def test_a_token_without_merges_that_lead_to_it():
    # 'abc' is a token, but its merges stop at 'ab' 'c'... and inside a longer piece it must not appear
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"d": 3, b"bc": 4, b"cd": 5, b"abcd": 6}
    own = byte_bpe.Encoder(ranks, r"\w+")
    library = tiktoken.Encoding("tiny", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=7)
    for text in ("abcd", "abcdabcd", "abcda", "dabcd", "bcdcda"):
        assert ids(text, own) == library.encode_ordinary(text)


def test_a_large_batch_is_handled_in_parts():
    texts = [f"text number {i} of many" for i in range(1000)]
    where = byte_bpe.vocabulary_path(), byte_bpe.split_pattern()
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": texts})
    parts = list(byte_bpe._encoded([batch, batch.slice(0, 0)], *where))
    assert max(p.num_rows for p in parts) <= byte_bpe.ROWS
    whole = pa.Table.from_batches(parts).combine_chunks().to_batches()
    assert [r["ids"] for r in whole[0].to_pylist()] == [LIBRARY.encode_ordinary(t) for t in texts]
    parts = list(byte_bpe._decoded(whole, *where))
    assert max(p.num_rows for p in parts) <= byte_bpe.ROWS
    assert [r["decoded"].decode() for p in parts for r in p.to_pylist()] == texts
