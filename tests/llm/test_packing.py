import zlib

import numpy as np
import pytest
from tests.llm.conftest import SF
from tokenizers import Tokenizer

from fieldsift.llm import packing, queries
from fieldsift.llm.common import table


def check(documents, rows, most=4096):
    """Every id in one piece, checked against the tokenizer over whole texts."""
    tok = Tokenizer.from_file(packing.vocabulary_path())
    want = []
    for d in documents:
        ids = np.array([*tok.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces, at = [], 0
        for n in packing.binary_lengths(len(ids), most):
            pieces.append((d.doc_id, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), 0))
            at += n
        assert at == len(ids)
        want += pieces
    got = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in rows]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.length & (r.length - 1) == 0 and 1 << r.bucket == r.length <= most for r in rows)


def test_query_round_trip(spark):
    got = queries.QUERIES["op6_packing"](spark, SF).collect()
    check(table(spark, SF, "documents").collect(), got)


def test_odd_rows_and_small_sequences(spark, odd, empty):
    check(odd.collect(), packing.pack(odd).collect())
    check(odd.collect(), packing.pack(odd, sequence=64).collect(), 64)
    assert packing.pack(empty).collect() == []
    with pytest.raises(ValueError):
        packing.pack(odd, sequence=100)


def test_words_alone_give_the_ids_of_the_text(spark, docs):
    texts = ["It's  we're\tthey'll ''s 's", "Á é̂ Ǆ İstanbul ΑΣ Σ", "x\u0085y z w ﻿ q\x1fr", "<|endoftext|> a<|startoftext|>b", "1234 ½ ٣ 漢字かな 👩‍👩‍👧"]
    table_ = docs(texts)
    check(table_.collect(), packing.pack(table_).collect())


def test_forgetting_words_changes_nothing():
    encoder = packing.WordIds(packing.vocabulary_path(), remembered=3)
    other = packing.WordIds(packing.vocabulary_path())
    text = "one two three four five one two six seven"
    assert encoder.encode(text) == other.encode(text)


def test_binary_lengths():
    assert packing.binary_lengths(0) == [] and packing.binary_lengths(4096) == [4096]
    assert packing.binary_lengths(8192 + 5) == [4096, 4096, 4, 1]
