import random
import re

import numpy as np
import xxhash
from tests.llm.conftest import SF

from fieldsift.llm import queries, simhash
from fieldsift.llm.common import table
from fieldsift.llm.components import components


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, bits=3):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(root(i), []).append(ids[i])
    return {i: min(x for x in groups[root(i)] if x is not None) for i in range(len(fps)) if ids[i] is not None}


def test_query_equals_brute_force(spark):
    rows = table(spark, SF, "documents").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = plain_components([r.doc_id for r in rows], fps)
    want = {(rows[i].doc_id, f"{fps[i]:016x}", c) for i, c in want.items()}
    got = queries.QUERIES["op4_simhash"](spark, SF)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert {tuple(r) for r in got.collect()} == want


def test_quadruples_leave_no_three_positions_uncovered():
    assert len(simhash.QUADRUPLES) == 14
    assert all(
        any(not {a, b, c} & set(q) for q in simhash.QUADRUPLES) for a in range(8) for b in range(a) for c in range(b)
    )


def test_links_equal_brute_force_with_a_crowd(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    crowd = {base[0] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)}
    chain = [base[1]]
    for _ in range(30):
        chain.append(chain[-1] ^ sum(1 << b for b in rng.sample(range(64), 3)))
    fps = sorted({*base, *crowd, *chain, 0, 7, (1 << 64) - 1})
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = {r.node: r.root for r in components(links).collect()}
    want = plain_components(signed, fps)
    got = {}
    for i, f in enumerate(signed):
        got.setdefault(roots.get(f, f), []).append(i)
    assert {frozenset(v) for v in got.values()} == {
        frozenset(i for i in want if want[i] == c) for c in set(want.values())
    }


def test_a_long_posting_is_split_without_losing_links():
    rng = np.random.default_rng(1)
    low = rng.integers(0, 1 << 20, 700, dtype=np.uint64)
    fps = np.unique(np.concatenate([low, low ^ np.uint64(5), low ^ np.uint64(1 << 17)]))
    found = []
    for split in (10, 10**6):
        out = []
        simhash._posting(simhash.QUADRUPLES.index((4, 5, 6, 7)), fps, out, split)
        pairs = [(int(a), int(b)) for x, y in out for a, b in zip(x, y, strict=True)]
        place = {int(f): i for i, f in enumerate(fps)}
        parent = list(range(len(fps)))

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in pairs:
            assert (a ^ b).bit_count() <= 3
            parent[root(place[a])] = root(place[b])
        groups = {}
        for i in range(len(fps)):
            groups.setdefault(root(i), set()).add(i)
        found.append({frozenset(g) for g in groups.values()})
    assert found[0] == found[1]


def test_odd_rows(spark, odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    rows = {r.doc_id: r for r in got}
    assert rows[0].fp == rows[1].fp == 0 and rows[0].component_id == rows[1].component_id == 0
    assert sum(r.doc_id == 2 for r in got) == 3 and rows[2].component_id == 2
    assert sorted(r.component_id is None for r in got if r.doc_id is None) == [False, True]
    assert simhash.near_duplicates(empty).collect() == []


def test_one_of_each_keeps_one_row_and_its_columns(spark, odd, empty):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 2, 3, 4, 5] and ids.count(None) == 2
    assert simhash.one_of_each(empty).count() == 0
