import hashlib
import itertools
import re
import zlib

import duckdb
import pytest
from tests.llm.conftest import SF_LARGER

from fieldsift.llm import conversations as C
from fieldsift.llm import queries
from fieldsift.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string, rank int, cid string, fault string"
BLANK = " \t\n\v\f\r"


def brute(rows):
    """Least (cost, audit) and text over all edit sequences with up to two insertions in each place."""
    faults, seen = [], set()
    for role, text in rows:
        stripped = text.strip(BLANK)
        faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else "" if stripped[-1] in ".!?" else "truncated")
        seen.add((role, text))
    options = []
    for (role, text), fault in zip(rows, faults, strict=True):
        price = 3 if fault == "truncated" else 0
        own = [(4, "D", [])]
        if fault not in ("blank", "duplicate"):
            own += [(price, "K", [(role, text)]), *[(3 + price, "R", [(r, text)]) for r in ("user", "assistant")]]
        options += [None, own]
    options.append(None)
    inserts = [(3 * n, "I" * n, [(r, "") for r in rs]) for n in range(3) for rs in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for choice in itertools.product(*[inserts if o is None else o for o in options]):
        turns = [t for c in choice for t in c[2]]
        if all(t[0] for t in turns) and re.fullmatch("(s?(ua)+)?", "".join(t[0][0] for t in turns)):
            found = (sum(c[0] for c in choice), "".join(c[1] for c in choice), "\n".join(f"{r}:{t}" for r, t in turns))
            best = found if best is None else min(best, found)
    return faults, best


def solved(rows):
    columns = {"conv_id": [1] * len(rows), "turn": [None] * len(rows), "role": [r for r, _ in rows], "text": [t for _, t in rows]}
    columns["fault"] = ["blank" if not t.strip(BLANK) else "" if t.strip(BLANK)[-1] in ".!?" else "truncated" for _, t in rows]
    columns["dropped"] = [False] * len(rows)
    ((_, _, blank, duplicate, truncated, _, cost, audit, digest),) = C._report(columns)
    return [blank, duplicate, truncated], cost, audit, digest


def test_every_short_conversation_against_all_edit_sequences():
    kinds = [("system", "S."), ("user", "U."), ("assistant", "A."), ("user", "cut"), ("assistant", " "), ("tool", "T!"), ("", "E?")]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            faults, best = brute(rows)
            want = [faults.count(f) for f in ("blank", "duplicate", "truncated")], best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()
            if n:
                assert solved(rows) == want, rows


def odd_rows():
    rows = []
    for conv in range(160):
        for turn in range(conv % 11 + (60 if conv % 40 == 7 else 0)):
            role = ("system", "user", "assistant", "user", None, "tool", "assistant", "")[(conv * 3 + turn * (1 + conv % 3)) % 8]
            text = ("Well.", "Cut off", "So?\n", None, "", " \t", f"Text {conv} {turn}!", "é", "x. y", "Well.")[(conv * 7 + turn) % 10]
            rows.append((conv if conv % 31 else None, None if turn % 9 == 4 else turn + (turn > 5), role, text, 1, "clash", "clash"))
    rows += [(900, 1, "user", "same", 1, "", "")] * 25 + [(901, None, "user", "Long " * 200_000, 1, "", ""), (901, None, None, None, 1, "", "")]
    return rows


def key(row):
    return tuple("" if v is None else str(v) for v in row)


@pytest.fixture(scope="module")
def table_(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def from_sql(rows, types="conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR"):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE conversations ({types})")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return sorted(con.execute(queries.ORACLE_SQL["op12_conversation_repair"]).fetchall(), key=key)


def test_odd_rows_against_sql(spark, table_):
    got = C.repair_reports(C.damaged(table_)).collect()
    assert sorted(map(tuple, got), key=key) == from_sql([r[:4] for r in odd_rows()])


def test_long_conversations_in_blocks_equal_whole_ones(spark, table_):
    whole = sorted(map(tuple, C.repair_reports(C.damaged(table_)).collect()), key=key)
    for block in (1, 4, 9):
        got = C.repair_reports(C.damaged(table_), block=block).collect()
        assert sorted(map(tuple, got), key=key) == whole


def test_turns_give_the_digests_whatever_the_block(spark, table_):
    reports = {r.conv_id: r.repaired_sha256 for r in C.repair_reports(C.damaged(table_)).collect()}
    for block in (4, 4096):
        texts = {}
        for r in sorted(C.repaired_turns(C.damaged(table_), block).collect(), key=lambda r: (r.part, r.sub, r.place)):
            texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert {c: hashlib.sha256("\n".join(texts.get(c, [])).encode()).hexdigest() for c in reports} == reports


def test_undamaged_rows_and_an_empty_table(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho."), (2, 0, "assistant", "Only me.")]
    schema = "conv_id long, turn long, role string, text string"
    got = {r.conv_id: (r.cost, r.audit) for r in C.repair_reports(C.ordered(spark.createDataFrame(rows, schema))).collect()}
    assert got == {1: (0, "KK"), 2: (3, "IK")}
    nothing = C.damaged(spark.createDataFrame([], schema))
    assert C.repair_reports(nothing).collect() == [] and C.repaired_turns(nothing).collect() == []


def test_all_rows_dropped(spark):
    turn = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = C.damaged(spark.createDataFrame([(5, turn, "user", "Gone.")] * 3, "conv_id long, turn long, role string, text string"))
    for block in (1, 4096):
        (got,) = C.repair_reports(rows, block=block).collect()
        assert tuple(got) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_query(spark):
    got = queries.QUERIES["op12_conversation_repair"](spark, SF_LARGER)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF_LARGER}/conversations.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_conversation_repair"])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)
    assert table(spark, SF_LARGER, "conversations").select("conv_id").distinct().count() == got.count()
