"""Conversation structure repair: the cheapest edits to a well-formed conversation, as a lightest derivation.

An item [i, state] says that the first i rows are edited and that the roles written so far end in `state`. Deductions
lead from item to item and weigh (cost, audit); `agenda` is Knuth's algorithm over them. It is sound because every
deduction is superior (a cost of 0 or more is added, symbols are appended, so no weight falls) and monotone: two
different audits of one item at one cost never begin one with the other, as both have used the same rows and the
longer would hold more insertions, which cost. Appending hence keeps their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.common import _arrow_fields, keep

#: Rows of a conversation that one task holds at a time; longer ones are solved in blocks of it and then as a whole.
BLOCK = 4096
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (START, ASSISTANT)  # (s?(ua)+)? may end here
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
_BLANKS = "[\\x20\\x09-\\x0D]"

Deduction = tuple[int, int, int, str]  # item (rows, state), cost, symbols
Weight = tuple[int, str]


def spoken(state: int) -> int:
    """State behind a turn of user or assistant that is free to take either role."""
    return ASSISTANT if state == USER else USER


def kept(state: int, initial: str) -> int | None:
    """State behind a turn with this initial, if the grammar allows it here."""
    if initial == "s" and state == START:
        return SYSTEM
    if initial == "u" and state != USER:
        return USER
    return ASSISTANT if initial == "a" and state == USER else None


def agenda(start: int, rows: int, deductions: Callable[[int, int], Iterable[Deduction]], goals: tuple[int, ...], every: bool = False):
    """Lightest weights of the goal items [rows, goal] and the states on the way to each.

    Items leave the agenda in order of (cost, audit), so the first weight with which one is popped is final. Stops
    with the first goal, or with `every` when no item is left.
    """
    heap: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    best: dict[tuple[int, int], Weight] = {(0, start): (0, "")}
    came: dict[tuple[int, int], tuple[int, int]] = {}
    final: set[tuple[int, int]] = set()
    found: dict[int, Weight] = {}
    while heap:
        cost, audit, i, state = heappop(heap)
        item = (i, state)
        if item in final:
            continue
        final.add(item)
        if i == rows and state in goals:
            found[state] = (cost, audit)
            if not every:
                break
        for j, to, price, symbols in deductions(i, state):
            weight = (cost + price, audit + symbols)
            other = (j, to)
            if other not in final and (other not in best or weight < best[other]):
                best[other], came[other] = weight, item
                heappush(heap, (*weight, j, to))
    return found, came


class Row:
    """What the deductions need to know of a row."""

    __slots__ = ("doomed", "initial", "price")

    def __init__(self, role: str, fault: str) -> None:
        self.initial = role[:1]
        self.doomed = fault in ("blank", "duplicate")
        self.price = TRUNCATED if fault == "truncated" else 0


def edits(rows: list[Row]) -> Callable[[int, int], Iterator[Deduction]]:
    """The deductions over rows: insert before a row or at the end, delete, keep, give another role."""

    def deductions(i: int, state: int) -> Iterator[Deduction]:
        yield i, spoken(state), INSERT, "I"
        if i == len(rows):
            return
        row = rows[i]
        yield i + 1, state, DELETE, "D"
        if not row.doomed:
            yield i + 1, spoken(state), REROLE + row.price, "R"
            to = kept(state, row.initial)
            if to is not None:
                yield i + 1, to, row.price, "K"

    return deductions


def replay(audit: str, state: int, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Role and text of every turn that the edits leave or make."""
    out, i = [], 0
    for symbol in audit:
        if symbol == "I":
            state = spoken(state)
            out.append((ROLES[state], ""))
            continue
        role, text = rows[i]
        i += 1
        if symbol == "K":
            state = kept(state, role[:1])
            out.append((role, text))
        elif symbol == "R":
            state = spoken(state)
            out.append((ROLES[state], text))
    return out


# --- rows in order


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by the crc32 of `conv_id:turn` modulo 20 (nulls: one space); dropped ones are marked."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return (
        ordered(conversations)
        .withColumns({"dropped": kind == 0, "role": F.when(kind == 4, F.lit("user")).otherwise(blank("role")), "text": text})
        .withColumn("copy", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    )


_ORDER = ("turn", "by_role", "by_text", "by_hash", "copy")


def ordered(conversations: DataFrame) -> DataFrame:
    """`conv_id, turn, role, text` with the columns that order the rows of a conversation.

    By turn (nulls first), then role, the first 64 characters of the text and its hash, so that the order does not
    depend on how the rows are stored.
    """
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id",
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("cid"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        text.alias("text"),
        F.coalesce("role", F.lit(" ")).alias("by_role"),
        F.substring(text, 1, 64).alias("by_text"),
        F.xxhash64(text).alias("by_hash"),
        F.lit(0).alias("copy"),
        F.lit(False).alias("dropped"),
        F.monotonically_increasing_id().alias("uid"),
    )


def _fault(text: Column) -> Column:
    """Blank or truncated, before duplicates are known."""
    last = F.regexp_extract(text, f"([^\\x20\\x09-\\x0D]){_BLANKS}*+\\z", 1)
    return F.when(last == "", F.lit("blank")).when(~last.isin(".", "!", "?"), F.lit("truncated")).otherwise(F.lit(""))


# --- groups of sorted rows in tasks


def _by_group(df: DataFrame, keys: list[str], order: list[str], solve: Callable[[dict[str, list]], Iterable[tuple]], schema: str, spread: list[str] | None = None) -> DataFrame:
    """`solve(columns)` for the rows of each key, in order; a task holds one group at a time."""
    names = df.columns
    fields = _arrow_fields(df.sparkSession, schema)
    target = pa.schema(fields)

    def rows_out(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [names.index(k) for k in keys]
        held: list[tuple] = []
        key = None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                now = tuple(row[p] for p in places)
                if now != key and held:
                    out += solve(dict(zip(names, map(list, zip(*held, strict=True)), strict=True)))
                    held = []
                key = now
                held.append(row)
            if out:
                yield rows_out(out)
        if held:
            yield rows_out(list(solve(dict(zip(names, map(list, zip(*held, strict=True)), strict=True)))))

    return df.repartition(*(spread or keys)).sortWithinPartitions(*(spread or keys), *order).mapInArrow(run, schema)


def _faults(columns: dict[str, list]) -> list[str]:
    """First fault of each row of a whole conversation."""
    seen: set[tuple[str, str]] = set()
    out = []
    for role, text, fault in zip(columns["role"], columns["text"], columns["fault"], strict=True):
        if fault != "blank":
            if (role, text) in seen:
                fault = "duplicate"
            seen.add((role, text))
        out.append(fault)
    return out


def _remaining(columns: dict[str, list]) -> dict[str, list]:
    gone = columns["dropped"]
    return {c: [v for v, d in zip(values, gone, strict=True) if not d] for c, values in columns.items()}


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False))


def _text(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in turns)


def _lightest(columns: dict[str, list], faults: list[str]) -> Weight:
    rows = [Row(r, f) for r, f in zip(columns["role"], faults, strict=True)]
    found, _ = agenda(START, len(rows), edits(rows), GOALS)
    (weight,) = found.values()
    return weight


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"


def _report(columns: dict[str, list]) -> Iterator[tuple]:
    """The report of a conversation that one task holds."""
    conv = columns["conv_id"][0]
    columns = _remaining(columns)
    turns = {t for t in columns["turn"] if t is not None}
    faults = _faults(columns)
    cost, audit = _lightest(columns, faults)
    repaired = replay(audit, START, list(zip(columns["role"], columns["text"], strict=True)))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    yield conv, gaps, *counts, _illegal(columns["role"]), cost, audit, hashlib.sha256(_text(repaired).encode()).hexdigest()


def _turns(columns: dict[str, list]) -> Iterator[tuple]:
    """The repaired turns of a conversation that one task holds."""
    conv = columns["conv_id"][0]
    columns = _remaining(columns)
    _, audit = _lightest(columns, _faults(columns))
    for place, (role, text) in enumerate(replay(audit, START, list(zip(columns["role"], columns["text"], strict=True)))):
        yield conv, 0, 0, place, role, text


# --- conversations longer than a block


_SIZED = ["conv_id", "cid", "turn", "role", "text", "fault", "dropped", *_ORDER[1:]]


def _parted(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations that fit into a block, and those of longer ones, if there are any, cut into blocks."""
    rows = rows.withColumn("fault", _fault(F.col("text")))
    long = keep(rows.groupBy("cid").count().filter(F.col("count") > block).select("cid"), "long-conversations")
    if long.isEmpty():
        return rows, None
    return rows.join(long, "cid", "left_anti"), keep(_blocks(rows.join(long, "cid", "left_semi"), block), "conversation-blocks")


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Long conversations dealt into ranges of their order, each cut into blocks `(part, sub)`; duplicates marked.

    The first of equal rows is found by a minimum per role and text, which is combined before the shuffle, so
    neither a long conversation nor an often repeated text meets in one task.
    """
    order = [F.col(c) for c in (*_ORDER, "uid")]
    ranged = keep(rows.repartitionByRange("cid", *order).withColumn("part", F.spark_partition_id()), "long-rows")
    same = F.sha2(F.concat_ws("\0", "role", "text"), 256)
    spoken_rows = ranged.filter((F.col("fault") != "blank") & ~F.col("dropped")).withColumn("same", same)
    again = spoken_rows.groupBy("cid", "same").agg(F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    marked = (
        ranged.withColumn("same", same)
        .join(again.drop("n"), ["cid", "same"], "left")
        .withColumn("fault", F.when((F.col("fault") != "blank") & F.col("first").isNotNull() & (F.col("first") < F.struct(*order)), F.lit("duplicate")).otherwise(F.col("fault")))
    )
    from pyspark.sql import Window

    inside = Window.partitionBy("cid", "part").orderBy(*order)
    return marked.withColumn("sub", F.floor((F.row_number().over(inside) - 1) / block)).select(*_SIZED, "uid", "part", "sub")


_PASSAGES = "array<struct<state int, to int, cost long, audit string>>"


def _passages(columns: dict[str, list]) -> Iterator[tuple]:
    """Lightest weights of a block from every state to every state, and what it adds to the counts."""
    ends = (columns["conv_id"][0], columns["cid"][0], columns["part"][0], columns["sub"][0])
    columns = _remaining(columns)
    faults = columns["fault"]
    rows = [Row(r, f) for r, f in zip(columns["role"], faults, strict=True)]
    ways = []
    for state in range(4):
        found, _ = agenda(state, len(rows), edits(rows), tuple(range(4)), every=True)
        ways += [{"state": state, "to": to, "cost": c, "audit": a} for to, (c, a) in found.items()]
    roles = columns["role"]
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    yield *ends, *counts, _illegal(roles), (roles or [None])[0], (roles or [None])[-1], ways


def _whole(columns: dict[str, list]) -> Iterator[tuple]:
    """The same agenda over blocks instead of rows; gives each block the state and the edits of the lightest way."""
    ways: list[dict[int, list[Deduction]]] = []
    for k, passages in enumerate(columns["ways"]):
        ways.append({})
        for w in passages:
            ways[k].setdefault(w["state"], []).append((k + 1, w["to"], w["cost"], w["audit"]))
    n = len(ways)
    found, came = agenda(START, n, lambda i, state: ways[i].get(state, ()) if i < n else (), GOALS)
    ((goal, (cost, audit)),) = found.items()
    path = [(n, goal)]
    while path[-1] in came:
        path.append(came[path[-1]])
    path.reverse()
    ends = [(a, b) for a, b in zip(columns["opens"], columns["closes"], strict=True) if a is not None]
    seams = sum(x[1][:1] + y[0][:1] not in LEGAL for x, y in zip(ends, ends[1:], strict=False))
    counts = [sum(columns[c]) for c in ("blank", "duplicate", "truncated")]
    # audits are as long as the conversation has rows: only the first block's row carries the whole
    for k, ((_, state), (_, to)) in enumerate(zip(path, path[1:], strict=False)):
        own = next(a for _, t, _, a in ways[k][state] if t == to)
        first = (*counts, sum(columns["illegal"]) + seams, cost, audit) if k == 0 else (None,) * 6
        yield columns["conv_id"][0], columns["cid"][0], columns["part"][k], columns["sub"][k], state, own, *first


def _replayed(columns: dict[str, list]) -> Iterator[tuple]:
    """Repaired turns of a block."""
    start, audit = columns["state"][0], columns["own"][0]
    conv, cid, part, sub = (columns[c][0] for c in ("conv_id", "cid", "part", "sub"))
    left = _remaining(columns)
    for place, (role, text) in enumerate(replay(audit, start, list(zip(left["role"], left["text"], strict=True)))):
        yield conv, cid, part, sub, place, role, text


def _solved(conv_type: str, blocks: DataFrame) -> DataFrame:
    head = f"conv_id {conv_type}, cid string, part int, sub long"
    counts = "blank long, duplicate long, truncated long, illegal long"
    ways = _by_group(blocks, ["cid", "part", "sub"], [*_ORDER, "uid"], _passages, f"{head}, {counts}, opens string, closes string, ways {_PASSAGES}")
    return keep(_by_group(ways, ["cid"], ["part", "sub"], _whole, f"{head}, state int, own string, {counts}, cost long, audit string"), "solved-blocks")


def _long_turns(conv_type: str, blocks: DataFrame, solved: DataFrame) -> DataFrame:
    edits_of = solved.select("cid", "part", "sub", "state", "own")
    rows = blocks.join(edits_of, ["cid", "part", "sub"])
    schema = f"conv_id {conv_type}, cid string, part int, sub long, place long, role string, text string"
    return _by_group(rows, ["cid", "part", "sub"], [*_ORDER, "uid"], _replayed, schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's turns in order; only the state of one hash is held."""
    key, state = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"cid": [key], "repaired_sha256": [state.hexdigest()]})

    for batch in batches:
        for cid, role, text in zip(*[batch.column(c).to_pylist() for c in ("cid", "role", "text")], strict=True):
            if cid != key:
                if state is not None:
                    yield out()
                key, state = cid, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
    if state is not None:
        yield out()


def _long_reports(conv_type: str, blocks: DataFrame) -> DataFrame:
    solved = _solved(conv_type, blocks)
    turns = _long_turns(conv_type, blocks, solved).select("cid", "part", "sub", "place", "role", "text")
    digests = turns.repartition("cid").sortWithinPartitions("cid", "part", "sub", "place").mapInArrow(_hashed, "cid string, repaired_sha256 string")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = blocks.filter(~F.col("dropped")).groupBy("cid").agg(F.coalesce(span, F.lit(0)).alias("gaps"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        solved.filter(F.col("audit").isNotNull())
        .join(gaps, "cid", "left")
        .join(digests, "cid", "left")
        .select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", none).alias("repaired_sha256"))
    )


# --- operator


def repair_reports(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation: `conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`.

    `rows` comes from `ordered` or `damaged`. A conversation of up to `block` rows is solved by one task. A
    longer one is dealt into blocks of its order, each solved between all pairs of states, and the blocks are
    joined by the same agenda; what a task then holds are audits (one character a row), not texts.
    A null role or text is one space, so a null text is blank; rows without conv_id form a conversation; a
    row without a role initial can not be kept; equal rows are duplicates; a conversation whose rows are all
    dropped has zeros and the hash of nothing; an empty table gives no row.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    short, blocks = _parted(rows, block)
    schema = f"conv_id {kind}, {_COUNTS}, cost long, audit string, repaired_sha256 string"
    reports = _by_group(short.select(*_SIZED), ["cid"], list(_ORDER), _report, schema)
    return reports if blocks is None else reports.unionByName(_long_reports(kind, blocks))


def repaired_turns(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired conversations: `conv_id, part, sub, place, role, text`, in order of the three numbers."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    short, blocks = _parted(rows, block)
    schema = f"conv_id {kind}, part int, sub long, place long, role string, text string"
    turns = _by_group(short.select(*_SIZED), ["cid"], list(_ORDER), _turns, schema)
    return turns if blocks is None else turns.unionByName(_long_turns(kind, blocks, _solved(kind, blocks)).drop("cid"))
