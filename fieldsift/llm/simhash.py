"""SimHash near-duplicates through an inverted index on byte positions with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldsift.llm.common import by_batch, keep, texts
from fieldsift.llm.components import components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: Two fingerprints with at most three differing bits differ in at most three of eight bytes.
LEAST_SHARED = 8 - MAX_BITS
_CHUNK = 1 << 16
#: Four byte positions whose numbers cancel out under XOR: 14 quadruples. Any three positions lie outside one of
#: them, so a pair that shares LEAST_SHARED positional bytes shares all four bytes of at least one quadruple.
QUADRUPLES = [q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint as a signed number: bit i is set where over half of the shingle hashes have it."""
    found = text.encode("utf-8").lower().split()  # bytes: only A-Z and ASCII white space count
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = list(zip(starts.tolist(), ends[words - 1 :].tolist(), strict=False)) or [(0, len(joined))]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(spans), _CHUNK):
        part = spans[at : at + _CHUNK]
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in part), np.uint64, len(part))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((2 * counts > len(spans)).astype(np.uint8), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """`doc_id, fp` for every row; null and blank texts have fingerprint zero."""
    return by_batch(
        texts(docs),
        lambda c, n: {"doc_id": c["doc_id"], "fp": [fingerprint(t, n) for t in c["text"]]},
        "doc_id long, fp long",
        words,
    )


def _near(x: np.ndarray) -> np.ndarray:
    """Count filter, then the check: enough shared positional bytes, and few enough differing bits."""
    near = np.bitwise_count(x) <= MAX_BITS
    at = np.nonzero(near)
    shared = (x[at].view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    near[at] = shared >= LEAST_SHARED
    return near


def _forest(fps: np.ndarray, out: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Links that join whatever is linked within one posting, each value reached once; all are compared."""
    rest = fps
    while rest.size > 1:
        front, rest = rest[:1], rest[1:]
        while front.size and rest.size:
            reached = []
            step = max(1, (1 << 21) // rest.size)
            for at in range(0, front.size, step):
                if not rest.size:
                    break
                own = front[at : at + step]
                near = _near(own[:, None] ^ rest[None, :])
                hit = near.any(axis=0)
                if hit.any():
                    out.append((own[near.argmax(axis=0)[hit]], rest[hit]))
                    reached.append(rest[hit])
                    rest = rest[~hit]
            front = np.concatenate(reached) if reached else front[:0]


def _posting(quadruple: int, fps: np.ndarray, out: list, split_above: int = 4096) -> None:
    """Links within one posting. A long one is split further: four shared bytes are given, a fifth must follow."""
    if fps.size <= split_above:
        return _forest(fps, out)
    for p in sorted(set(range(8)) - set(QUADRUPLES[quadruple])):
        byte = (fps >> np.uint64(8 * p)) & np.uint64(0xFF)
        order = np.argsort(byte, kind="stable")
        for part in np.split(fps[order], np.nonzero(np.diff(byte[order]))[0] + 1):
            _forest(part, out)
    return None


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by posting: the links of each; a posting may go on in the next batch."""
    q, k, f = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def done(q: np.ndarray, k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        cuts = np.nonzero((np.diff(k) != 0) | (np.diff(q) != 0))[0] + 1
        bounds = np.concatenate(([0], cuts, [k.size]))
        for i in np.nonzero(np.diff(bounds) > 1)[0]:
            a, b = bounds[i], bounds[i + 1]
            _posting(int(q[a]), f[a:b].astype(np.uint64), out)
        a, b = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)) if out else (f[:0], f[:0])
        return pa.RecordBatch.from_pydict({"a": a, "b": b})

    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        q, k, f = (np.concatenate(x) for x in zip((q, k, f), new, strict=True))
        if not k.size:
            continue
        last = np.nonzero((k != k[-1]) | (q != q[-1]))[0]
        start = last[-1] + 1 if last.size else 0
        if start:
            yield done(q[:start], k[:start], f[:start])
            q, k, f = q[start:], k[start:], f[start:]
    if k.size > 1:
        yield done(q, k, f)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links `a, b` between different fingerprints `fp` that join all that are linked at MAX_BITS or fewer.

    Postings hold four positional bytes at once: a posting of one byte would hold 1/256 of the corpus. Every
    pair of a posting is tallied and checked, but only the links of a spanning forest are handed on.
    """
    keys = [F.struct(F.lit(i).alias("q"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("k")) for i, p in enumerate(QUADRUPLES)]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("x")).select("x.q", "x.k", "fp")
    dealt = rows.repartition("q", "k").sortWithinPartitions("q", "k", "fp")
    return dealt.mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """`doc_id, fp, component_id` for every row; the component is the smallest id that links reach.

    Null and blank texts share fingerprint zero and are linked like any other. Repeated rows each come back.
    Where all rows of a component lack an id, the component is null. An empty table gives no row.
    """
    own = keep(fingerprints(docs, words), "fingerprints")
    distinct = keep(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = keep(components(fingerprint_links(distinct.select("fp"))), "roots")
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return own.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near-duplicates: the smallest id of each component stays, with its columns.

    Of several rows with that id one stays (the smallest text hash); rows without id are left alone, as nothing
    tells which of them to prefer.
    """
    return first_of_each(docs, near_duplicates(docs))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """As `one_of_each`, with components `found` as `doc_id, component_id`."""
    first = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__first")).distinct()
    known = docs.filter(F.col("doc_id").isNotNull()).withColumn("__key", F.col("doc_id").cast("long"))
    # partitioned as the join leaves it, so no second shuffle of the texts
    once = Window.partitionBy("__key").orderBy(F.xxhash64("text"))
    chosen = known.join(first, F.col("__key") == F.col("__first"), "left_semi")
    chosen = chosen.withColumn("__n", F.row_number().over(once)).filter("__n = 1").select(*docs.columns)
    return chosen.unionByName(docs.filter(F.col("doc_id").isNull()))
