"""Byte-level BPE as a monoid: token sequences of neighbouring parts are joined by re-encoding their boundary alone.

Why a join is right: BPE always merges the leftmost pair of lowest rank, so a sequence of tokens is the encoding of
its bytes if and only if each two neighbours are the encoding of theirs (the first merge across a boundary would also
happen with the two tokens alone). Parts of an encoding are therefore encodings. If a re-encoded window around the
boundary begins with the very token that it began with before, and ends with the one that it ended with, every pair of
neighbours is one of the left part, of the window or of the right part, and no token outside can change any more.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.common import texts

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces whose ids a task remembers, in each of two generations, and windows; results stay the same whatever it is.
REMEMBERED = 400_000
#: Rows that a task turns into numbers of Python, or back, at a time; Spark's batches may hold 10,000 long texts.
ROWS = 128
_NONE = 1 << 40  # above all ranks
_LEAF = 8  # bytes of a leaf of the tree
_SHORT = 24  # bytes of a window that is remembered
_WIDTH = array("i").itemsize  # 4; the machines Spark runs on are little-endian


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    """The pattern whose matches are encoded each by itself."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Memory(dict):
    """What `find` gives for a key, remembered in two generations.

    When the younger is full it becomes the older, from which keys met again come back.
    """

    def __init__(self, find: Callable[[str], bytes], remembered: int) -> None:
        super().__init__()
        self.find, self.remembered = find, remembered
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.remembered:
            self.older = dict(self)
            self.clear()
        found = self.older.get(key)
        if found is None:
            found = self.find(key)
        self[key] = found
        return found


class Encoder:
    """Ids as little-endian 32-bit bytes; a piece is encoded once by the tree and remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.findall = regex.compile(pattern).findall
        self.pieces = _Memory(self.piece, remembered)
        self.remembered = remembered
        self.windows: dict[bytes, list[int]] = {}

    def piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        # a piece that is a token is that token, whatever its merges would give
        return array("i", [self.ranks[raw]] if raw in self.ranks else self.tree(raw)).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.findall(text)))

    def merges(self, raw: bytes) -> list[int]:
        """Ids by merging the leftmost pair of lowest rank until no pair is a token; O(n log n) where long."""
        n, ranks = len(raw), self.ranks
        if n <= _SHORT:
            parts = [raw[i : i + 1] for i in range(n)]
            pairs = [ranks.get(raw[i : i + 2], _NONE) for i in range(n - 1)]
            while pairs and (least := min(pairs)) < _NONE:
                i = pairs.index(least)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
                if i < len(pairs):
                    pairs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
            return [ranks[p] for p in parts]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # of the part that begins here; 0 where none does any more
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = after[i]
            if not end[i] or j >= n or end[j] != stop:
                continue  # one of the two parts has changed since
            end[i], end[j], after[i] = stop, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(raw[i : end[after[i]]])) is not None:
                    heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := ranks.get(raw[before[i] : stop])) is not None:
                heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = after[i]
        return out

    def window(self, raw: bytes) -> list[int]:
        """As `merges`; windows are short and come again, so the ids of those are remembered."""
        found = self.windows.get(raw)
        if found is None:
            found = self.merges(raw)
            if len(raw) <= _SHORT:
                if len(self.windows) >= self.remembered // 2:
                    self.windows.clear()
                self.windows[raw] = found
        return found

    def tree(self, raw: bytes) -> list[int]:
        """Ids of a piece: both halves by themselves, then joined; a part of a few bytes is merged as it is."""
        if len(raw) <= _LEAF:
            return self.window(raw)
        half = len(raw) // 2
        return self.join(self.tree(raw[:half]), self.tree(raw[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's product. The empty sequence is its unit."""
        if not left or not right:
            return left or right
        a = b = 1  # tokens of the window on either side
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.window(self.decode(left[-a:] + right[:b]))
            settled_left = a == len(left) or window[0] == left[-a]
            settled_right = b == len(right) or window[-1] == right[b - 1]
            if settled_left and settled_right:
                return left[:-a] + window + right[b:]
            a, b = a if settled_left else 2 * a, b if settled_right else 2 * b

    def decode(self, ids: list[int], leaf: int = 4096) -> bytes:
        """Bytes of ids: concatenation up the same tree."""
        if len(ids) <= leaf:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)


#: One encoder per task process, vocabulary file and pattern.
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(read_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def _lists(parts: Iterable[bytes]) -> pa.ListArray:
    parts = list(parts)
    ends = np.cumsum([0, *(len(p) // _WIDTH for p in parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _encoded(batches: Iterable[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    known = encoder(path, pattern)
    for batch in _slices(batches):
        ids = _lists(known.encode(t) for t in batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])


def _decoded(batches: Iterable[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    known = encoder(path, pattern)
    for batch in _slices(batches):
        ids = batch.column("ids")
        flat, ends = ids.flatten().to_numpy(), np.append(0, np.cumsum(ids.value_lengths().to_numpy()))
        # one document's ids at a time as numbers of Python
        raw = pa.array([known.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), raw], ["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`doc_id, ids array<int>` of every whole text, as the public library's ordinary encoding gives them.

    One pass, no shuffle. A null or empty text has no ids; repeated rows and rows without id are encoded like
    others; other columns are ignored; an empty table gives no row. A very long piece without a break is
    encoded by the tree too, in about n log^2 n steps.
    """
    where = path or vocabulary_path(), pattern or split_pattern()
    return texts(docs).mapInArrow(lambda batches: _encoded(batches, *where), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`encoded` (`doc_id, ids`) with `decoded`, the bytes of the ids; null ids are none, an unknown id is an error.

    Ids cut within a character decode to part of its bytes, hence bytes and not text.
    """
    where = path or vocabulary_path(), pattern or split_pattern()
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(lambda batches: _decoded(batches, *where), "doc_id long, ids array<int>, decoded binary")
