"""Packing by power-of-two decomposition: every piece of a document is a sequence of its own, without padding."""

from __future__ import annotations

import zlib
from array import array
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.common import by_batch, texts

SEQUENCE = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a task remembers; more only empties the memory, results stay the same.
REMEMBERED = 500_000
_WIDTH = array("I").itemsize  # 4; the machines Spark runs on are little-endian


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: visible ones stand for themselves."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds(dict):
    """Token ids of words, as little-endian unsigned 32-bit bytes; a word is encoded once and remembered.

    The vocabulary drops white space before it merges, so the ids of a text are those of its words in turn. A
    word of Latin letters, with or without marks behind it, needs no normalising beyond lower case and goes
    straight to the merges; any other takes the way through the whole tokenizer.
    """

    MARKS = b".,;:!?|*$%&#"
    LETTERS = _byte_letters()

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.remembered = remembered

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.remembered:
            self.clear()
        stem = word.rstrip(self.MARKS)
        plain = stem.decode("utf-8")
        if plain.isalpha() and max(plain) < "\u0250" and "\u0130" not in plain:
            mapped = plain.lower()
            if not mapped.isascii():
                mapped = mapped.encode("utf-8").decode("latin-1").translate(self.LETTERS)
            found = array("I", [t.id for t in self.merge(mapped)]).tobytes()
            if len(stem) < len(word):  # letters and marks never share a token
                found += self[word[len(stem) :]]
        else:
            found = array("I", self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids).tobytes()
        self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        raw = text.encode("utf-8")
        if b"<|" not in raw:  # else a special token might come about
            raw = raw.lower()
        return b"".join(map(self.__getitem__, raw.split()))  # bytes: ASCII white space and capitals only


def binary_lengths(tokens: int, most: int = SEQUENCE) -> list[int]:
    """Powers of two, largest first, that add up to `tokens`; `most` is repeated as often as it fits."""
    rest = tokens % most
    return [most] * (tokens // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if rest >> k & 1]


#: One encoder per task process and vocabulary file.
_ENCODERS: dict[str, WordIds] = {}


def _pieces(columns: dict[str, list], path: str, most: int) -> dict[str, list]:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    encoder = _ENCODERS[path]
    out: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
    end = END_ID.to_bytes(_WIDTH, "little")
    for doc, text in zip(columns["doc_id"], columns["text"], strict=True):
        ids = encoder.encode(text) + end
        lengths = binary_lengths(len(ids) // _WIDTH, most)
        starts = [0, *accumulate(lengths)]
        out["doc_id"] += [doc] * len(lengths)
        out["start"] += starts[:-1]
        out["length"] += lengths
        out["ids_crc32"] += [zlib.crc32(ids[_WIDTH * a : _WIDTH * b]) for a, b in zip(starts, starts[1:], strict=False)]
        out["doc_tokens"] += [starts[-1]] * len(lengths)
    return out


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: `doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket`.

    A document's ids and the end id are cut, largest first, into pieces whose lengths are powers of two up to
    `sequence` (itself one). Each piece is a whole sequence, so none crosses documents and none is padded;
    `bucket` is the binary logarithm of its length, by which training batches are filled with equal lengths.
    Rows are independent, so nothing is shuffled, and `sequence_id` (input partition and place in it) is
    the same after a retry. A null or blank text is the end id alone; repeated rows and rows without id are
    packed like others; an empty table gives no row.
    """
    if sequence & (sequence - 1):
        raise ValueError("a sequence must hold a power of two of tokens")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = by_batch(texts(docs), _pieces, schema, path or vocabulary_path(), sequence)
    return pieces.select(
        "*",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.log2("length").cast("int").alias("bucket"),
    )
