"""Phrase collocations from a weighted de Bruijn graph of the corpus.

Nodes are two neighbouring words, edges three; an edge's weight is how often it occurs. Every occurrence of a word
gives one edge, so a piece's last two words give edges into its end. The flow out of a node, ends included, is
therefore the count of its two words, and the flow out of all nodes of a word that word's count: nothing but edges
is counted in the texts. Nodes through which a single edge leads in and out with all the flow are compacted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldsift.llm.common import keep

LEAST = 10  # occurrences of a candidate
PERCENT = 50  # of a candidate's occurrences within a longer one, from which it is dropped
TOP = 2000
NO_LANGUAGE = "und"
#: Tokens whose edges a task adds up before it hands them on, and characters of text for each bucket of the graph.
FLUSH_TOKENS, BUCKET_CHARACTERS = 3_000_000, 8_000_000
#: Partitions of the buckets, at most; one that has several takes them one after the other.
PARTITIONS = 20_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)  # odd factors that spread the buckets
_END = b"\xff"  # no byte of UTF-8
_LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n")


class _Numbers(dict):
    """A number for each word in order of appearance; the end has 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def _added(three: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different columns of three numbers each, in order, and the sums of their weights (1 by default)."""
    bits = [int(row.max(initial=0)).bit_length() for row in three]
    if sum(bits) > 63:  # more different words than a key has bits for
        found, place, counts = np.unique(three, axis=1, return_inverse=True, return_counts=True)
        place = place.reshape(-1)
    else:
        keys = three[0].astype(np.int64)
        for row, width in zip(three[1:], bits[1:], strict=True):
            keys <<= width
            keys |= row
        keys, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
        found = np.stack([keys >> bits[1] + bits[2], keys >> bits[2] & (1 << bits[1]) - 1, keys & (1 << bits[2]) - 1])
    return found, counts if weights is None else np.bincount(place, weights, len(counts)).astype(np.int64)


class _Graph:
    """Edges of the texts of one language that a task has read."""

    def __init__(self) -> None:
        self.numbers = _Numbers({_END: 0})
        self.held: list[np.ndarray] = []

    def add(self, text: str) -> int:
        """A-Z lowered, ends of pieces marked, all other white space between words."""
        words = text.encode("utf-8").translate(_LETTERS).replace(b"\n", b" " + _END + b" ").split()
        if not words:
            return 0
        self.held.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.held.append(np.zeros(2, np.int32))
        return len(words)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        w = np.concatenate(self.held)
        return _added(np.stack([w[:-2], w[1:-1], np.where(w[1:-1] == 0, 0, w[2:])])[:, w[:-2] != 0])


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _blocks(lang: str, graph: _Graph, buckets: int) -> pa.RecordBatch:
    """The graph cut by node into buckets, each with the words it needs and edges numbered by them."""
    three, weights = graph.edges()
    words = list(graph.numbers)
    mixed = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    bucket = (mixed[three[0]] * _MIX[0] + mixed[three[1]] * _MIX[1]) >> np.uint64(32)
    bucket = (bucket % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    three, weights, bucket = three[:, order], weights[order], bucket[order]
    present, starts = np.unique(bucket, return_index=True)
    ends = np.append(starts, len(bucket))
    own, numbered, sizes = [], np.empty(three.shape, np.int32), [0]
    for a, b in zip(ends, ends[1:], strict=False):
        used, place = np.unique(three[:, a:b], return_inverse=True)
        if used[0]:  # number 0 is the end in every block
            used, place = np.append(0, used), place + 1
        numbered[:, a:b] = place.reshape(3, -1)
        own.append(used)
        sizes.append(sizes[-1] + len(used))
    text = pa.array([b"", *words[1:]], pa.binary()).cast(pa.string()).take(pa.array(np.concatenate(own)))
    columns = [pa.array(present, pa.int64()), pa.repeat(pa.scalar(lang, pa.string()), len(present))]
    columns.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), text))
    columns += [_lists(row, ends, pa.int32()) for row in numbered]
    return pa.RecordBatch.from_arrays([*columns, _lists(weights, ends, pa.int64())], _BLOCK)


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    graphs: dict[str, _Graph] = {}
    tokens = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            tokens += graphs.setdefault(lang, _Graph()).add(text)
            if tokens >= FLUSH_TOKENS:
                for name, graph in graphs.items():
                    if graph.held:
                        yield _blocks(name, graph, buckets)
                graphs, tokens = {}, 0
    for name, graph in graphs.items():
        if graph.held:
            yield _blocks(name, graph, buckets)


class _Sum:
    """The blocks of one bucket and language, added up."""

    def __init__(self) -> None:
        self.numbers = _Numbers({"": 0})
        self.edges: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []

    def add(self, words: list[str], three: np.ndarray, weights: np.ndarray) -> None:
        self.edges.append(np.array([self.numbers[w] for w in words], np.int32)[three])
        self.weights.append(weights)

    def counted(self, lang: str, least: int) -> pa.RecordBatch:
        """Words with what this bucket knows of their counts, and nodes and edges that are heavy enough."""
        (first, second, third), c = _added(np.concatenate(self.edges, axis=1), np.concatenate(self.weights))
        starts = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        flow = np.add.reduceat(c, starts)
        whole = np.repeat(flow, np.diff(np.append(starts, len(c))))
        heads = np.flatnonzero(np.append(True, first[starts][1:] != first[starts][:-1]))
        nodes = starts[(flow >= least) & (second[starts] != 0)]
        edges = np.flatnonzero((c >= least) & (third != 0))
        words = pa.array([None, *list(self.numbers)[1:]], pa.string())
        none = lambda n: np.zeros(n, first.dtype)
        w1 = np.concatenate([first[starts][heads], first[nodes], first[edges]])
        w2 = np.concatenate([none(len(heads)), second[nodes], second[edges]])
        w3 = np.concatenate([none(len(heads) + len(nodes)), third[edges]])
        f = np.concatenate([np.add.reduceat(flow, heads), whole[nodes], c[edges]])
        node = np.concatenate([none(len(heads)), whole[nodes], whole[edges]])
        columns = [pa.repeat(pa.scalar(lang, pa.string()), len(f)), *[words.take(pa.array(w)) for w in (w1, w2, w3)]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(f, pa.int64()), pa.array(node, pa.int64())], _COUNTED)


def _add_up(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One bucket at a time, whose blocks follow each other."""
    bucket, sums = None, {}
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: column[i] for name, column in zip(_BLOCK, batch.columns, strict=True)}
            if row["bucket"].as_py() != bucket:
                yield from (s.counted(lang, least) for lang, s in sums.items())
                bucket, sums = row["bucket"].as_py(), {}
            three = np.stack([row[e].values.to_numpy(zero_copy_only=False) for e in ("e1", "e2", "e3")])
            sums.setdefault(row["lang"].as_py(), _Sum()).add(row["words"].as_py(), three, row["c"].values.to_numpy(zero_copy_only=False))
    yield from (s.counted(lang, least) for lang, s in sums.items())


_BLOCK = ["bucket", "lang", "words", "e1", "e2", "e3", "c"]
_COUNTED = ["lang", "w1", "w2", "w3", "f", "node"]


def graph(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """`lang, w1, w2, w3, f, node`, stored: all words, and the nodes and edges of a weight of at least `least`.

    `f` is the count of the words that are not null; an edge also has the flow of its node. Tasks add up the
    edges of their texts and hand them on in blocks by bucket of node, with each word once a block. The number
    of buckets grows with the texts, so a task that adds up a bucket holds a bounded part of the graph; a node lies
    in one bucket, so its flow is known there, and only the counts of words meet once more.
    """
    rows = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, size // BUCKET_CHARACTERS)
    blocks = rows.mapInArrow(lambda b: _count(b, buckets), "bucket long, lang string, words array<string>, e1 array<int>, e2 array<int>, e3 array<int>, c array<long>")
    sums = blocks.repartitionById(int(min(buckets, PARTITIONS)), F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(lambda b: _add_up(b, least), "lang string, w1 string, w2 string, w3 string, f long, node long")
    return keep(sums.groupBy("lang", "w1", "w2", "w3").agg(F.sum("f").alias("f"), F.max("node").alias("node")), "graph")


def unary_paths(heavy: DataFrame) -> DataFrame:
    """`lang, words, c, first`: maximal paths of edges (`lang, w1, w2, w3, f, node`) that lead through unary nodes.

    An edge goes on to the next one where both have the whole flow of the node between them. `first` is the flow
    of the path's first node; every node inside has the path's weight. Heads are found by doubling pointers, in
    as many rounds as the longest path has binary digits. A piece begins and ends somewhere, so no path is a
    ring, and none is longer than the longest piece.
    """
    rows = keep(heavy.withColumn("id", F.monotonically_increasing_id()), "edges")
    before = rows.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "f", F.col("id").alias("ptr"))
    whole = rows.filter(F.col("f") == F.col("node")).select("lang", "w1", "w2", "f", "id")
    one = F.lit(1).cast("long")
    ways = keep(whole.join(before, ["lang", "w1", "w2", "f"]).select("id", "ptr", one.alias("steps"), F.lit(True).alias("moved")), "ways")
    # an edge without a row here is a head; rows that point to one have arrived and stay for those behind them
    while not ways.filter("moved").isEmpty():
        ahead = ways.select(F.col("id").alias("ptr"), F.col("ptr").alias("on"), F.col("steps").alias("more"))
        steps = F.col("steps") + F.coalesce("more", F.lit(0))
        further = ways.drop("moved").join(ahead, "ptr", "left")
        ways = keep(further.select("id", F.coalesce("on", "ptr").alias("ptr"), steps.alias("steps"), F.col("on").isNotNull().alias("moved")), "ways")
    placed = rows.join(ways.select("id", "ptr", "steps"), "id", "left").withColumn("head", F.coalesce("ptr", "id"))
    per = placed.groupBy("head").agg(
        F.max("lang").alias("lang"),
        F.max("f").alias("c"),
        F.min(F.when(F.col("ptr").isNull(), F.struct("w1", "w2", "node"))).alias("start"),
        F.sort_array(F.collect_list(F.struct(F.coalesce("steps", F.lit(0)).alias("step"), "w3"))).alias("rest"),
    )
    words = F.concat(F.array("start.w1", "start.w2"), F.transform("rest", lambda r: r["w3"]))
    return per.select("lang", words.alias("words"), "c", F.col("start.node").alias("first"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """Whole part of 1,000,000 a a / (l r), in whole numbers of up to 38 digits."""
    digits = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", (digits(a) * digits(a) * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"), (digits(left) * digits(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, top: int = TOP) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score`: the first `top` phrases of two or three words of each language.

    `a` counts the phrase, `l` and `r` the parts on either side of the cut of least score (ties: the earlier
    cut), `n` all words of the language. Two words are dropped where a candidate of three holds them in at least
    `percent` of their occurrences. Ranked by score, then `a`, both descending, then phrase in byte order.
    A null text is empty, a null language `und`; repeated rows count each; a language without candidates, and
    an empty table, give no row.
    """
    counted = graph(docs, least)
    single = counted.filter(F.col("w2").isNull()).select("lang", F.col("w1").alias("w"), "f")
    total = single.groupBy("lang").agg(F.sum("f").alias("n"))
    known = single.filter(F.col("f") >= least)  # no part of a candidate is rarer than the candidate
    nodes = counted.filter(F.col("w2").isNotNull() & F.col("w3").isNull()).select("lang", "w1", "w2", "f")
    paths = keep(unary_paths(counted.filter(F.col("w3").isNotNull())), "paths")

    # three words: windows of the paths; only a path's last node has to be looked up
    size = F.size("words")
    ends = F.struct(F.col("words")[size - 2].alias("w1"), F.col("words")[size - 1].alias("w2")).alias("end")
    ended = paths.select("*", ends).join(nodes.select("lang", F.struct("w1", "w2").alias("end"), F.col("f").alias("last")), ["lang", "end"])
    window = ended.select("lang", "words", "c", "first", "last", F.explode(F.sequence(F.lit(0), size - 3)).alias("i"))
    at = lambda k: F.col("words")[F.col("i") + k]
    three = window.select(
        "lang", at(0).alias("w1"), at(1).alias("w2"), at(2).alias("w3"), F.col("c").alias("a"),
        F.when(F.col("i") == 0, F.col("first")).otherwise(F.col("c")).alias("head"),
        F.when(F.col("i") == size - 3, F.col("last")).otherwise(F.col("c")).alias("tail"),
    )
    # two words: nodes that no edge carries for the most part; edges into a node end paths, or lie on one with the next
    mostly = lambda f: F.col(f) * 100 >= F.col("f") * percent
    leaving = three.groupBy("lang", "w1", "w2").agg(F.max("a").alias("out"))
    entering = ended.groupBy("lang", F.col("end.w1").alias("w1"), F.col("end.w2").alias("w2")).agg(F.max("c").alias("into"))
    free = nodes.join(leaving, ["lang", "w1", "w2"], "left").join(entering, ["lang", "w1", "w2"], "left")
    two = free.filter(~F.coalesce(mostly("out"), F.lit(False)) & ~F.coalesce(mostly("into"), F.lit(False)))
    count = F.col("f")
    phrases = three.unionByName(two.select("lang", "w1", "w2", F.lit(None).cast("string").alias("w3"), count.alias("a"), count.alias("head"), count.alias("tail")))

    of = lambda w, f: known.select("lang", F.col("w").alias(w), F.col("f").alias(f))
    last = phrases.withColumn("w", F.coalesce("w3", "w2"))
    scored = last.join(of("w1", "f1"), ["lang", "w1"]).join(of("w", "fn"), ["lang", "w"])
    early = F.when(F.col("w3").isNull(), F.col("fn")).otherwise(F.col("tail"))  # right of the cut after one word
    cut = lambda left, right: F.struct(_score(F.col("a"), left, right).alias("score"), left.alias("l"), right.alias("r"))
    first, second = cut(F.col("f1"), early), cut(F.col("head"), F.col("fn"))
    best = F.when(F.col("w3").isNotNull() & (second["score"] < first["score"]), second).otherwise(first)
    rated = scored.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", best.alias("cut")).select("lang", "phrase", "a", "cut.*")
    # the first of each of many parts, then of those that are left: no task sorts the whole of a language
    order = (F.desc("score"), F.desc("a"), "phrase")
    parts = rated.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first_of = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first_of.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
