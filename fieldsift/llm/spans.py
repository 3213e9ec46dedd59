"""Positions of pattern matches in whole texts, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "array<struct<start:int,kind:int,end:int,value:string>>"


def empty(kind: str = TYPE) -> Column:
    return F.array().cast(kind)


def matches(text: Column, pattern: str, kind: int, gate: Column | None = None, wanted=None) -> Column:
    """Leftmost non-overlapping matches as `start, kind, end, value`: code points from 0, end exclusive.

    A text is cut at the matches; the lengths of what lies between and of the matches add up to the positions.
    `gate` is a cheap condition without which nothing can match; of the matches, `wanted(value)` picks those to list.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    begin = F.struct(F.lit(0).alias("pos"), empty().alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        found = F.concat(acc["found"], F.array(one))
        if wanted is not None:
            found = F.when(wanted(x["value"]), found).otherwise(acc["found"])
        return F.struct(end.alias("pos"), found.alias("found"))

    # the last part of the text follows no match
    pairs = F.zip_with(between, values, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    pairs = F.filter(pairs, lambda x: x["value"].isNotNull())
    found = F.aggregate(pairs, begin, step, lambda acc: acc["found"])
    return found if gate is None else F.when(gate, found).otherwise(empty())


def ordered(*kinds: Column) -> Column:
    """All spans by start, then kind."""
    return F.array_sort(F.concat(*kinds))


def described(spans: Column, names: list[str]) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    table = F.array(*[F.lit(n) for n in names])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat(
                F.get(table, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (o["end"] > span["start"]))


def without(span: Column, cuts: Column, least: int) -> Column:
    """What `cuts` (by start) leave of a span, in parts of `least` characters or more."""

    def part(end: Column, acc: Column) -> Column:
        value = span["value"].substr(acc["pos"] - span["start"] + 1, end - acc["pos"])
        one = F.struct(acc["pos"].alias("start"), span["kind"].alias("kind"), end.alias("end"), value.alias("value"))
        return F.when(end - acc["pos"] >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"])

    def step(acc: Column, c: Column) -> Column:
        meets = (c["start"] < span["end"]) & (c["end"] > acc["pos"])
        pos = F.when(meets, F.least(c["end"], span["end"])).otherwise(acc["pos"])
        return F.struct(pos.alias("pos"), F.when(meets, part(c["start"], acc)).otherwise(acc["out"]).alias("out"))

    begin = F.struct(span["start"].alias("pos"), empty().alias("out"))
    return F.aggregate(cuts, begin, step, lambda acc: part(span["end"], acc))


def replaced(text: Column, spans: Column, tag) -> Column:
    """The text with each span replaced by `tag(span)`; of overlapping ones the first gives the tag."""
    begin = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["pos"]
        gap = text.substr(acc["pos"] + 1, s["start"] - acc["pos"])
        out = F.when(fresh, F.concat(acc["out"], gap, tag(s))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), out.alias("out"))

    def rest(acc: Column) -> Column:
        return F.concat(acc["out"], text.substr(acc["pos"] + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, begin, step, rest))
