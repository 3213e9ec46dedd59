"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift.llm import spans as S
from fieldsift.llm.common import texts

# fixed values: the patterns of the three kinds and how long a match must be
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 20
HEX_LEAST = 24
NAMES = ["assign", "access", "hex", "entropy"]

WINDOW = 20
#: Class of characters, and the bits a window of them must have. Twenty random characters have about 3.4 bits
#: out of 16 symbols and 4.0 out of 64; words of one alphabet stay below.
CLASSES = {"0-9A-Fa-f": 3.1, "A-Za-z0-9+/_-": 3.8}
#: Candidates that are no secrets whatever their entropy: numbers, words (also joined with short numbers) and
#: identifiers in five groups. Possessive, so that a run of any length is matched without a deeper stack.
ALLOWED = [
    r"^[0-9]++$",
    r"^[A-Za-z]*+$",
    r"^[-_/+]*+(?:[A-Za-z]{1,19}+|[0-9]{1,8}+)(?:[-_/+]++(?:[A-Za-z]{1,19}+|[0-9]{1,8}+))*+[-_/+]*+$",
    r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
]
#: Letters and digits between separators that hold one of these are no secret; what stands beside them may be.
PLACEHOLDER = r"(?i:example|sample|dummy|placeholder|changeme|xxxx|0123456|abcdefg)"
PIECE = rf"[A-Za-z0-9]*?{PLACEHOLDER}[A-Za-z0-9]*"


def base_spans(text: Column) -> Column:
    """Matches of the fixed patterns, shorter ones dropped."""
    assign = S.matches(text, ASSIGN, 0, text.rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"))
    assign = F.filter(assign, lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_LEAST)
    access = S.matches(text, ACCESS, 1, F.contains(text, F.lit("AKIA")))
    access = F.filter(access, lambda s: F.length(s["value"]) >= ACCESS_LEAST)
    # a run that is long enough is found whole, as shorter ones cannot end in it
    hex_ = S.matches(text, f"[0-9a-f]{{{HEX_LEAST},}}", 2, text.rlike(f"[0-9a-f]{{{HEX_LEAST}}}"))
    return S.ordered(assign, access, hex_)


def entropy_windows(value: Column, threshold: float, window: int = WINDOW) -> Column:
    """Ranges `start, end` of an ASCII string that windows of at least `threshold` bits cover, merged.

    The sum of c log2 c over the counts of a window changes by one leaving and one arriving character; only
    their counts within the rest of the window are looked up at each step. A window must hold a letter and a
    digit.
    """
    raw = value.cast("binary")
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    # with at most this sum a window has the bits
    most = window * (math.log2(window) - threshold) + 1e-9
    ranges = "array<struct<start:int,end:int>>"
    begin = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), S.empty(ranges).alias("out"))

    def closed(acc: Column) -> Column:
        one = F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))
        return F.when(acc["end"] < 0, acc["out"]).otherwise(F.concat(acc["out"], one))

    def step(acc: Column, p: Column) -> Column:
        low = F.greatest(p - (window - 1), F.lit(0))
        rest = raw.substr(low + 1, p - low).cast("string")  # what stays from the window before
        arriving = raw.substr(p + 1, F.lit(1)).cast("string")
        leaving = raw.substr(p - window + 1, F.lit(1)).cast("string")
        times = lambda c: F.length(rest) - F.length(F.replace(rest, c, F.lit("")))
        come, go = times(arriving), times(leaving)
        moved = F.get(weight, come + 1) - F.get(weight, come)
        lost = F.when(p >= window, F.get(weight, go) - F.get(weight, go + 1)).otherwise(F.lit(0.0))
        total = acc["sum"] + moved + lost
        whole = F.concat(rest, arriving)
        hit = (p >= window - 1) & (total <= most) & whole.rlike("[0-9]") & whole.rlike("[A-Za-z]")
        start, end = p - (window - 1), p + 1
        joins = hit & (start <= acc["end"])
        return F.struct(
            total.alias("sum"),
            F.when(hit & ~joins, start).otherwise(acc["start"]).alias("start"),
            F.when(hit, end).otherwise(acc["end"]).alias("end"),
            F.when(hit & ~joins, closed(acc)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.length(value) - 1), begin, step, closed)


def entropy_spans(text: Column, base: Column) -> Column:
    """Spans of high entropy that no base span covers and no allowed form explains."""
    found = []
    for letters, threshold in CLASSES.items():
        run = f"(?<![{letters}])[{letters}]{{{WINDOW},}}"
        gate = text.rlike(f"(?<![{letters}])(?=[{letters}]{{{WINDOW}}})[{letters.replace('0-9', '')}]*+[0-9]")
        kept = F.filter(S.matches(text, run, 3, gate), lambda s: ~_allowed(s["value"]))

        def windows(s: Column, threshold: float = threshold) -> Column:
            return _shifted(s, entropy_windows(s["value"], threshold))

        found.append(F.flatten(F.transform(kept, lambda s: windows(s))))
    uncovered = lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    pieces = S.matches(text, rf"(?<![A-Za-z0-9]){PIECE}", 3, text.rlike(PLACEHOLDER))
    hexes = F.flatten(F.transform(found[0], lambda s: S.without(s, pieces, WINDOW)))
    # a string of the narrower class is reported once; what it leaves of a longer one still counts
    others = F.flatten(F.transform(found[1], lambda s: S.without(s, F.array_sort(F.concat(hexes, pieces)), WINDOW)))
    return F.filter(F.concat(hexes, others), uncovered)


def _shifted(s: Column, ranges: Column) -> Column:
    return F.transform(
        ranges,
        lambda r: F.struct(
            (s["start"] + r["start"]).alias("start"),
            F.lit(3).alias("kind"),
            (s["start"] + r["end"]).alias("end"),
            s["value"].substr(r["start"] + 1, r["end"] - r["start"]).alias("value"),
        ),
    )


def _allowed(value: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | value.rlike(pattern)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """`doc_id, base, extra` for every row: spans of the fixed kinds, and those that entropy adds.

    One pass without a shuffle. A null or empty text has no span; rows are scanned one by one, so repeated rows
    and rows without id come back alike; an empty table gives no row. Of equal starts the kind decides.
    """
    rows = texts(docs).withColumn("base", base_spans(F.col("text")))
    return rows.select("doc_id", "base", entropy_spans(F.col("text"), F.col("base")).alias("extra"))
