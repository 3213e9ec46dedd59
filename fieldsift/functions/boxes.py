"""Boxes as [x0, y0, x1, y1] in thousandths of the image."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldsift.functions.text import try_json


def iou(a: Column | Sequence[Column], b: Column | Sequence[Column]) -> Column:
    """Overlap over union; zero for boxes that do not overlap. A box is an array or its four corners."""
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    both = width * height
    union = area(a) + area(b) - both
    return F.when((width > 0) & (height > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


def to_thousandths(share: Column) -> Column:
    return F.bround(F.least(F.lit(1000.0), F.greatest(F.lit(0.0), share * 1000))).cast("int")


#: Four numbers, quoted or not, and nothing else.
_NUMBER = r'"?\s*[+-]?[0-9]+(?:\.[0-9]+)?\s*"?'
FOUR = rf"^\s*\[\s*{_NUMBER}(?:\s*,\s*{_NUMBER}){{3}}\s*\]\s*$"


#: A list of lists of whole numbers, quoted or not, as nearly all texts are: read without a JSON parser.
_WHOLE = r'(?:-?(?:0|[1-9][0-9]{0,8})|"-?(?:0|[1-9][0-9]{0,8})")'
_LIST = rf"\[ *{_WHOLE}(?: *, *{_WHOLE})*+ *\]"
PLAIN = rf"^\[ *{_LIST}(?: *, *{_LIST})*+ *\]$"


def box_list(text: Column) -> Column:
    """The entries of a JSON list that are boxes of four numbers; null when the text is no list."""
    entries = F.filter(try_json(text, "array<string>"), lambda e: e.rlike(FOUR))
    numbers = lambda e: F.transform(F.regexp_extract_all(e, F.lit(r"[+-]?[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda v: v.cast("double").cast("int"))
    bare = lambda c, *signs: bare(F.replace(c, F.lit(signs[0]), F.lit("")), *signs[1:]) if signs else c
    # split at one character, as Java compiles any longer pattern anew for each text
    apart = F.replace(bare(text, "[", '"', " "), F.lit("],"), F.lit(";"))
    plain = F.transform(F.split(bare(apart, "]"), ";"), lambda e: F.split(e, ",").cast("array<int>"))
    return F.when(text.rlike(PLAIN), F.filter(plain, lambda e: F.size(e) == 4)).otherwise(F.transform(entries, lambda e: numbers(e)))
