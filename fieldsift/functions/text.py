"""String columns: blanks, truthiness, ordered patterns, character runs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldsift import fixed_values as V

CHUNK = 40  # branches per CASE; larger CASEs can outgrow the generated-method limit
_META = set(r"\.^$*+?{}[]()")
_CLASS_ESCAPE = re.compile(r"\\[dwsbDWSB]")


def blank(c: Column | str) -> Column:
    """Null as an empty string."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any script."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Stripped text; null and the word nan become an empty string."""
    text = F.coalesce(strip(c), F.lit(""))
    return F.when(F.lower(text) == "nan", F.lit("")).otherwise(text)


def truthy(c: Column) -> Column:
    """Text that stands for yes: true or 1, any case."""
    return F.lower(F.coalesce(c.cast("string"), F.lit(""))).isin("true", "1")


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(c.cast("string") != "", c) for c in cols])


def found(c: Column, pattern: str) -> Column:
    """Whether `pattern` occurs in the text; plain alternatives are searched without a regex."""
    if not (_META & set(pattern)):
        hits = [F.contains(c, F.lit(word)) for word in pattern.split("|") if word]
        out = hits[0]
        for hit in hits[1:]:
            out = out | hit
        return out
    return c.rlike("(?U)" + pattern if _CLASS_ESCAPE.search(pattern) else pattern)


def first_match(c: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first pattern that occurs in the text."""
    parts = []
    for start in range(0, len(rules), CHUNK):
        case = None
        for pattern, label in rules[start : start + CHUNK]:
            hit, value = found(c, pattern), F.lit(label)
            case = F.when(hit, value) if case is None else case.when(hit, value)
        if case is not None:
            parts.append(case)
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts) if parts else F.lit(default)


def suffix(name: Column, mime: Column) -> Column:
    """Lower-case file suffix from the name, else from the MIME type, else .bin."""
    from_name = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    types = F.create_map(*[F.lit(x) for pair in V.MIME_SUFFIX.items() for x in pair])
    return F.coalesce(
        F.when(F.contains(name, F.lit(".")), from_name), F.try_element_at(types, F.coalesce(mime, F.lit(""))), F.lit(".bin")
    )


def safe_name(c: Column, fallback: str = "_", most: int | None = None) -> Column:
    """A folder-safe name, cut to `most` characters when asked for (cut names can meet)."""
    cleaned = F.regexp_replace(blank(c), r'[/\\:*?"<>|\n\r\t]+', "_")
    trimmed = F.regexp_replace(strip(cleaned), r"^\.+|\.+$", "")
    trimmed = trimmed if most is None else F.substring(trimmed, 1, most)
    return F.when(trimmed == "", F.lit(fallback)).otherwise(trimmed)


def grams(c: Column, run: str = "[一-鿿]+", lo: int = 2, hi: int = 4) -> Column:
    """Distinct substrings of `lo` to `hi` characters inside each run of wanted characters."""

    def pieces(word: Column, n: int) -> Column:
        starts = F.when(F.length(word) >= n, F.sequence(F.lit(1), F.length(word) - (n - 1))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))

    def of_size(n: int) -> Column:
        return F.flatten(F.transform(runs, lambda w: pieces(w, n)))

    runs = F.regexp_extract_all(c, F.lit(run), F.lit(0))
    per_size = [of_size(n) for n in range(lo, hi + 1)]
    return F.array_distinct(F.concat(*per_size))


def try_json(c: Column, schema: str) -> Column:
    """Parse JSON text; malformed text gives null."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})
