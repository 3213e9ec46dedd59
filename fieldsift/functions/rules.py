"""Ordered title rules: first match wins, junk is left out, the rest falls back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsift import fixed_values as V
from fieldsift.functions.text import blank, first_match, found, strip


@dataclass(frozen=True)
class RuleSet:
    rules: Sequence[tuple[str, str]]
    fallback: str = V.TRADE_FALLBACK
    junk: Sequence[str] = ()
    junk_patterns: Sequence[str] = ()
    min_title: int = 0
    drop_fallback: bool = False
    min_class_size: int = 0
    small_class: str = "merge"
    version: str = ""
    drop_future: bool = True
    bad_dates: Sequence[str] = ()
    bad_authors: Sequence[str] = ()
    bad_status: Sequence[str] = ()
    bad_sites: Sequence[str] = field(default=())

    @classmethod
    def trade(cls) -> RuleSet:
        """The shipped class rules."""
        return cls(
            rules=V.TRADE_RULES,
            junk=V.TRADE_JUNK,
            junk_patterns=V.TRADE_JUNK_PATTERNS,
            min_title=V.TRADE_MIN_TITLE,
            drop_fallback=True,
            min_class_size=V.TRADE_MIN_CLASS,
            small_class="drop",
            bad_sites=V.TRADE_EXCLUDED_SITES,
            version="18",
        )

    @classmethod
    def from_config(cls, cfg: Mapping) -> RuleSet:
        """Build from a parsed rule file (keys as in the YAML format)."""
        out = cfg.get("exclude") or {}
        texts = lambda values: [str(v) for v in values or []]
        return cls(
            rules=[(r["pattern"], r["label"]) for r in cfg.get("rules") or []],
            fallback=cfg.get("fallback", V.TRADE_FALLBACK),
            junk=texts(cfg.get("junk")),
            junk_patterns=texts(cfg.get("junk_patterns")),
            min_title=int(cfg.get("min_title_length", 0)),
            drop_fallback=bool(cfg.get("drop_fallback", False)),
            min_class_size=int(cfg.get("min_class_size", 0)),
            small_class=cfg.get("small_class", "merge"),
            version=str(cfg.get("version") or ""),
            drop_future=bool(out.get("future_dates", True)),
            bad_dates=texts(out.get("dates")),
            bad_authors=texts(out.get("createdBy")),
            bad_status=texts(out.get("status")),
            bad_sites=texts(out.get("sites")),
        )

    @classmethod
    def from_yaml(cls, path: str) -> RuleSet:
        import yaml

        with open(path, encoding="utf-8") as fh:
            return cls.from_config(yaml.safe_load(fh))

    def classify(self, title: Column) -> Column:
        """Class of a stripped title, or null where the title carries no meaning."""
        unusable = (title == "") | (F.length(title) < self.min_title)
        if self.junk:
            unusable = unusable | title.isin(*self.junk)
        for pattern in self.junk_patterns:
            unusable = unusable | found(title, pattern)
        return F.when(~unusable, first_match(title, self.rules, self.fallback))

    def with_class(self, df: DataFrame, title: str = "title", out: str = "cls") -> DataFrame:
        """Add the class. The stripped title is a lambda variable, so no optimiser rule can repeat it in each branch."""
        return df.withColumn(out, F.transform(F.array(strip(blank(title))), lambda t: self.classify(t))[0])

    def table(self, spark: SparkSession) -> DataFrame:
        """The rules as rows (pos, pattern, label)."""
        rows = [(i, p, label) for i, (p, label) in enumerate(self.rules)]
        return spark.createDataFrame(rows, "pos int, pattern string, label string")

    def labels(self) -> list[str]:
        return list(dict.fromkeys(label for _, label in self.rules))
