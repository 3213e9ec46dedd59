"""Integrity checks over parsed standards and contracts: many assertions, one aggregate a table, one row a check."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift import fixed_values as V
from fieldsift.operators import standards
from fieldsift.scale import materialise


@dataclass(frozen=True)
class Check:
    """`measure` is an aggregate over `table`; the check passes where `holds` is true of it, else its status is `level`."""

    name: str
    table: str
    measure: Column
    holds: Callable[[Column], Column]
    level: str = "fail"


def run_checks(tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """`no, check, status, detail` in the order of `checks`: status is pass, warn or fail, detail the measure as text.

    All measures of a table come from one pass over it. A measure that is null (nothing to look at) does not pass.
    """
    parts = []
    for table in dict.fromkeys(c.table for c in checks):
        own = [(n, c) for n, c in enumerate(checks, 1) if c.table == table]
        one = tables[table].agg(*[c.measure.cast("string").alias(f"d{n}") for n, c in own], *[c.holds(c.measure).alias(f"h{n}") for n, c in own])
        row = lambda n, c: F.struct(
            F.lit(n).alias("no"), F.lit(c.name).alias("check"),
            F.when(F.col(f"h{n}"), F.lit("pass")).otherwise(F.lit(c.level)).alias("status"), F.col(f"d{n}").alias("detail"),
        )
        parts.append(one.select(F.inline(F.array(*[row(n, c) for n, c in own]))))
    return reduce(DataFrame.unionByName, parts)


def _at_least(least: int) -> Callable[[Column], Column]:
    return lambda n: n >= least


def _none(n: Column) -> Column:
    return n == 0


def _repeats(rows: DataFrame, key: str) -> DataFrame:
    """Keys that several rows have."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _unresolved(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def _count(condition: Column | None = None) -> Column:
    return F.count(F.lit(1)) if condition is None else F.count_if(condition)


def check_standards(
    docs: DataFrame, items: DataFrame, catalog: DataFrame, expected: DataFrame, *, docs_least: int, depth_least: int, billing_least: int, penalty_least: int, billing_docs: Sequence[str] = ()
) -> DataFrame:
    """Checks of the standards; `items` as `standards.describe_items` gives them.

    `catalog`: docNo, id, name. `expected`: docNo, required, stages, shape, word (null: any) of documents whose
    numbering or content is fixed. `billing_docs` (empty: any) are the documents billing items may lie in.
    """
    docs, items = materialise(docs), materialise(items)  # parsed once, looked at several times
    shapes = standards.document_shapes(docs, items)
    meets = F.lit(True)
    for c in ("required", "stages", "shape"):
        meets &= F.col(f"e.{c}").isNull() | F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}"))
    meets &= F.col("e.word").isNull() | F.coalesce(F.contains("s.title", "e.word"), F.lit(False))
    off = expected.alias("e").join(shapes.alias("s"), "docNo", "left").filter(F.col("s.title").isNull() | ~meets).select("docNo")
    tables = {
        "docs": docs, "items": items, "aligned": standards.catalogue_alignment(catalog, docs), "empty": _unresolved(docs, items, "docNo"),
        "doc repeats": _repeats(docs, "docNo"), "catalogue repeats": _repeats(catalog, "docNo"), "item repeats": _repeats(items, "itemKey"), "off": off,
    }
    due = lambda flag: _count((F.col("status") == "R") & F.col(flag))
    at = F.lit(True) if not billing_docs else F.col("docNo").isin(*billing_docs)
    return run_checks(tables, [
        Check("enough documents", "docs", _count(), _at_least(docs_least)),
        Check("document numbers are unique", "doc repeats", _count(), _none),
        Check("catalogue numbers are unique", "catalogue repeats", _count(), _none),
        Check("nothing is only listed", "aligned", _count(F.col("status") == "listed only"), _none),
        Check("nothing is only parsed", "aligned", _count(F.col("status") == "parsed only"), _none),
        Check("document ids agree", "aligned", _count(F.col("status") == "id differs"), _none),
        Check("every document has items", "empty", _count(), _none),
        Check("item keys are well formed", "items", _count(~F.coalesce(F.col("itemKey").rlike(r"^[^-]+-[0-9]+(\.[0-9]+)*$"), F.lit(False))), _none),
        Check("item keys are unique", "item repeats", _count(), _none),
        Check("items are nested deep enough", "items", F.max("depth"), _at_least(depth_least)),
        Check("enough billing items", "items", due("billing"), _at_least(billing_least)),
        Check("billing items lie where they may", "items", _count((F.col("status") == "R") & F.col("billing") & ~at), _none),
        Check("enough penalty items", "items", due("penalty"), _at_least(penalty_least)),
        Check("fixed documents are as expected", "off", _count(), _none),
    ])


def check_contracts(
    docs: DataFrame, clauses: DataFrame, items: DataFrame, answers: DataFrame, interfaces: DataFrame, *, docs_least: int, clauses_least: int, kinds_least: Mapping[str, int]
) -> DataFrame:
    """Checks of the contracts; `clauses` as `standards.describe_clauses` gives them, `items` as `describe_items`.

    `docs`: project, trade. `answers`: itemKey, clauseKey. `interfaces`: name, clauseKey. `kinds_least`: fewest clauses
    of a kind. Contract-dependent items without an answer are a warning, as more contracts may still come.
    """
    clauses, items = materialise(clauses), materialise(items)
    mapped = standards.flagged(items, "contract").join(answers.select("itemKey").distinct(), "itemKey", "left_anti")
    tables = {
        "docs": docs, "clauses": clauses, "empty": docs.join(clauses.select("project", "trade").distinct(), ["project", "trade"], "left_anti"),
        "answers": _unresolved(answers, clauses, "clauseKey"), "answered items": _unresolved(answers, items, "itemKey"), "interfaces": _unresolved(interfaces, clauses, "clauseKey"), "open": mapped,
    }
    key = F.coalesce(F.size(F.split("clauseKey", "/")) == 3, F.lit(False))
    return run_checks(tables, [
        Check("enough contracts", "docs", _count(), _at_least(docs_least)),
        Check("every contract has clauses", "empty", _count(), _none),
        Check("enough clauses", "clauses", _count(), _at_least(clauses_least)),
        Check("clause keys are project/trade/number", "clauses", _count(~key), _none),
        *[Check(f"enough clauses of {k}", "clauses", _count(F.col("kind") == k), _at_least(n)) for k, n in kinds_least.items()],
        Check("kinds are known", "clauses", _count(~F.coalesce(F.col("kind").isin(*[k for _, k in V.CLAUSE_KINDS], V.CLAUSE_KIND_DEFAULT), F.lit(False))), _none),
        Check("answers name clauses", "answers", _count(), _none),
        Check("answers name items", "answered items", _count(), _none),
        Check("interfaces name clauses", "interfaces", _count(), _none),
        Check("items that lean on a contract are answered", "open", _count(), _none, "warn"),
    ])
