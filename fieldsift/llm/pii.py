"""Personal data: fixed patterns, and terms that disclose them as the corpus shows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift.llm import spans as S
from fieldsift.llm.common import keep, texts

NAMES = ["email", "ip", "card", "phone", "term"]
_LOCAL = r"[A-Za-z0-9._%+-]"
# The patterns of the four kinds. A match begins where its run of characters does or where the
# match before it ended, and repetition never gives back, so texts of any length take time in proportion.
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

#: Terms are looked at so many before and after a protected span, within so many characters.
TERMS_NEAR = 8
CHARACTERS_NEAR = 240
TERM = r"[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}]|['’-](?=[\p{L}\p{N}])){2,}+"
#: Contexts of their own, at least, in which a term must stand by an entity; copies of one context count as one.
CONTEXTS = 3.0
#: Share of a term's documents, at least, in which it stands by the entity.
DISCLOSURE = 0.5
#: Bits of the fixed-size filter that keeps words which are no candidate from being shuffled.
FILTER_BITS = 1 << 16


def base_spans(text: Column) -> Column:
    """Matches of the fixed patterns that pass the checks of their kind."""
    digits = lambda s: F.regexp_replace(s["value"], "[^0-9]", "")
    email = S.matches(text, EMAIL, 0, F.contains(text, F.lit("@")))
    ip = S.matches(text, IP, 1, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"))
    ip = F.filter(ip, lambda s: s["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    card = S.matches(text, CARD, 2, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"))
    card = F.filter(card, lambda s: F.length(digits(s)).between(14, 19) & F.call_function("luhn_check", digits(s)))
    phone = S.matches(text, PHONE, 3, text.rlike(r"\+[0-9]"))
    phone = F.filter(phone, lambda s: F.length(digits(s)).between(10, 15))
    return S.ordered(email, ip, card, phone)


def _entity(s: Column) -> Column:
    """What the span stands for, written one way: the kind and the address or number."""
    kept = F.when(s["kind"] <= 1, F.lower(s["value"])).otherwise(F.regexp_replace(s["value"], "[^0-9]", ""))
    return F.concat(s["kind"].cast("string"), F.lit(":"), kept)


def _general(s: Column) -> Column:
    """The entity's generalisation: a mail domain, a network, an issuer, a dialling prefix."""
    value, digits = F.lower(s["value"]), F.regexp_replace(s["value"], "[^0-9]", "")
    kind = s["kind"]
    out = (
        F.when(kind == 0, F.substring_index(value, "@", -1))
        .when(kind == 1, F.substring_index(value, ".", 2))
        .when(kind == 2, digits.substr(1, 6))
        .otherwise(digits.substr(1, 4))
    )
    return F.concat(kind.cast("string"), F.lit(":"), out)


def _terms(text: Column, start: Column, length: Column) -> Column:
    found = S.matches(text.substr(start + 1, length), TERM, 4)
    return F.transform(
        found,
        lambda t: F.struct(
            (t["start"] + start).alias("start"),
            t["kind"].alias("kind"),
            (t["end"] + start).alias("end"),
            F.lower(t["value"]).alias("value"),
        ),
    )


def _near(text: Column, s: Column, base: Column) -> Column:
    """Terms around one span, each with its context: the nearest other terms on both sides."""
    low = F.greatest(s["start"] - CHARACTERS_NEAR, F.lit(0))
    free = lambda found: F.filter(found, lambda t: ~S.overlaps(t, base))
    # a term that the edge of the characters may have cut is left out
    left = F.filter(free(_terms(text, low, s["start"] - low)), lambda t: (t["start"] > low) | (low == 0))
    high = s["end"] + CHARACTERS_NEAR
    right = F.filter(free(_terms(text, s["end"], F.lit(CHARACTERS_NEAR))), lambda t: t["end"] < high)
    left, right = F.slice(F.reverse(left), 1, TERMS_NEAR), F.slice(right, 1, TERMS_NEAR)

    def with_context(t: Column) -> Column:
        other = lambda side: F.get(F.filter(side, lambda o: o["value"] != t["value"]), F.lit(0))["value"]
        context = F.xxhash64(other(left), F.lit("|"), other(right))
        return F.struct(
            _entity(s).alias("entity"),
            _general(s).alias("general"),
            t["value"].alias("term"),
            context.alias("context"),
            t["start"].alias("start"),
            t["end"].alias("end"),
        )

    return F.transform(F.concat(left, right), with_context)


def found_rows(docs: DataFrame, *more: str) -> DataFrame:
    """`row, doc_id, text, base, near`, and further columns: base spans and the terms around them, written once."""
    rows = texts(docs, *[c for c in more if c != "text"]).withColumn("base", base_spans(F.col("text")))
    base, text = F.col("base"), F.col("text")
    near = F.flatten(F.transform("base", lambda s: _near(text, s, base)))
    rows = rows.withColumn("near", F.when(F.size("base") > 0, near)).withColumn("row", F.monotonically_increasing_id())
    return keep(rows, "personal")


def disclosing(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """`row, extra`: the term occurrences that reveal a protected entity, wherever they stand in any text.

    A term t reveals the entity e when its pointwise mutual information with e exceeds the information of e's
    generalisation g, that is, log2 of p(e, t) / p(e) p(t) is over -log2 p(g): it then tells more about e than
    one would publish. Probabilities are shares of all documents. So that chance and copies do not count, t must
    stand by e in CONTEXTS effective contexts (the inverse of the sum of squared shares) and in DISCLOSURE of the
    documents that have it. The terms around the spans decide; each occurrence of a term that does is listed, also
    far from the span and in documents without it.
    """
    near = rows.select("row", F.explode("near").alias("n")).select("row", "n.*")
    per = near.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
    pairs = per.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    pairs = keep(pairs.filter(F.col("both") * F.col("both") >= CONTEXTS * F.col("squares")), "pairs")
    held = rows.select(F.explode("base").alias("s"), "row")
    entities = held.select("row", _entity(F.col("s")).alias("entity"), _general(F.col("s")).alias("general")).distinct()
    of_entity = entities.groupBy("entity", "general").agg(F.count(F.lit(1)).alias("n_entity"))
    of_general = entities.select("row", "general").distinct().groupBy("general").agg(F.count(F.lit(1)).alias("n_general"))
    known = pairs.join(of_entity, "entity").join(of_general, "general").join(document_counts(docs, pairs), "term")
    both = F.least("both", "n_entity", "n_term")
    tells = (both * F.col("n_general") > F.col("n_entity") * F.col("n_term")) & (both >= DISCLOSURE * F.col("n_term"))
    strong = known.filter(tells).select("entity", "term")
    strong = keep(strong, "strong")
    beside = near.join(strong, ["entity", "term"]).select("row", "start", "end").distinct()
    one = F.struct("start", F.lit(4).alias("kind"), "end", F.lit("").alias("value"))
    beside = beside.groupBy("row").agg(F.collect_list(one).alias("beside"))
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))
    said = _among(rows.select("row", F.explode(words).alias("term")), strong.select("term").distinct())
    held = said.groupBy("row").agg(F.collect_list("term").alias("terms"))
    # as many positions as the text has of its own disclosing terms
    everywhere = S.matches(F.col("text"), TERM, 4, wanted=lambda v: F.array_contains("terms", F.lower(v)))
    everywhere = F.transform(everywhere, lambda t: F.struct(t["start"], t["kind"], t["end"], F.lit("").alias("value")))
    everywhere = F.filter(everywhere, lambda t: ~S.overlaps(t, F.col("base")))
    at = rows.select("row", "text", "base").join(held, "row").select("row", everywhere.alias("everywhere"))
    both = F.array_union(F.coalesce("everywhere", S.empty()), F.coalesce("beside", S.empty()))
    return at.join(beside, "row", "full").select("row", F.array_sort(both).alias("extra"))


def document_counts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """`term, n_term`: in how many of all documents each candidate term stands."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0)))
    wanted = pairs.select("term").distinct()
    said = _among(docs.select(F.explode(words).alias("term")), wanted, join=False)
    return said.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).join(wanted, "term")


def _among(said: DataFrame, wanted: DataFrame, join: bool = True) -> DataFrame:
    """The rows of `said` whose `term` is among `wanted`; without `join`, a few others too.

    Words reach the shuffle only if a filter of fixed size has their bit; it lets every wanted one through.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("int")
    marks = wanted.select(bit("term").alias("b")).groupBy((F.col("b") / 64).cast("int").alias("slot"))
    marks = marks.agg(F.bit_or(F.expr("shiftleft(1L, b % 64)")).alias("bits")).collect()  # FILTER_BITS / 64 rows at most
    slots = {r.slot: r.bits for r in marks}
    table = F.lit([slots.get(i, 0) for i in range(FILTER_BITS // 64)]).cast("array<bigint>")
    said = said.withColumn("b", bit("term"))
    said = said.filter(F.expr("shiftleft(1L, b % 64)").bitwiseAND(F.get(table, (F.col("b") / 64).cast("int"))) != 0).drop("b")
    return said.join(wanted, "term") if join else said


def with_terms(docs: DataFrame, *more: str) -> DataFrame:
    """`doc_id, base, extra` and further columns, for every row: spans of the fixed kinds, and disclosing terms.

    A null or empty text has no span. Rows without id, and repeated rows, come back alike; copies of a context
    do not make a term disclosing. An empty table gives no row.
    """
    rows = found_rows(docs, *more)
    per = keep(disclosing(docs, rows), "terms")
    joined = rows.drop("near").join(per, "row", "left")
    extra = F.coalesce("extra", S.empty())
    return joined.select("doc_id", *more, "base", extra.alias("extra"))


def sanitised(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with protected spans generalised to their kind, and disclosing terms too or removed.

    A disclosing term with a capital or a digit becomes `<term>`, any other goes. All columns come back;
    `n_chars` follows the new text where both were given, and a null text stays null.
    """
    columns = docs.columns
    others = [c for c in columns if c not in ("doc_id", "text")]
    packed = docs.withColumn("__rest", F.struct(F.col("doc_id").alias("id"), F.col("text").isNull().alias("none"), *others))
    rows = with_terms(packed, "text", "__rest")
    text = F.col("text")
    tags = F.array(*[F.lit(f"<{n}>") for n in NAMES])

    def tag(s: Column) -> Column:
        word = text.substr(s["start"] + 1, s["end"] - s["start"])
        plain = (s["kind"] == 4) & ~word.rlike(r"[\p{Lu}\p{N}]")
        return F.when(plain, F.lit("")).otherwise(F.get(tags, s["kind"]))

    new = S.replaced(text, S.ordered(F.col("base"), F.col("extra")), tag)
    rows = rows.withColumn("__new", F.when(~F.col("__rest.none"), new))
    given = {"doc_id": F.col("__rest.id"), "text": F.col("__new")}
    if "n_chars" in columns:
        length = F.coalesce(F.length("__new").cast("long"), F.col("__rest.n_chars").cast("long"))
        given["n_chars"] = F.when(F.col("__rest.n_chars").isNotNull(), length).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[given.get(c, F.col("__rest")[c]).alias(c) for c in columns])
