"""The registered queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsift.llm import byte_bpe, collocations, conversations, lm, mixing, nearest, packing, pii, quality_classifier, quality_rules, secrets, simhash, spans, toxicity
from fieldsift.llm.common import remainder, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base, names = F.col("base"), secrets.NAMES
    return found.select(
        "doc_id",
        *[spans.count(base, i).alias(f"n_{n}") for i, n in enumerate(names[:3])],
        F.sha2(spans.described(base, names), 256).alias("base_sha256"),
        spans.described(spans.ordered(base, F.col("extra")), names).alias("spans"),
        F.size("extra").cast("long").alias("n_entropy"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_terms(table(spark, sf_dir, "documents"))
    base, names = F.col("base"), pii.NAMES
    return found.select(
        "doc_id",
        *[spans.count(base, i).alias(f"n_{n}") for i, n in enumerate(names[:4])],
        F.sha2(spans.described(base, names), 256).alias("base_sha256"),
        spans.described(spans.ordered(base, F.col("extra")), names).alias("spans"),
        F.size("extra").cast("long").alias("n_term"),
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    modulus, out = quality_classifier.HELD_OUT
    vectors = quality_classifier.word_vectors(docs)
    net = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), vectors, remainder(modulus) != out)
    return quality_classifier.score(docs, vectors, net)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, *lm.fit(lm.learnable(docs)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    modulus, out = toxicity.HELD_OUT
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(modulus) != out)
    return toxicity.score(docs, model)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_reports(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_quality_rules": op2_quality_rules,
    "op3_mixing": op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_top_k": op5_top_k,
    "op6_packing": op6_packing,
    "op7_pii": op7_pii,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_toxicity": op10_toxicity,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_collocations": op13_collocations,
}

def _letters(words: str) -> str:
    """The pattern with letters of either case spelled out, as RE2 would fold beyond A-Z."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_ASSIGN = r"""((?:%s))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""" % _letters("password|passwd|secret|token|api_?key")


def _found_sql(name: str, pattern: str) -> str:
    """Matches of a pattern with their positions: what lies between and the matches add up."""
    q = pattern.replace("'", "''")
    return f"""
        {name}_m AS (SELECT doc_id, regexp_extract_all(t, '{q}') AS m, string_split_regex(t, '{q}') AS g FROM d),
        {name} AS (SELECT doc_id, v, CAST(s AS BIGINT) AS s, CAST(s + length(v) AS BIGINT) AS e FROM (
            SELECT doc_id, unnest(m) AS v, unnest(list_transform(range(1, len(m) + 1), lambda i:
                list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS s
            FROM {name}_m WHERE len(m) > 0))"""


def _entropy_sql(name: str, letters: str, threshold: float) -> str:
    # RE2 needs no possessive quantifiers, and has none
    allowed = " OR ".join(f"regexp_matches(v, '{p.replace('*+', '*').replace('++', '+').replace('}+', '}')}')" for p in secrets.ALLOWED)
    w = secrets.WINDOW
    return f"""{_found_sql(name + "_run", f"[{letters}]{{{w},}}")},
        {name}_w AS (SELECT doc_id, s, v, unnest(range(0, length(v) - {w - 1})) AS a FROM {name}_run WHERE NOT ({allowed})),
        {name}_c AS (SELECT doc_id, s, a, string_split(substr(v, CAST(a + 1 AS BIGINT), {w}), '') AS c, substr(v, CAST(a + 1 AS BIGINT), {w}) AS x FROM {name}_w),
        {name}_h AS (SELECT doc_id, s, a FROM {name}_c WHERE regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]') AND
            list_sum(list_transform(list_distinct(c), lambda y: -(len(list_filter(c, lambda z: z = y)) / {w}.0) * log2(len(list_filter(c, lambda z: z = y)) / {w}.0))) >= {threshold} - 1e-9),
        {name}_i AS (SELECT *, CASE WHEN a <= lag(a) OVER (PARTITION BY doc_id, s ORDER BY a) + {w} THEN 0 ELSE 1 END AS fresh FROM {name}_h),
        {name}_j AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, s ORDER BY a) AS island FROM {name}_i),
        {name} AS (SELECT doc_id, s + min(a) AS s, s + max(a) + {w} AS e FROM {name}_j GROUP BY doc_id, s, island)"""


def _without_sql(name: str, of: str, cuts: str) -> str:
    """What the cuts leave of spans: from a start that no cut holds to the next cut or the end."""
    return f"""{name}_c AS ({cuts}),
        {name}_p AS (SELECT doc_id, s AS a, e AS z, s AS p FROM {of} UNION SELECT w.doc_id, w.s, w.e, c.e FROM {of} w JOIN {name}_c c ON c.doc_id = w.doc_id AND c.e > w.s AND c.e < w.e),
        {name}_q AS (SELECT doc_id, a, p, least(z, coalesce((SELECT min(c.s) FROM {name}_c c WHERE c.doc_id = x.doc_id AND c.s >= x.p), z)) AS q FROM {name}_p x
            WHERE NOT EXISTS (SELECT 1 FROM {name}_c c WHERE c.doc_id = x.doc_id AND c.s <= x.p AND c.e > x.p)),
        {name} AS (SELECT doc_id, p AS s, q AS e FROM {name}_q WHERE q - p >= {secrets.WINDOW})"""


_WIDE, _NARROW = list(secrets.CLASSES.items())[1], list(secrets.CLASSES.items())[0]
_SECRETS_SQL = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        {_found_sql("assign", _ASSIGN)},
        {_found_sql("access", secrets.ACCESS)},
        {_found_sql("hex", f"[0-9a-f]{{{secrets.HEX_LEAST},}}")},
        base AS (
            SELECT doc_id, s, 0 AS k, e FROM assign WHERE length(regexp_extract(v, '{_ASSIGN.replace("'", "''")}', 2)) >= {secrets.ASSIGN_LEAST}
            UNION ALL SELECT doc_id, s, 1, e FROM access WHERE length(v) >= {secrets.ACCESS_LEAST}
            UNION ALL SELECT doc_id, s, 2, e FROM hex WHERE length(v) >= {secrets.HEX_LEAST}),
        {_entropy_sql("narrow", *_NARROW)},
        {_entropy_sql("wide", *_WIDE)},
        {_found_sql("piece", secrets.PIECE)},
        {_without_sql("hexes", "narrow", "SELECT doc_id, s, e FROM piece")},
        {_without_sql("others", "wide", "SELECT doc_id, s, e FROM piece UNION ALL SELECT doc_id, s, e FROM hexes")},
        extra AS (
            SELECT x.doc_id, x.s, 3 AS k, x.e FROM (SELECT * FROM hexes UNION ALL SELECT * FROM others) x
            WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s <= x.s AND b.e >= x.e)),
        named AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || s || ':' || e AS name FROM (SELECT * FROM base UNION ALL SELECT * FROM extra)),
        per AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
            count(*) FILTER (k = 3) AS n_entropy, string_agg(name, ',' ORDER BY s, k) FILTER (k < 3) AS b, string_agg(name, ',' ORDER BY s, k) AS spans
            FROM named GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
    FROM d LEFT JOIN per USING (doc_id)
"""



def _repair_sql() -> str:
    """Layer by layer over the rows: the least (cost, audit, text) of each state s, u, a, or none yet."""

    def on(w: str, cost: str, symbol: str, turn: str | None = None) -> str:
        text = f"{w}.t || chr(10) || {turn}" if turn else f"{w}.t"
        return f"CASE WHEN {w} IS NOT NULL THEN {{'c': {w}.c + {cost}, 'a': {w}.a || '{symbol}', 't': {text}}} END"

    def inserted(w: str, role: str) -> str:
        return on(w, "3", "I", f"'{role}:'")

    def taken(w: str, role: str, symbol: str) -> str:
        if symbol == "K":
            return f"CASE WHEN NOT doomed AND x = '{role[0]}' THEN {on(w, 'price', 'K', 'said')} END"
        return f"CASE WHEN NOT doomed THEN {on(w, '3 + price', 'R', f"'{role}:' || text")} END"

    to_user = ", ".join(taken(w, "user", e) for w in ("w0", "w1", "w3") for e in "KR")
    to_assistant = ", ".join(taken("w2", "assistant", e) for e in "KR")
    deleted = [on(f"w{i}", "4", "D") for i in range(4)]
    return f"""
    WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: xor(a >> 1, (a & 1) * 3988292384))) AS tab),
        d AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        h AS (SELECT d.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
            lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS m FROM d, crc),
        e AS (SELECT conv_id, turn, r, t, CASE WHEN m = 4 THEN 'user' ELSE r END AS role,
            CASE WHEN m = 1 THEN '' WHEN m = 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS text,
            unnest(CASE WHEN m = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE m <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, substr(t, 1, 64), copy) AS i FROM e),
        f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
            coalesce(left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM o),
        g AS (SELECT conv_id, i, fault IN ('blank', 'duplicate') AS doomed, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS price, left(role, 1) AS x, role || ':' || text AS said, text FROM f),
        w AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS w0, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS w1,
                {{'c': CAST(3 AS BIGINT), 'a': 'I', 't': chr(10) || 'user:'}} AS w2, {{'c': CAST(6 AS BIGINT), 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS w3
            FROM (SELECT DISTINCT conv_id FROM f)
            UNION ALL
            SELECT conv_id, i, w0, w1, w2, list_min([w3, {inserted("w2", "assistant")}]) AS w3 FROM (
                SELECT conv_id, i, w0, w1, list_min([w2, {inserted("w0", "user")}, {inserted("w1", "user")}, {inserted("w3", "user")}]) AS w2, w3 FROM (
                    SELECT w.conv_id, g.i, {deleted[0]} AS w0, list_min([{deleted[1]}, {taken("w0", "system", "K")}]) AS w1,
                        list_min([{deleted[2]}, {to_user}]) AS w2, list_min([{deleted[3]}, {to_assistant}]) AS w3
                    FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1))),
        z AS (SELECT conv_id, list_min([w0, w3]) AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS n FROM w) WHERE n = 1),
        c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
            count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id)
    SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
    """


ORACLE_SQL: dict[str, str] = {
    "op12_conversation_repair": _repair_sql(),
    "op13_collocations": """
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
            w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM p),
            o AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
            g AS (SELECT lang, k, ws[i:i + k - 1] AS g FROM o, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(ws)),
            f AS (SELECT lang, k, g, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
            c AS (SELECT lang, k, g, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND f >= 10),
            s AS (SELECT c.*, x.f AS l, y.f AS r, 1000000 * a * a // (x.f * y.f) AS score FROM c
                JOIN f x ON x.lang = c.lang AND x.g = c.g[1:cut] JOIN f y ON y.lang = c.lang AND y.g = c.g[cut + 1:c.k]),
            b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS m FROM s) WHERE m = 1),
            t AS (SELECT lang, h, max(a) AS a FROM (SELECT lang, a, unnest([g[1:2], g[2:3]]) AS h FROM b WHERE k = 3) GROUP BY ALL),
            z AS (SELECT b.* FROM b LEFT JOIN t ON t.lang = b.lang AND t.h = b.g WHERE b.k = 3 OR t.a IS NULL OR 100 * t.a < 50 * b.a),
            q AS (SELECT *, list_aggregate(g, 'string_agg', ' ') AS phrase FROM z),
            n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
            u AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q)
        SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM u JOIN n USING (lang) WHERE rank <= 2000
    """,
    "op1_secrets": _SECRETS_SQL,
    "op5_top_k": """
        WITH x AS (
            SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(1024 * CAST(v AS DOUBLE)) AS DOUBLE)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
            FROM x a JOIN x b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
            WHERE a.vec_id % 100 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
    """,
}
