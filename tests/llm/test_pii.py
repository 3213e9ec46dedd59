import hashlib
import random
import re

from tests.llm.conftest import SF_LARGER, rows_of

from fieldsift.llm import pii, queries
from fieldsift.llm.common import table

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    total = 0
    for i, d in enumerate(reversed(number)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_base(text):
    out = []
    for kind, (pattern, ok) in enumerate(
        [
            (EMAIL, lambda m: True),
            (IP, lambda m: all(int(p) <= 255 for p in m[0].split("."))),
            (CARD, lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
            (PHONE, lambda m: 10 <= len(digits(m[0])) <= 15),
        ]
    ):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text or "") if ok(m)]
    return sorted(out)


def named(found):
    return ",".join(f"{pii.NAMES[k]}:{a}:{b}" for a, k, b in found)


def test_query_base_equals_brute_force(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op7_pii"](spark, SF_LARGER).collect()}
    hits = 0
    for d in table(spark, SF_LARGER, "documents").collect():
        base, r = plain_base(d.text), got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(named(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        kept = [s for s in r.spans.split(",") if s and not s.startswith("term:")]
        assert ",".join(kept) == named(base)
        hits += len(base)
    assert hits


def test_awkward_texts(docs):
    texts = [
        "a@b.c_d@e.f x@y x@y.z. é.é@ü.de q@-.- %@a.b-c..d", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.0255.00 1.2.3", "4111 1111-1111 1111, 4111 1111 1111 1112 4111-1111-1111-1111-1",
        "+1 (988) 555-2485 +49-30-1234567 +1 2 +123456789012345678 +1+2", "1" * 5000 + ".1", "a" * 60_000 + " @ " + "b.c@d.e", "x@" + "a." * 20_000 + "com",
        "0 " * 8000 + "+" + "1 " * 8000, "\U0001f600\U0001f600 me@host.org 10.0.0.1", None, "", "5500005555555559+5500005555555559", "+14155550101@mail.example.com 12-34 5",
        "0" * 14 + " " + "0" * 20, "a@b.c@d.e@f.g", "192.168.1.1.@x.y", "+1\t4155550101", "1.1.1.1@1.1.1.1",
    ]
    got = {r.doc_id: r for r in pii.with_terms(docs(texts)).collect()}
    for i, text in enumerate(texts):
        assert [(s.start, s.kind, s.end) for s in got[i].base] == plain_base(text), (text or "")[:60]


def planted(copies):
    rng = random.Random(4)
    words = ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [f"{some(30)} person{i}@corp.example {some(30)}" for i in range(60)] + [some(60) for _ in range(60)]
    if copies:
        one = f"{some(20)} Zanzibarov jo@corp.example {some(20)}"
        return texts + [one] * 8
    return texts + [f"{some(20)} Zanzibarov {some(1)} jo@corp.example {some(20)} again Zanzibarov {some(5)}" for _ in range(8)]


def test_a_term_that_reveals_an_entity_is_found(spark, docs):
    texts = planted(False)
    rows = {r.doc_id: r for r in pii.with_terms(docs(texts)).collect()}
    for i, text in enumerate(texts):
        found = [text[s.start : s.end] for s in rows[i].extra]
        assert found == (["Zanzibarov"] * 2 if i >= 120 else []), (i, found)
    clean = {r.doc_id: r for r in pii.sanitised(docs(texts)).collect()}
    assert all("@" not in r.text and len(r.text) == r.n_chars for r in clean.values())
    assert "<term>" in clean[121].text and "<email>" in clean[121].text
    assert all(clean[i].text == texts[i] for i in range(60, 120))


def test_copies_of_one_context_reveal_nothing(docs):
    assert not any(r.extra for r in pii.with_terms(docs(planted(True))).collect())


def test_odd_rows(spark, odd, empty):
    assert pii.with_terms(odd).count() == odd.count() and pii.with_terms(empty).count() == 0
    back = pii.sanitised(odd)
    assert back.columns == odd.columns and back.schema["n_chars"].dataType == odd.schema["n_chars"].dataType
    key = lambda rows: sorted(map(repr, rows))
    assert key(back.collect()) == key(odd.collect())
    assert pii.sanitised(empty).count() == 0
    rows = rows_of(["call +1 415 555 0101 or 4111111111111111 or me@x.org from 10.1.2.3!"])
    (one,) = pii.sanitised(spark.createDataFrame(rows, odd.schema)).collect()
    assert one.text == "call <phone> or <card> or <email> from <ip>!"


def test_every_occurrence_of_a_disclosing_term_goes(docs):
    texts = [*planted(False), "Later zanzibarov came without an address.", "mail zanzibarov@corp.example"]
    rows = {r.doc_id: r for r in pii.with_terms(docs(texts)).collect()}
    for i in range(120, 128):
        assert [texts[i][s.start : s.end] for s in rows[i].extra] == ["Zanzibarov"] * 2
    assert [(s.start, s.end) for s in rows[128].extra] == [(6, 16)] and not rows[129].extra
    clean = {r.doc_id: r.text for r in pii.sanitised(docs(texts)).collect()}
    assert not any("zanzibarov" in t.lower() for t in clean.values())
