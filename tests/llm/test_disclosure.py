"""Personal data and disclosing terms against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
import regex

from tests.llm.conftest import passage
from ticketmill.llm import disclosure as d

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    total = 0
    for i, x in enumerate(reversed(digits)):
        v = int(x) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == 1:
        return all(int(p) <= 255 for p in value.split("."))
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 if kind == 3 else True


def base_spans(text):
    return [(k, m.start(), m.end()) for k in range(4) for m in re.finditer(PLAIN[k], text or "") if valid(k, m.group())]


def listed(spans):
    return ",".join(f"{d.KINDS[k]}:{s}:{e}" for k, s, e in spans)


def base_row(doc_id, text):
    spans = base_spans(text)
    return (doc_id, *(sum(1 for s in spans if s[0] == k) for k in range(4)), hashlib.sha256(listed(spans).encode()).hexdigest())


def terms_in(text):
    return [(m.group().lower(), m.start(), m.end()) for m in regex.finditer(d.TERM, text or "")]


def entity(kind, value):
    return f"{d.KINDS[kind]}:" + (value.lower() if kind == 0 else value if kind == 1 else re.sub("[^0-9]", "", value))


def plain_terms(rows):
    """{term: instead} by counting over all documents."""
    with_term, together, with_entity = Counter(), defaultdict(set), defaultdict(set)
    for doc_id, text in rows:
        with_term.update({t for t, _, _ in terms_in(text)})
        for kind in range(4):
            found = list(re.finditer(PLAIN[kind], text or ""))
            if kind == 2:  # shorter runs of digits do not part the text
                found = [m for m in found if len(re.sub("[^0-9]", "", m.group())) >= 16]
            for i, m in enumerate(found):
                if not valid(kind, m.group()):
                    continue
                low = found[i - 1].end() if i else 0
                high = found[i + 1].start() if i + 1 < len(found) else len(text)
                e = entity(kind, m.group())
                with_entity[e].add((doc_id, text))
                for t, s, end in terms_in(text):
                    before = low <= s and end <= m.start() and s >= m.start() - d.CONTEXT
                    after = m.end() <= s and end <= high and end <= m.end() + d.CONTEXT
                    if before or after:
                        together[e, t].add((doc_id, text))
    n = len(rows)

    def share(both, of_term, e):
        bits = math.log2(n / len(with_entity[e]))
        return 1 + math.log2(both / (of_term + 1)) / bits if bits > 0 else -1

    hides = defaultdict(list)
    for (e, t), docs in together.items():
        if len({text for _, text in docs}) >= d.MIN_TEXTS and share(len(docs), with_term[t], e) >= d.DISCLOSURE:
            letters = t[: d.CLASS]
            class_n = sum(k for x, k in with_term.items() if x[: d.CLASS] == letters)
            class_together = sum(len(x) for (f, u), x in together.items() if f == e and u[: d.CLASS] == letters)
            hides[t].append(share(class_together, class_n, e) < d.DISCLOSURE)
    return {t: t[: d.CLASS] + "*" if all(x) else "" for t, x in hides.items()}


ODD_TEXTS = [
    "a@b.c_d@e.f x%y+z-1@host-1.example.co.uk. 1.2.3.4.5.6.7.8 256.1.1.1 00255.000.1.09 1.2.3.4.",
    "4111 1111 1111 1111 or 4111-1111-1111-1111, 4111  1111 1111 1111 and 41111111111111111 5500005555555559",
    "call +1 (743) 555-3824, +49 30 1234567. +1+22222222 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "élan.b@x.orgé _@_._ a@b @c.d e@f.g@h.i +1(((((9 12:34 1-2-3 007 4111 1111 1111 1111 4111 1111 1111 1111",
    "🙂🙂 me@x.org 🙂 10.0.0.1🙂",
    "İstanbul İİİ me@x.org",
]


def test_base_spans_equal_plain_patterns(spark, odd):
    rng = random.Random(2)
    pieces = ["a@b.cd", "1.2.3.4", "+12 345 678 90", "4111111111111111", " ", "-", ".", "@", "+", "7", "é", "_", "x", "\n", "999", "(", "🙂"]
    rows = [(1000 + i, "".join(rng.choice(pieces) for _ in range(40))) for i in range(400)] + list(enumerate(ODD_TEXTS, 5000))
    docs = odd.select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id long, text string"))
    got = d.private_spans(docs).drop("spans", "n_term").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((base_row(r.doc_id, r.text) for r in docs.collect()), key=repr)


def corpus():
    """Documents with mentions; 'Rotterdamse' stands by one address alone, 'unterlagen' by it and as a class of words elsewhere."""
    rng = random.Random(9)
    rows = [(i, passage(i, 60)) for i in range(100)]
    for i in [*range(100, 112), *range(200, 218)]:
        rows.append((i, f"{passage(i, 20)} Rotterdamse unterlagen the (Anna.B@mail.example.org) {passage(i + 500, 30)}"))
    for i in range(112, 150):
        rows.append((i, f"{passage(i, 10)} {rng.choice(['unter', 'unternehmen', 'unterwegs'])} the {passage(i + 500, 30)}"))
    for i in range(150, 160):
        rows.append((i, f"{passage(i, 10)} copied oncecopied 10.1.1.1 near"))
    rows += [(170 + i, "exact copies with singular words 10.2.2.2 here") for i in range(9)]
    rows += [(180, None), (181, ""), (None, "Rotterdamse stands alone"), (182, "rotterdamse " * 3), (182, "rotterdamse " * 3)]
    return rows


def test_disclosing_terms_equal_plain_counts(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.term: r.instead for r in d.disclosing_terms(docs, d.c.stored(d.mentions(docs))).collect()}
    expected = plain_terms(rows)
    assert got == expected
    assert got["rotterdamse"] == "" and got["unterlagen"] == "unt*" and got["oncecopied"] == ""
    assert "the" not in got and "singular" not in got  # common; copies of one text


@pytest.mark.parametrize("chunk", [d.CHUNK, 7])
def test_spans_hold_base_and_terms(spark, chunk, monkeypatch):
    monkeypatch.setattr(d, "CHUNK", chunk)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    terms = plain_terms(rows)
    expected = []
    for doc_id, text in rows:
        extra = [(4, s, e) for t, s, e in terms_in(text) if t in terms]
        expected.append((doc_id, listed(base_spans(text) + extra), len(extra)))
    got = [(r.doc_id, r.spans, r.n_term) for r in d.private_spans(docs).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert sum(x[2] for x in expected) > 30


def test_sanitised_texts_hold_no_protected_data(spark):
    columns = "doc_id long, text string, mark int, instead string"
    docs = spark.createDataFrame([(i, t, 7, "kept") for i, t in corpus()], columns).repartition(3)
    terms = plain_terms(corpus())
    got = d.sanitise(docs).collect()
    assert len(got) == len(corpus()) and {(r.mark, r.instead) for r in got} == {(7, "kept")}
    for r in got:
        assert base_spans(r.text) == [] and not {t for t, _, _ in terms_in(r.text)} & set(terms)
    by_id = {r.doc_id: r.text for r in got}
    assert "unt* the ([email])" in by_id[105] and by_id[175] == "exact copies with singular words [ip] here"
    assert by_id[3] == passage(3, 60) and by_id[180] is None


def test_very_long_runs_of_one_kind_end(spark):
    long = ["a" * 300_000, "1" * 300_000, ".1" * 150_000, "+1" + " " * 300_000, "+1" * 100_000, "a.b@c" * 60_000, "x@y" + ".z" * 100_000]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = {r.doc_id: r for r in d.private_spans(docs).collect()}
    assert got[6].spans == "email:0:200003" and got[2].n_ip == 37_500
    assert [got[i].spans for i in (0, 1, 3, 4)] == [""] * 4
    assert got[5].n_email == len(re.findall(PLAIN[0], long[5]))


def test_empty_table(nothing):
    assert d.private_spans(nothing).collect() == []
    assert d.sanitise(nothing).collect() == []


def test_plan_holds_no_python(odd, capsys):
    d.private_spans(odd).explain()
    plan = capsys.readouterr().out
    assert "Scan" in plan and "Python" not in plan and "Arrow" not in plan
