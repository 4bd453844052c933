"""Entities of the base patterns against brute force; what contexts teach on planted documents."""

import hashlib
import random
import re

from factloom.llm import pii
from factloom.llm.queries import pii_digest


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(3, m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def test_base_entities(spark):
    r = random.Random(3)
    texts = [None, "", "é a@b.c_d@e.f", "a@b@c.d x@y", "a@b..c.d@e.f", "1.2.3.4.5.6.7.8.9", "256.1.1.1 0255.01.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "+1 (743) 555-3824", "+1 555-38. +49 30 1234567-", "x@" + "a." * 20000 + "b", "1 " * 30000, "a" * 30000, "a.b" * 9000 + "@x.y"]
    parts = ["a", "b.c", "@", ".", "x1", "%", "-", " ", "12", "255", "256", "+", "+49", "(", ")", "4111111111111111", "é", "\n", "_"]
    texts += ["".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, row_no int, all string").repartition(8)
    got = {x.doc.doc_id: x for x in pii.find_pii(docs, rounds=1).collect()}
    digest = {x.doc_id: x for x in pii_digest(pii.find_pii(docs, rounds=1)).collect()}
    for i, t in enumerate(texts):
        want = base(t or "")
        found = [tuple(e) for e in got[i].entities]
        assert [e for e in found if e[3] != "context"] == want, repr((t or "")[:99])
        assert digest[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for _, a, b, k in want).encode()).hexdigest()
        assert (digest[i].n_email, digest[i].n_ip, digest[i].n_card, digest[i].n_phone) == tuple(sum(e[3] == k for e in want) for k in pii.KINDS[:4])
        assert got[i].doc.text == t and got[i].doc.row_no == 1


def test_contexts_teach(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "4222222222222220", "378282246310005", "6011111111111117", "3530111333300000", "5105105105105100", "4000056655665556", "5200828282828210"]
    rows = [f"please pay with card number {c} today" for c in cards if base(f"x {c}")]
    assert len(rows) >= 8
    rows += ["please pay with card number 4111111111111112 today", "the build number 20240101123456789 passed", "member id AB1234567 was seen", *["member id AB7654321 was seen"] * 5]
    # Values two steps away: contexts of learnt values teach in turn.
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)] + [(None, None), (0, rows[0])], "doc_id long, text string")
    got = {x.doc.doc_id: [tuple(e) for e in x.entities] for x in pii.find_pii(docs).collect()}
    new = {i: [e for e in es if e[3] == "context"] for i, es in got.items()}
    at = rows.index("please pay with card number 4111111111111112 today")
    text = rows[at]
    assert new[at] == [(4, text.index("4111"), text.index(" today"), "context")]
    assert not any(new[i] for i in new if i != at)
    assert got[0] == [(2, 28, 44, "card")] and got[None] == []
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_known_values_in_other_notations(spark):
    # The second notation counts alone and next to any words; an ip is no group of eight digits.
    rows = ["reach me at +1 743 555 3824 please", "call 1 743 555 3824", "1-743-555-3824", "paid 4111-1111-1111-1111", "host 10.20.30.40 is up", "lot 10203040 sold"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc.doc_id: [tuple(e) for e in x.entities] for x in pii.find_pii(docs).collect()}
    assert got == {0: [(3, 12, 27, "phone")], 1: [(4, 5, 19, "context")], 2: [(4, 0, 14, "context")], 3: [(2, 5, 24, "card")], 4: [(1, 5, 16, "ip")], 5: []}


def test_ip_silences_no_digits(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "4222222222222220", "378282246310005", "6011111111111117", "3530111333300000", "5105105105105100"]
    rows = [f"please pay with card number {c} today" for c in cards] + ["please pay with card number 10203040 today"]
    found = lambda rows: {x.doc.doc_id: [tuple(e) for e in x.entities] for x in pii.find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}[len(cards)]
    assert found(rows) == found([*rows, "host 10.20.30.40 is up"]) == [(4, 28, 36, "context")]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = pii.find_pii(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
