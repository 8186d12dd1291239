from __future__ import annotations

import hashlib
import random
import re

from helpers import EDGE_TEXTS, documents, rows_of

from graphprop.llm import pii

RAW = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (2 if k % 2 else 1)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def brute(text):
    out = []
    for o, (kind, p) in enumerate(RAW.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), o, kind, m.end()))
    return sorted(out)


TEXTS = [
    *EDGE_TEXTS,
    (10, "mail a.b+c@x-y.example.com, then a@b.c@d.e and u@v.cd_e@f.g or x@y no@dot. 🙂 é z@q.rs"),
    (11, "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0255.001.2.3 1.2.3 9.9.9.9."),
    (12, "4111 1111 1111 1111 and 4111-1111-1111-1112, 123456789012 0000000000000000000 1-2"),
    (13, "+1 (658) 555-7033 +49 30 12345 +123 +1234567890123456 +1 ((( 5 +1+2+33333333333 end+4 5"),
    (14, "4913187196670932 53.121.55.90 and +1 (836) 555-9331, 4111111111111111"),
    (15, "7" * 40_000 + " a@b.cc " + "1.2.3.4 " * 3000 + "x" * 50_000 + "@"),
]


def test_base_spans(spark):
    out = pii.digest(pii.personal_data(documents(spark, TEXTS))).collect()
    assert len(out) == len(TEXTS)
    by = {r.doc_id: r for r in out}
    for i, t in TEXTS:
        want, r = brute(t), by[i]
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), i
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[2] == k for w in want) for k in pii.KINDS]
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(k, f"some text here Telefon: +49 30 555{k:04d} und mehr words follow") for k in range(8)]
    rows += [(50, "noch ein Text Telefon: 030 1234 567 und Ende"), (51, "item 030 1234 568 elsewhere"), (52, "Telefon: words und nothing")]
    out = rows_of(pii.digest(pii.personal_data(documents(spark, rows))))
    at = rows[8][1].index("030")
    assert out[50].spans == f"phone:{at}:{at + len('030 1234 567')}" and out[50].n_added == 1
    assert out[51].spans == "" and out[52].spans == ""
    cut = rows_of(pii.redact(documents(spark, rows)))
    assert cut[50].text == "noch ein Text Telefon: <phone> und Ende"
    assert cut[3].text == "some text here Telefon: <phone> und mehr words follow"


def test_discovered_identifiers_make_further_patterns(spark):
    rows = [(k, f"some text here Telefon: +49 30 555{k:04d} und mehr words follow") for k in range(12)]
    rows += [(20 + k, f"noch ein Text Telefon: 030 1234 56{k} und Ende") for k in range(5)]
    rows += [(30 + k, f"ganz anders Ruf: 030 1234 56{k} oder nie") for k in range(5)]
    rows += [(50, "ganz anders Ruf: 040 9876 543 oder nie"), (51, "item 030 9999 568 elsewhere")]
    out = rows_of(pii.digest(pii.personal_data(documents(spark, rows))))
    at = rows[-2][1].index("040")
    assert all(out[20 + k].n_added == 1 and out[30 + k].n_added == 1 for k in range(5))
    assert out[50].spans == f"phone:{at}:{at + len('040 9876 543')}"
    assert out[51].spans == ""


def test_addresses_without_digits_or_at_sign(spark):
    rows = [(k, f"some text here Mail: user{k}@example.com und mehr words follow") for k in range(8)]
    rows += [(50, "noch ein Text Mail: john[at]example.com und Ende"), (51, "item john[at] example.com elsewhere")]
    out = rows_of(pii.digest(pii.personal_data(documents(spark, rows))))
    at = rows[8][1].index("john")
    assert out[50].spans == f"email:{at}:{at + len('john[at]example.com')}"
    assert out[51].spans == ""


def test_redaction_leaves_the_rest(spark):
    docs = documents(spark, TEXTS)
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[1].text is None and out[2].text == "" and out[5].text == EDGE_TEXTS[4][1]
    assert out[14].text == "<card> <ip> and <phone>, <card>" and out[14].band == "x"
    for i, t in TEXTS:
        assert not brute(out[i].text), i
    assert pii.redact(documents(spark, [])).collect() == []


def cut(text, spans):
    """The text with the union of the spans gone, and each one's kind where it starts or where the one before ends."""
    out, at = [], 0
    for s, _, kind, e in sorted(spans):
        out.append((text or "")[at:s] if s > at else "")
        out.append(f"<{kind}>")
        at = max(at, e)
    return again("".join(out) + (text or "")[at:])


def again(text):
    for kind in ("email", "phone", "ip", "card"):
        for s, _, k, e in reversed(brute(text)):
            if k == kind:
                text = text[:s] + f"<{k}>" + text[e:]
    return text


def test_no_part_of_a_span_survives_redaction(spark):
    rng = random.Random(8)
    parts = ["12.34.56.78", "9012 3456 7804", "4111 1111 1111 1111", "+49 30 1234567", "+1.2.3.4.5.6.7.8.9", "a@b.cd", "1.2.3.4@x.yz", "\u00e9", "\U0001f642", "word", "5", " ", " ", "-", ".", "\n"]
    rows = [(100 + k, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for k in range(300)]
    rows += [(1, "from 12.34.56.78 9012 3456 7804 end"), (2, "\U0001f642" * 3000 + " 1.2.3.4 " + "\u00e9" * 2047 + " a@b.cd"), (3, ("x" * 1023 + "1.2.3.4 ") * 40), (4, "1.2.3.4 " * 5000)]
    docs = documents(spark, rows)
    spans = {r.doc_id: [(x.s, x.o, x.kind, x.e) for x in (*r.base, *r.added)] for r in pii.personal_data(docs).collect()}
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert spans[1] == [(5, 1, "ip", 16), (14, 2, "card", 31)] and out[1] == "from <ip><card> end"
    overlaps = 0
    for i, text in rows:
        assert out[i] == cut(text, spans[i]), (i, text)
        overlaps += any(a[3] > b[0] for a, b in zip(sorted(spans[i]), sorted(spans[i])[1:], strict=False))
    assert overlaps > 20


def test_rows_of_one_id_are_redacted_by_their_own_texts(spark):
    rows = [(k, f"some text here Telefon: +49 30 555{k:04d} und mehr words follow") for k in range(8)]
    rows += [(50, "noch ein Text Telefon: 030 1234 567 und Ende"), (50, "Anders Telefon: 030 7654 321 und mehr"), (50, "noch ein Text Telefon: 030 1234 567 und Ende"), (None, "Wieder Telefon: 030 1111 222 und Ende"), (50, None)]
    out = sorted(r.text or "" for r in pii.redact(documents(spark, rows)).where("doc_id is null or doc_id = 50").collect())
    assert out == ["", "Anders Telefon: <phone> und mehr", "Wieder Telefon: <phone> und Ende", "noch ein Text Telefon: <phone> und Ende", "noch ein Text Telefon: <phone> und Ende"]


def test_empty_table(spark):
    assert pii.personal_data(documents(spark, [])).collect() == []
