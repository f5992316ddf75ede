import hashlib
import random
import re

import pytest

from scanloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_fixed_patterns_equal_the_plain_ones():
    rng = random.Random(1)
    for _ in range(30_000):
        text = "".join(rng.choice("12.3@a-+ ().%4é\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute(text), repr(text)
    assert pii.base_spans("1" * 100_000) == [] and pii.base_spans("a@" * 50_000) == []


def test_report(docs_of):
    docs = [(1, "mail me: ann.b@mail.example.com now"), (2, None), (3, ""), (4, "4111 1111 1111 1111 and 10.0.0.1, 300.1.1.1"), (5, "+1 (555) 123-4567 x"), (5, "+1 (555) 123-4567 x"), (None, "é" * 50 + " 1.2.3.4")]
    got = pii.report(docs_of(docs)).collect()
    assert len(got) == len(docs)
    for r in got:
        text = next(t for i, t in docs if i == r.doc_id) or ""
        base = brute(text)
        joined = ",".join(f"{k}:{b}:{e}" for b, e, k in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in base) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans == joined
    assert pii.report(docs_of([])).count() == 0


def learned(prose):
    """Texts in which addresses follow the words ``write to``, some of them in a form that no fixed pattern has."""
    docs = [(k, f"{prose(k, 10)} please write to person{k}@mail.example.com today {prose(k + 500, 5)}") for k in range(40)]
    docs += [(100 + k, f"{prose(900 + k, 10)} please write to person{k}@localhost today {prose(k + 700, 5)}") for k in range(6)]
    return docs + [(200 + k, f"{prose(800 + k, 10)} serial number item{k}@shelf {prose(k + 600, 5)}") for k in range(10)]


def test_patterns_find_unseen_identifiers(docs_of, prose):
    docs = learned(prose)
    docs = [(i, t.replace("@mail.example.com", "@mail.example.com") if i >= 100 else t) for i, t in docs]
    scanned = pii.scan(docs_of(docs))
    shapes = {m.shape for r in scanned.collect() for m in r.mentions if m.kind == ""}
    assert shapes
    # the same shape as the seeds: a quoted local part
    docs += [(300 + k, f"{prose(300 + k, 10)} please write to person{k}(at)mail9.example.com today {prose(k, 5)}") for k in range(2)]
    patterns = pii.confident_patterns(pii.scan(docs_of(docs)))
    assert ("<write to", "email") in {(r.context, r.as_kind) for r in patterns.collect()}


def test_planted_identifiers_of_another_form_are_returned(docs_of, prose):
    docs = learned(prose)
    docs += [(300 + k, f"{prose(k, 10)} ring me on +1555123{1000 + k} soon {prose(k + 500, 5)}") for k in range(40)]
    docs += [(400, f"{prose(99, 10)} ring me on +1 555 123 soon"), (401, f"{prose(98, 10)} ring me on 12 soon"), (402, f"{prose(97, 10)} ring me on {'7-' * 60}7 soon")]
    text = dict(docs)
    got = {r.doc_id: r.spans for r in pii.report(docs_of(docs)).collect()}
    for k in range(6):
        at = text[100 + k].index(f"person{k}@")
        assert got[100 + k] == f"email:{at}:{at + len(f'person{k}@localhost')}"
    for doc, value in ((400, "+1 555 123"), (401, "12"), (402, "7-" * 60 + "7")):
        at = text[doc].index(value)
        assert got[doc] == f"phone:{at}:{at + len(value)}"
    assert {got[200 + k] for k in range(10)} == {""}


def test_added_spans(docs_of, prose):
    docs = [(k, f"{prose(k, 10)} card number 4111 1111 1111 1111 ends {prose(k + 500, 5)}") for k in range(3)]
    docs = [(k, f"{prose(k, 10)} ring me on +1555123{1000 + k} soon {prose(k + 500, 5)}") for k in range(40)]
    # too short for a phone number by the fixed pattern, in the same place and of the same shape
    docs += [(100, f"{prose(99, 10)} ring me on +1555123 soon"), (101, f"{prose(98, 10)} weight in +1555123 grams")]
    got = {r.doc_id: r.spans for r in pii.report(docs_of(docs)).collect()}
    at = docs[40][1].index("+1555123")
    assert got[100] == f"phone:{at}:{at + 8}"
    assert got[101] == ""


def test_redact_keeps_rows_and_columns(docs_of, prose):
    docs = [(1, "write a.b@c.de!"), (2, None), (3, "none"), (3, "none")]
    table = docs_of(docs)
    out = pii.redact(table)
    assert out.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "write [EMAIL]!"), (2, None), (3, "none"), (3, "none")], key=str)
    assert pii.redacted("0123456789", [(1, 4, "ip"), (2, 6, "card"), (8, 9, "phone")]) == "0[IP]67[PHONE]9"


@pytest.mark.parametrize("size", [10, 200, 5_000])
def test_contexts_are_whole_words_to_the_ends_of_the_line(size):
    long = "w" * size
    text = f"{long} first {long} second 123456 {long} rest\nnext 77777 \n 88888"
    assert pii.words_before(text, text.index("123456"), 2) == [long, "second"]
    assert pii.words_after(text, text.index("123456") + 6, 1) == [long]
    assert pii.words_before(text, text.index("77777"), 2) == ["next"] and pii.words_after(text, text.index("77777") + 5, 1) == []
    assert pii.words_before(text, text.index("88888"), 2) == [] and pii.words_after(text, len(text), 1) == []
    one, other = (pii.context(f"{long}{c} is 123456", size + 5, size + 11) for c in "ab")
    assert one != other


def test_shapes_are_of_whole_values():
    assert pii.shape_of("Ab-12-" * 30) != pii.shape_of("Ab-12-" * 30 + "x") and pii.shape_of("AB12.cd") == "A9.a"


def test_empty_table(docs_of):
    assert pii.report(docs_of([])).count() == 0 and pii.redact(docs_of([])).count() == 0
