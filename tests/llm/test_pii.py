import hashlib
import random
import re

import pytest

from trussline.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(BASE).index(s[0])))


def test_plain_spans_equal_the_patterns():
    r = random.Random(1)
    for _ in range(20000):
        text = "".join(r.choice("@@..aB-+1290 ()4é%_") for _ in range(r.randrange(40)))
        assert pii.in_order(pii.plain_spans(text)) == brute(text)


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("mail john.smith [at] example [dot] com now", "email", "john.smith [at] example [dot] com"),
        ("so john at example dot com it is", "email", "john at example dot com"),
        ("j0hn(at)example.co.uk", "email", "j0hn(at)example.co.uk"),
        ("write jоhn@exаmple.com today", "email", "jоhn@exаmple.com"),
        ("u​ser@exa​mple.com", "email", "u​ser@exa​mple.com"),
        ("joe&#64;example.com", "email", "joe&#64;example.com"),
        ("call plus four nine one five one two three four five six seven eight ok", "phone", "plus four nine one five one two three four five six seven eight"),
        ("+49 one five one 234 five six seven eight", "phone", "+49 one five one 234 five six seven eight"),
        ("１９２.168.1.1", "ip", "１９２.168.1.1"),
        ("host one nine two dot one six eight dot one dot one.", "ip", "one nine two dot one six eight dot one dot one"),
        ("at 192[.]168[.]1[.]1 now", "ip", "192[.]168[.]1[.]1"),
        ("at 10 dot 0 dot 0 dot 12 now", "ip", "10 dot 0 dot 0 dot 12"),
        ("ask john @ example.org.", "email", "john @ example.org"),
        ("bob@example[.]com", "email", "bob@example[.]com"),
        ("plus one, two oh two, double five five, zero one four seven", "phone", "plus one, two oh two, double five five, zero one four seven"),
        ("４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
        ("host 1 9 2 . 1 6 8 . 0 . 1 is up", "ip", "1 9 2 . 1 6 8 . 0 . 1"),
        ("mail j o h n @ e x a m p l e . c o m, please", "email", "j o h n @ e x a m p l e . c o m"),
        ("ask jo at mail dot example dot org.", "email", "jo at mail dot example dot org"),
        ("ask jo at example [dot] xyz ok", "email", "jo at example [dot] xyz"),
        ("ask jo at example dot co.uk ok", "email", "jo at example dot co.uk"),
    ],
)
def test_disguises(text, kind, found):
    base, new = pii.find_spans(text)
    assert [(k, text[s:e]) for k, s, e in new] == [(kind, found)] and base == brute(text)


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("mail j\u043ehn@example.com now", "email", "j\u043ehn@example.com"),
        ("mail j\u200bohn@example.com now", "email", "j\u200bohn@example.com"),
        ("mail john@example.c\u043em now", "email", "john@example.c\u043em"),
        ("mail john [dot] smith@example.com now", "email", "john [dot] smith@example.com"),
        ("mail john [dot] w [dot] smith@example.com now", "email", "john [dot] w [dot] smith@example.com"),
        ("mail a [dot] b (dot) c [dot] d [at] x [dot] com now", "email", "a [dot] b (dot) c [dot] d [at] x [dot] com"),
        ("so j dot r dot smith @ example.org.", "email", "j dot r dot smith @ example.org"),
        ("call +49 151 234 five 678 ok", "phone", "+49 151 234 five 678"),
        ("pay 4111 one111 1111 1111 ok", "card", "4111 one111 1111 1111"),
        ("host 192 dot 168 dot one dot 7 up", "ip", "192 dot 168 dot one dot 7"),
    ],
)
def test_partly_disguised_identifiers_are_found_whole(text, kind, found):
    base, new = pii.find_spans(text)
    assert [(k, text[s:e]) for k, s, e in new] == [(kind, found)] and base == brute(text)
    assert pii.redacted(text) == text.replace(found, f"[{kind.upper()}]")


@pytest.mark.parametrize("text", ["look. dot a@b.co", "a@b.co and one of 12 +1 (202) 555-0147 one more", "one 2 three", "in 2024 one of 3", "hello\u200b a@b.co"])
def test_nothing_is_added_beside_plain_spans(text):
    assert pii.find_spans(text) == (brute(text), [])


def test_clean_prose_with_at_and_dot_is_left_alone(spark):
    """Whole documents without personal data, told over words that the disguises use."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text]
    clean = [t for t in texts if pii.find_spans(t) == ([], [])]
    assert len(clean) > 0.5 * len(texts)
    for text in clean:
        words = text.split(" ")
        for k, put in zip(range(3, len(words), 7), ("at", "dot", "at", "one", "dot", "point", "at", "dot") * len(words)):
            words[k] = put
        prose = " ".join(words)
        assert pii.find_spans(prose) == ([], [])


def test_long_chains_take_linear_time():
    for text in ("a dot " * 60000, "a dot " * 60000 + "b@c.de", "a [dot] b@c.de " * 20000, "1 one " * 60000, "one - " * 60000 + "1", "." * 300000 + " dot ", " dot " + "a.a." * 75000, "a at " + "b." * 150000 + " dot ", "x @ " + "b-" * 150000 + " dot x", "a at b dot " * 30000, "a " * 150000 + " . ", "1 . " * 75000, "( " * 100000 + " dot "):
        pii.find_spans(text)


@pytest.mark.parametrize("text", ["look at example.com now", "one two three four", "be at home. dot the i", "five five five one two three four", "at the end of the day dot", "Це звичайний текст at all", "oh no one two", "10 . 0 . 0 . 1", "double one two three", "v 1[.]2", "", "Look at this dot matrix", "meet at noon dot com at x dot y", "a b c d e f g . h", "at 1 . 2 . 3 now"])
def test_clean_texts_are_left_alone(text):
    assert pii.find_spans(text) == ([], []) and pii.redacted(text) == text


def test_offsets_survive_all_edits():
    r = random.Random(5)
    for _ in range(500):
        text = "".join(r.choice("abcdef ") for _ in range(r.randrange(60)))
        cuts = sorted(r.sample(range(len(text) + 1), min(len(text), 2 * r.randrange(4)) // 2 * 2)) if text else []
        edits = [(a, b, "X" * r.randrange(3)) for a, b in zip(cuts[::2], cuts[1::2])]
        e = pii.Edited(text, edits)
        assert e.text == "".join([text[a:b] + put for a, b, put in zip([0] + [x[1] for x in edits], [x[0] for x in edits], [x[2] for x in edits])]) + text[edits[-1][1] if edits else 0 :]
        for k, c in enumerate(e.text):
            if c != "X":
                s, t = e.source(k, k + 1)
                assert text[s:t] == c


def test_long_texts_take_linear_time():
    for text in ("1" * 300000, "1." * 150000, "a" * 300000 + "@", "+1" * 100000, "one " * 60000, "a.b at " * 40000):
        pii.find_spans(text)


def test_tables(docs):
    rows = [(1, "a@b.co and 10.0.0.1 and 4111 1111 1111 1111 or +1 (202) 555-0147"), (2, None), (3, ""), (None, "é a@b.co"), (1, "a@b.co"), (4, "x at y dot com"), (5, "a@b.co " * 20000)]
    table = docs(rows, {"spans": "mine", "n_email": "mine"})
    got = pii.pii_report(table).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [t or "" for k, t in rows if k == r.doc_id]
        options = [brute(t) for t in texts]
        assert r.base_sha256 in [hashlib.sha256(pii.joined(b).encode()).hexdigest() for b in options]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) in [tuple(sum(s[0] == k for s in b) for k in BASE) for b in options]
    four = next(r for r in got if r.doc_id == 4)
    assert four.spans == "email:0:14" and four.n_email == 0 and four.n_added == 1
    out = pii.redact(table)
    assert out.columns == table.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert texts[4] == ("[EMAIL]", 7) and texts[2] == (None, None) and texts[None][0] == "é [EMAIL]"
    assert pii.pii_report(docs([])).count() == 0 and pii.redact(docs([])).count() == 0
