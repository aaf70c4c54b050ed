import hashlib
import random
import re

import llm_cases
import pytest

from plainspeak.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return re.sub("[^0-9]", "", text)


def checksum(number):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(number))]
    return sum(sum(map(int, str(d))) for d in doubled) % 10 == 0


def brute(text):
    return [
        [m.span() for m in EMAIL.finditer(text)],
        [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
        [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and checksum(digits(m[0]))],
        [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15],
    ]


def test_plain_identifiers_against_brute_force():
    r = random.Random(3)
    parts = [*"a1.@+- ()0é", "12.", ".3", "@a.b", "+1", "4111111111111111", "255.", "256", "\n", "4012 8888-8888 1881", "x@y-z.com"]
    total = 0
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 22)))
        assert pii.plain(text) == brute(text), text
        total += sum(map(len, brute(text)))
    assert total > 1000


def found(text):
    return [[text[a:b] for a, b in spans] for spans in pii.disguised(text, pii.plain(text))]


@pytest.mark.parametrize(
    ("kind", "text", "part"),
    [
        ("email", "ask john dot doe at example dot com now", "john dot doe at example dot com"),
        ("email", "jоhn@exаmple.com", "jоhn@exаmple.com"),
        ("email", "j​o@a.de", "j​o@a.de"),
        ("email", "john [at] example [dot] co (dot) uk!", "john [at] example [dot] co (dot) uk"),
        ("email", "日本 foo(at)bar.com", "foo(at)bar.com"),
        ("email", "foo @ bar.com", "foo @ bar.com"),
        ("email", "ｆｏｏ＠bar．com", "ｆｏｏ＠bar．com"),
        ("phone", "plus one five five five one two three four five six seven", None),
        ("phone", "+4９ 171 ２３４５６７８", None),
        ("ip", "up: one nine two dot one six eight dot one dot one", "one nine two dot one six eight dot one dot one"),
        ("ip", "192[.]168[.]1[.]1", None),
        ("card", "four one one one one one one one one one one one one one one one", None),
        ("card", "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", None),
    ],
)
def test_disguises_map_back_to_the_source(kind, text, part):
    spans = found(text)
    assert spans[pii.KINDS.index(kind)] == [part or text]
    assert sum(map(len, spans)) == 1


@pytest.mark.parametrize(
    "text", ["look at example.com", "meet at noon dot", "one two three", "naïve façade über", "a dot b", "plain text", "", "a@b.cd 1.2.3.4"]
)
def test_clean_texts_get_no_added_span(text):
    assert sum(map(len, found(text))) == 0


def test_every_written_character_stands_for_its_source():
    text = "x fоo (at) bar dot com, plus one two 3 four y"
    tape = pii.transduced(text)
    assert len(tape.text) == len(tape.start) == len(tape.end)
    assert all(a < b for a, b in zip(tape.start, tape.end)) and all(tape.start[:-1] <= tape.start[1:])
    for c, a, b in zip(tape.text, tape.start, tape.end):
        source = text[a:b]
        assert c == source or c in "@.+o" or source in ("one", "two", "four")


def test_rows(spark):
    rows = pii.find_personal_data(llm_cases.rows(spark)).collect()
    want = []
    for row in llm_cases.ROWS:
        base = brute(row[1] or "")
        line = ",".join(f"{k}:{a}:{b}" for k, spans in zip(pii.KINDS, base) for a, b in spans)
        want.append((row[0], *map(len, base), hashlib.sha256(line.encode()).hexdigest(), line))
    assert sorted([tuple(r) for r in rows], key=str) == sorted(want, key=str)
    assert pii.find_personal_data(llm_cases.none(spark)).count() == 0
