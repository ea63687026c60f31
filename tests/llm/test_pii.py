import itertools
import random
import re

import pytest

from waymesh.llm import pii

DOC = "doc_id long, text string"
KEY = b"test"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail a.b+c@mail7.example.com now", [("email", "a.b+c@mail7.example.com")]),
        ("call +1 (017) 555-7713 or 030 1234 5678", [("phone", "10175557713"), ("phone", "03012345678")]),
        ("from 97.51.17.173 and 1.2.3.4.5", [("ipv4", "97.51.17.173")]),
        ("7536784127813050 4845168114407329", [("card", "7536784127813050"), ("card", "4845168114407329")]),
        ("4845-1681-1440-7329", [("card", "4845168114407329")]),
        ("078-05-1120", [("ssn", "078051120")]),
        ("DE89 3704 0044 0532 0130 00", [("iban", "DE89370400440532013000")]),
        ("Mrs. Anna Ward met MR WARD", [("given/f/latin", "anna"), ("surname/latin", "ward"), ("surname/latin", "ward")]),
        ("Госпожа Анна Белова", [("given/f/cyrillic", "анна"), ("surname/cyrillic", "белова")]),
        ("Mr Ward met us. Later Ward left; Ward's car, WARD, award, a ward", [("surname/latin", "ward")] * 4),
        ("Dr Alexandra Smith", [("given/f/latin", "alexandra"), ("surname/latin", "smith")]),
        ("at 2001:DB8::1 or 2001:0db8:0000:0000:0000:0000:0000:0001, a::b: c::", [("ipv6", "2001:db8::1"), ("ipv6", "2001:db8::1")]),
        ("on 2024-01-02-03 and 02.01.2024 version 1.2.3.4", []),
        ("token = 04dbebab91ab85687d33eeaaf9ac699e1188f962, 2024, v1.2", []),
    ],
)
def test_find(text, want):
    assert [(k, v) for _, _, k, v in pii.find(text)] == want


def test_permutation_is_one_to_one_and_keeps_the_format():
    seen = {pii.permute(KEY, f"{a}{b}-{c}", "t") for a, b, c in itertools.product("0123456789", "abcdefghijklmnopqrstuvwxyz", "01")}
    assert len(seen) == 520
    out = pii.permute(KEY, "Ab9-я", 1)
    assert len(out) == 5 and out[0].isupper() and out[1].islower() and out[2].isdigit() and out[3] == "-" and out[4] in pii.ALPHABETS[3]
    assert pii.permute(b"other", "1234567890", 1) != pii.permute(KEY, "1234567890", 1)


def test_formats():
    assert pii.luhn_digit("7992739871") == "3"
    new = pii.surrogate(KEY, "card", "79927398713", 0)
    assert pii.luhn_digit(new[:-1]) == new[-1]
    assert pii.in_format("+1 (017) 555-7713", "phone", "23456789012") == "+2 (345) 678-9012"
    assert pii.in_format("WARD", "surname/latin", "bauer") == "BAUER"
    assert pii.surrogate(KEY, "given/f/greek", "ελένη", 0) in pii.GIVEN["f", "greek"]
    a, b = (pii.surrogate(KEY, "email", f"{n}@mail7.example.com", 0) for n in ("ann", "bob"))
    assert a.split("@")[1] == b.split("@")[1] and a.endswith(".com")
    assert all(0 <= int(x) < 256 for x in pii.surrogate(KEY, "ipv4", "97.51.17.173", 0).split("."))


def test_check_digits_case_and_made_names():
    assert pii.iban_checks("DE", "370400440532013000") == "89"
    new = pii.surrogate(KEY, "iban", "DE89370400440532013000", 0)
    assert new[:2] == "DE" and pii.iban_checks("DE", new[4:]) == new[2:4] and len(new) == 22 and new[4:].isdigit()
    mail = pii.in_format("John.Smith@Example.com", "email", pii.surrogate(KEY, "email", "john.smith@example.com", 0))
    assert [c.isupper() for c in mail] == [c.isupper() for c in "John.Smith@Example.com"]
    assert pii.in_format("2001:DB8::1", "ipv6", "2001:db8:0:1::ab") == "2001:DB8:0:1::AB"
    for kind, script in (("given/f/latin", "latin"), ("given/m/cyrillic", "cyrillic"), ("surname/greek", "greek")):
        made = [pii.made_name(KEY, kind, f"name{i}", 4) for i in range(500)]
        assert len(set(made)) > 490 and all(pii.script_of(x) == script for x in made)
    assert pii.made_name(KEY, "surname/cyrillic", "белова", 1).endswith(("ова", "ева", "ина"))
    assert pii.made_name(KEY, "given/f/latin", "anna", 2)[-1] == "a" and pii.made_name(KEY, "given/m/latin", "karl", 2)[-1] != "a"


def test_a_full_format_is_solved(spark):
    """All numbers of three digits are real, and so is one name alone in its shape."""
    rows = [("phone", f"{i:03d}") for i in range(1000)] + [("ssn", "12"), ("card", "-")]
    got = pii.assign(spark.createDataFrame(rows, "kind string, value string"), KEY, most_rounds=3).collect()
    assert {(r.kind, r.value) for r in got} == set(rows) and len({(r.kind, r.new) for r in got}) == len(rows)
    assert all(r.new != r.value for r in got) and all(len(r.new) == 3 and r.new.isdigit() for r in got if r.kind == "phone")


def test_a_corpus_keeps_entities_apart_and_together(spark):
    """Against a plain pass: equal entities have equal surrogates everywhere, different ones different ones; none is left."""
    rng = random.Random(3)
    people = [(rng.choice(["Mr", "Frau", "Dr"]), "".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(3)).title()) for _ in range(120)]
    mails = [f"{n.lower()}{i}@x{i % 7}.example.com" for i, (_, n) in enumerate(people)]
    phones = [f"+4930{rng.randint(1000000, 9999999)}" for _ in range(60)]
    rows = []
    for i in range(200):
        said = [f"{t} {n} came" if rng.random() < 0.7 else f"{t} {n.upper()}" for t, n in rng.sample(people, 2)] + [rng.choice(mails), rng.choice(phones), rng.choice(mails).upper(), f"then {people[i % 120][1]} went"]
        rng.shuffle(said)
        rows.append((i, ". ".join(said)))
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], DOC + ", kind string, value int, th int").repartition(3)
    got = {r.doc_id: r for r in pii.pseudonymise(df, key=KEY).collect()}
    known = {}
    for i, text in rows:
        before = pii.find(text)
        assert got[i].n_replaced == len(before) and got[i].n_entities == len({x[2:] for x in before})
        done = shift = 0
        out = got[i].text
        for (a, b, kind, value), following in zip(before, [x[0] for x in before[1:]] + [len(text)]):
            assert out[done + shift : a + shift] == text[done:a]
            rest = text[b : min(b + 4, following)]
            end = out.index(rest, a + shift) if rest else len(out)
            if kind != "email":
                known.setdefault((kind, value), set()).add(re.sub(r"\W", "", out[a + shift : end]).lower())
            else:
                end = a + shift + (b - a)
                known.setdefault((kind, value), set()).add(out[a + shift : end].lower())
            shift, done = end - b, b
    assert all(len(x) == 1 for x in known.values())
    news = [(k[0], *x) for k, x in known.items()]
    assert len(set(news)) == len(news)
    assert not {(k[0], re.sub(r"\W", "", k[1]) if k[0] != "email" else k[1]) for k in known} & set(news)


def test_assign_is_distinct(spark):
    rng = random.Random(1)
    rows = {("surname/latin", f"name{i}") for i in range(300)} | {("surname/latin", n) for n in pii.SURNAMES["latin"]}
    rows |= {("phone", f"{i * 31:04d}") for i in range(300)} | {("card", str(rng.randint(10**15, 10**16 - 1))) for _ in range(50)}
    got = pii.assign(spark.createDataFrame(sorted(rows), "kind string, value string"), KEY).collect()
    assert {(r.kind, r.value) for r in got} == rows
    phones = [r for r in got if r.kind == "phone"]
    assert len({(r.kind, r.new) for r in got}) == len(rows)
    assert not {(r.kind, r.new) for r in got } & rows and all(len(r.new) == 4 for r in phones)


def test_documents(spark):
    rows = [(1, "Write a@b.example.com, Mr John Ward, +1 (017) 555-7713."), (2, "MR WARD: +10175557713, a@b.example.com"), (3, None), (4, ""), (None, "Frau Ward"), (5, "no data"), (6, "x " * 100_000 + "a@b.example.com"), (6, "x " * 100_000 + "a@b.example.com")]
    got = pii.pseudonymise(spark.createDataFrame([(*r, "x") for r in rows], DOC + ", known string"), key=KEY).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[3].text == by_id[4].text == "" and by_id[5].text == "no data"
    one, two = by_id[1].text, by_id[2].text
    for gone in ("a@b.example.com", "Ward", "555-7713", "John"):
        assert gone not in one and gone not in two and gone.upper() not in two
    mail = one.split()[1].rstrip(",")
    assert mail in two and by_id[6].text.endswith(mail) and by_id[1].n_replaced == 4
    surname = one.split(",")[1].split()[-1]
    assert surname.upper() in two and by_id[None].text == f"Frau {surname}"
    assert pii.pseudonymise(spark.createDataFrame([], DOC)).collect() == []
