"""Replacements for personal data: what must change, what must stay, and that nothing meets."""

import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from boxoffice.llm import pii

KEY = "k"
SIMPLE = {  # plain patterns of the test texts, apart from those of the operator
    "email": r"[a-z]+\.\d\d@[a-z0-9]+\.[a-z]+\.com",
    "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}",
    "card": r"(?<!\d)\d{16}(?!\d)",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)",
    "token": r'(?<=token = ")[0-9a-f]{40}',
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def replaced(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [(r.doc_id, r.text, r.n_entities) for r in pii.surrogates(df, KEY).orderBy("doc_id").collect()]


def shape(text):
    return "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in text)


def test_whole_table(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    from boxoffice.llm.queries import QUERIES

    after = {r.doc_id: r for r in QUERIES["op3_surrogates"](spark, "/root/testdata/sf0.01").collect()}
    assert before.keys() == after.keys()
    found = re.compile("|".join(f"(?P<{k}>{p})" for k, p in SIMPLE.items()), re.IGNORECASE)
    new_of, old_of, changed = {}, {}, 0
    for i, text in before.items():
        new = after[i].text
        old_parts, new_parts, at_old, at_new = [], [], 0, 0
        hits = [m for m in found.finditer(text) if m.lastgroup != "card" or luhn(m[0])]
        hits = [m for m in hits if m.lastgroup != "ip" or all(int(o) < 256 for o in m[0].split("."))]
        assert after[i].n_entities == len(hits)
        for m in hits:
            between = text[at_old : m.start()]
            assert new[at_new : at_new + len(between)] == between
            at_new += len(between)
            n = re.match(SIMPLE[m.lastgroup].split(")", 1)[1] if m.lastgroup == "token" else SIMPLE[m.lastgroup], new[at_new:], re.IGNORECASE)
            assert n, (m, new[at_new : at_new + 30])
            if m.lastgroup in ("email", "phone", "card"):
                assert shape(n[0]) == shape(m[0])
            if m.lastgroup == "card":
                assert luhn(n[0]) and n[0][0] == m[0][0]
            key = (m.lastgroup, m[0].lower())
            assert new_of.setdefault(key, n[0].lower()) == n[0].lower()
            assert old_of.setdefault((m.lastgroup, n[0].lower()), key) == key
            at_old, at_new = m.end(), at_new + n.end()
            changed += 1
        assert new[at_new:] == text[at_old:]
    assert changed > 40 and not set(new_of) & {(k, v) for k, v in old_of}


def test_forms_and_names(spark):
    rows = [
        (1, "Mail Ann.Lee99@Mail5.example.com, or ANN.LEE99@MAIL5.EXAMPLE.COM; call +1 (743) 555-3824 or 743-555-3824."),
        (2, "card 4111 1111 1111 1111, not 1234567890123456; ip 192.168.1.7, not 300.1.2.3; ssn 123-45-6789"),
        (3, "Mrs. Ivana Kovač met Mr. Kovač, Frau KOVAČ and Г-жа Анна Орлова; Dr. Kovač"),
        (4, "token: AbCdEf0123456789xyz DE89370400440532013000 DE89 3704 0044 0532 0130 00"),
    ]
    one, two, three, four = (t for _, t, _ in replaced(spark, rows))
    a, b = re.findall(r"\S+@[\w.]+", one)
    assert a.lower() == b.lower() != "ann.lee99@mail5.example.com" and b.isupper() and a[0].isupper()
    x, y = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4})", one), re.search(r"(\d{3})-(\d{3})-(\d{4})\.", one)
    assert x.groups() == y.groups() != ("743", "555", "3824")
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4}), not 1234567890123456; ip 192\.168\.\d+\.\d+, not 300\.1\.2\.3; ssn \d{3}-\d\d-\d{4}$", two)
    assert luhn(card[1].replace(" ", "")) and card[1] != "4111 1111 1111 1111" and "192.168.1.7" not in two
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr\. (\w+), Frau (\w+) and Г-жа ([А-я]+) ([А-я]+а); Dr\. (\w+)", three)
    assert m[1].lower() in pii.GIVEN["f", "latin"].split() and m[5].lower() in pii.GIVEN["f", "cyrillic"].split()
    assert m[2] == m[3] == m[7] == m[4].title() and m[4].isupper() and m[2] != "Kovač"
    assert re.fullmatch(r"token: [A-Z][a-z][A-Z][a-z][A-Z][a-z]\d{10}[a-z]{3} DE\d{20} DE\d\d( \d{4}){4} \d\d", four)
    assert four.split()[2] == "".join(four.split()[3:])


def test_names_that_meet_draw_again(spark):
    rng = random.Random(4)
    names = {"".join(rng.choice("bcdfgl") + rng.choice("aeiou") for _ in range(3)).title() for _ in range(150)}
    names |= {n.title() for n in pii.FAMILY["latin"].split()}
    rows = [(i, f"Mr {n} and again Herr {n}.") for i, n in enumerate(sorted(names))]
    got = [re.fullmatch(r"Mr (\w+) and again Herr (\w+)\.", t) for _, t, _ in replaced(spark, rows)]
    assert all(m[1] == m[2] for m in got)
    new = {m[1] for m in got}
    assert len(new) == len(names) and not new & names


def test_odd_rows(spark, capsys):
    rows = [(1, None), (2, ""), (3, "a.b@c.example.com"), (3, "a.b@c.example.com"), (None, "x"), (None, "a.b@c.example.com"), (4, "z" * 200_000), (5, "1 " * 50_000 + "a.b@c.example.com" + "9" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_entities", F.lit("x")).withColumn("found", F.lit(1)).withColumn("row", F.lit(2)).withColumn("again", F.lit(3))
    out = pii.surrogates(df, KEY)
    assert out.columns == ["doc_id", "text", "found", "row", "again", "n_entities"]
    got = out.collect()
    assert len(got) == 8 and {r.n_entities for r in got if r.text and "@" in r.text and len(r.text) < 30} == {1}
    assert len({r.text for r in got if r.text and "@" in r.text and len(r.text) < 30}) == 1
    assert {len(r.text or "") for r in got if r.doc_id in (1, 2, 4)} == {0, 200_000}
    assert pii.surrogates(df.limit(0), KEY).count() == 0
    out.explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_every_match_holds_a_mark():
    rng = random.Random(9)
    pattern = regex.compile(pii.PATTERN)
    parts = ["Mr ", "Mrs. ", "Bo", "Kovač", "+1", "+49", "(743)", "555", "-", ".", " ", "3824", "tOken", "API-key", "=", "a" * 16, "AKIA", "DE89", "A" * 11, "sk-", "ghp_", "@", "x.com", "12", "9", "Г-жа ", "192.168.1.7"]
    found = 0
    for _ in range(60_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        if pattern.search(text):
            found += 1
            marked = any(m in text for m in pii.MARKS) or any(m in text.lower() for m in pii.ANY_CASE_MARKS) or regex.search(pii.DIGIT_MARK, text)
            assert marked, text
    assert found > 5000


@pytest.mark.parametrize("text", ["", "no entities 2024-01-15, 3.14, 10:30, v1.2.3, 12345678", "a@b", "Mister Ed"])
def test_clean_text_stays(spark, text):
    assert replaced(spark, [(1, text)]) == [(1, text, 0)]


WHOLE = [  # each is one mention; no word of it may stay but titles and particles
    "Frau Anna Maria Schmidt",
    "Mr John F. Kennedy",
    "Mr John F Kennedy",
    "Dr. J.-P. McDonald",
    "Mrs O'Brien",
    "Herr von Berg",
    "Prof. Dr. Weber",
    "Dr. med. Anna-Lena van der Groß",
    "GB29 NWBK 6016 1331 9268 19",
    "NL91 ABNA 0417 1643 00",
    "MU17 BOMM 0101 1010 3030 0200 000M UR",
    "3782 822463 10005",
    "password=hunter2",
    'password: "correct horse!"',
    '"api_key": "swordfish"',
]
STAY = {"Frau", "Mr", "Dr", "Mrs", "Herr", "Prof", "von", "van", "der", "med", "GB", "NL", "MU", "password", "api_key"}


def test_whole_mentions(spark):
    rows = [(k, f"so {m}, they say") for k, m in enumerate(WHOLE)]
    for (_, new, n), said in zip(replaced(spark, rows), WHOLE, strict=True):
        assert n == 1 and new.startswith("so ") and new.endswith(", they say"), new
        new = new[3:-10]
        kept = set(re.findall(r"\w{2,}", said)) & set(re.findall(r"\w{2,}", new))
        assert kept <= STAY, (said, new)
        signs = lambda text: re.sub(r"[\w'-]", "", text)
        assert signs(said) == signs(new), (said, new)


def test_words_of_a_name_are_the_same_everywhere(spark):
    rows = [(1, "Mr John F. Kennedy's, Mr Kennedy Mrs KENNEDY Jr and Herr F. John; Dr T said I"), (2, "password: required, NL91 ABNA 0417 1643 00 THIS IS")]
    one, two = replaced(spark, rows)
    m = re.fullmatch(r"Mr (\w+) ([A-Z])\. (\w+)'s, Mr (\w+) Mrs (\w+) Jr and Herr ([A-Z])\. \w+; Dr ([A-Z]) said I", one[1])
    assert m and one[2] == 5 and m[3] == m[4] == m[5].title() and m[5].isupper() and m[2] == m[6] != "F" and m[7] != "T"
    assert re.fullmatch(r"password: required, NL\d\d [A-Z]{4}( \d{4}){2} \d\d THIS IS", two[1]) and two[2] == 1


def test_long_runs_of_names(spark):
    long = "Mr " + "Aa " * 30_000 + "x"
    assert "Aa" not in replaced(spark, [(1, long)])[0][1]


def test_crowded_forms_settle(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    entities = [("email", f"{a}{b}@example.com") for a in letters for b in letters]
    final = pii.settled(spark.createDataFrame(entities, "kind string, norm string"), KEY).collect()
    subs = {r["sub"] for r in final}
    assert len(final) == len(subs) == len(entities) and not subs & {n for _, n in entities}


@pytest.mark.parametrize("kind, norm", [("ip", "192.168.1.7"), ("secret", "1"), ("phone", "+12345678"), ("email", "_@x.com"), ("ssn", "1")])
def test_later_draws_have_more_forms(spark, kind, norm):
    df = spark.range(40).select(F.lit(kind).alias("kind"), F.lit(norm).alias("norm"), (4 + F.col("id")).cast("int").alias("attempt"))
    subs = {r["sub"] for r in pii.with_draw(df, KEY).collect()}
    assert len(subs) == 40
    if kind == "ip":
        assert any(s.startswith("10.") for s in subs) and any(re.fullmatch("fd00(:[0-9a-f]{4}){7}", s) for s in subs)


def test_longer_forms_keep_all_signs(spark):
    said = ["(743) 555-3824", "+1 743-555-3824", "4111 1111 1111 1111", "A.B@X.COM"]
    subs = ["61234567899", "61234567899", "412345678901234599", "cdefg@y.com"]
    kinds = ["phone", "phone", "card", "email"]
    df = spark.createDataFrame(list(zip(kinds, said, [[s] for s in subs], strict=True)), "kind string, m string, subs array<string>")
    got = [r[0] for r in df.select(F.expr(pii.written("kind", "m", "subs"))).collect()]
    assert got == ["(612) 345-67899", "+1 612-345-67899", "4123 4567 8901 234599", "CDEFG@Y.COM"]


def swapped(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.surrogates(docs, "k").orderBy("doc_id").collect()], [r.n_entities for r in pii.surrogates(docs, "k").orderBy("doc_id").collect()]


def test_one_person_has_one_surrogate(spark):
    (one, two, three, four), n = swapped(
        spark,
        "Frau Anna Schmidt met Dr. Anna Schmidt and Frau Anna.",
        "Mrs Mary Jones-Smith and Mary Jones-Smith's dog; Mary Jones-Smithers, Rosemary Jones-Smith.",
        "Herr Schmidt, Prof. Schmidt and Dr. Anna",
        "Herr Andrea Rossi and Frau Andrea Bianchi, Dr. Andrea Verdi; Mr Martin",
    )
    given, family = re.fullmatch(r"Frau (\w+) (\w+) met Dr\. \1 \2 and Frau \1\.", one).groups()
    assert given.lower() in pii.GIVEN["f", "latin"].split() and {given, family}.isdisjoint({"Anna", "Schmidt"})
    first, last = re.fullmatch(r"Mrs (\w+) ([\w-]+) and \1 \2's dog; Mary Jones-Smithers, Rosemary Jones-Smith\.", two).groups()
    assert {first, last}.isdisjoint({"Mary", "Jones-Smith"})
    assert three == f"Herr {family}, Prof. {family} and Dr. {given}"
    him, her, either = re.fullmatch(r"Herr (\w+) \w+ and Frau (\w+) \w+, Dr\. (\w+) \w+; Mr \w+", four).groups()
    assert len({him, her, either}) == 3
    assert n == [3, 2, 3, 4]


def test_names_of_all_kinds_are_distinct(spark):
    """More names than any list holds: no two are given the same, and none is given one that is there."""
    names = [chr(65 + i) + chr(97 + j) + "nor" for i in range(20) for j in range(12)]
    texts = [f"Mrs {a} X{a.lower()}. Mr {a} Y{a.lower()}. Dr. {a} Z{a.lower()}. Frau Walker, Herr Keller" for a in names]
    out, _ = swapped(spark, *texts)
    found = [re.fullmatch(r"Mrs (\S+) (\S+)\. Mr (\S+) (\S+)\. Dr\. (\S+) (\S+)\. Frau (\S+), Herr (\S+)", t).groups() for t in out]
    subs = {x.lower() for row in found for x in row[:6]}
    assert len(subs) == 6 * len(names) and len({row[6:] for row in found}) == 1
    originals = {w.lower() for t in texts for w in re.findall(r"\w+", t)}
    assert subs.isdisjoint(originals)
