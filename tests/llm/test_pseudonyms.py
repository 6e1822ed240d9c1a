"""Pseudonyms against a plain Python network, their checks, and the way back."""

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from paritas.llm import pseudonyms as P

TEXTS = [
    "Mail éan.34@mail7.example.com or Bob.Smith+x@ex-a.org!",
    "call +1 (017) 555-7713%%% or 017-555-7713, (017) 555-7713",
    "card 4111 1111 1111 1111 and 4111111111111111 and 9807915762804490",
    "ip 97.51.17.173 999.1.1.1 8.8.8.8 1.2.3.4.5 01.2.3.4",
    "on 1985-02-29 1985-02-28 03/04/1999 25.12.2001 12/25/2001 31.02.2001 2000-02-29",
    "ssn 123-45-6789 000-12-3456 665-01-0001 667-99-9999",
    "DE89 3704 0044 0532 0130 00 DE89370400440532013000, GB82WEST12345698765432 GB83WEST",
    'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" "b44e15e09fd311c3cf3163b66d5a9875b883"',
    "",
    None,
    "nothing 12 of 3.4 interest",
]


def plain(values, radices, kind, key=P.KEY):
    half = len(values) // 2
    left, right = values[:half], values[half:]
    ml, mr = radices[:half], radices[half:]
    for i in range(P.ROUNDS):
        said = f"{key}:{kind}:{i}:{','.join(map(str, right))}"
        h = hashlib.sha512(said.encode()).hexdigest()
        shift = [int(h[4 * (j % 32) : 4 * (j % 32) + 4], 16) for j in range(len(left))]
        added = [(x + s) % m for x, s, m in zip(left, shift, ml, strict=True)]
        left, right, ml, mr = right, added, mr, ml
    return left + right


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def mapped(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df = df.withColumn("parts", F.lit(1)).withColumn("found", F.lit("x"))
    return [r.text for r in P.pseudonymised(df, **kw).orderBy("doc_id").collect()]


def test_way_back_and_links(spark):
    out = mapped(spark, TEXTS)
    assert mapped(spark, out, back=True) == TEXTS
    assert out[8:] == TEXTS[8:]
    assert out[0].endswith("@mail7.example.com or " + out[0].split(" or ")[1])
    phones = re.findall(r"\d{3}\D{1,2}\d{3}-\d{4}", out[1])
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and len(phones) == 3
    spaced, joined, other = re.search(r"card (.{19}) and (\d{16}) and (\d{16})", out[2]).groups()
    assert spaced.replace(" ", "") == joined and luhn(joined) == 0
    assert luhn(other) == luhn("9807915762804490") and other != "9807915762804490"
    assert "999.1.1.1" in out[3] and "1.2.3.4.5" in out[3] and "01.2.3.4" in out[3]
    assert "97.51.17.173" not in out[3] and "1985-02-29" in out[4] and "31.02.2001" in out[4]
    assert "000-12-3456" in out[5] and "123-45-6789" not in out[5] and "GB83WEST" in out[6]
    for iban in re.findall(r"[A-Z]{2}\d\d[A-Z0-9]{12,}", out[6]):
        spelt = "".join(str(int(c, 36)) for c in iban[4:] + iban[:4])
        assert int(spelt) % 97 == 1
    assert [len(t) for t in out[5:8]] == [len(t) for t in TEXTS[5:8]]
    assert mapped(spark, TEXTS, key="another") != out


def test_network_is_the_plain_one(spark):
    cases = [([3], [10]), ([1, 2, 3], [10, 26, 1]), (list(range(40)), [100] * 40)]
    for values, radices in cases:
        df = spark.createDataFrame([(values, radices)], "v array<int>, m array<int>")
        got = df.select(P.permuted(F.col("v"), F.col("m"), "k", P.KEY)).first()[0]
        assert got == plain(values, radices, "k")


@pytest.mark.parametrize(("century", "days"), [(1900, 36524), (2000, 36525)])
def test_every_day_of_a_century_is_hit_once(spark, century, days):
    first = datetime.date(century, 1, 1)
    texts = [(first + datetime.timedelta(i)).isoformat() for i in range(0, days, 7)]
    out = mapped(spark, texts)
    assert len(set(out)) == len(texts)
    assert all(int(t[:2]) == century // 100 and datetime.date.fromisoformat(t) for t in out)


def test_month_first_dates_stay_so(spark):
    texts = [f"{m:02d}/{d:02d}/1999" for m in range(1, 13) for d in range(13, 29)]
    out = mapped(spark, texts)
    assert len(set(out)) == len(texts) and all(int(t[3:5]) > 12 for t in out)
    assert mapped(spark, out, back=True) == texts


def test_documents(spark, mini):
    docs = spark.read.parquet(f"{mini}/documents.parquet")
    new = P.pseudonymised(docs)
    assert new.columns == docs.columns
    pairs = docs.join(new.select("doc_id", F.col("text").alias("new")), "doc_id").collect()
    number, changed = re.compile(r"(?<![\w.+-])\d{16}(?!\w)"), 0
    for row in pairs:
        text = row.text or ""
        if not re.search(r"[0-9@]", text):
            assert row.new == row.text
        for value in number.findall(text):
            changed += 1
            assert value not in row.new
    assert changed > 10
    assert P.pseudonymised(docs.limit(0)).count() == 0


def iban(country, length):
    own = ("WEST12345698765432107361528493"[: length - 4])
    spelt = "".join(str(int(c, 36)) for c in own + country + "00")
    return f"{country}{98 - int(spelt) % 97:02d}{own}"


def test_iban_of_every_length_ends_before_a_capital_word(spark):
    texts, values = [], []
    for length, countries in P.IBAN_COUNTRIES.items():
        for country in countries.split():
            value = iban(country, length)
            grouped = " ".join(value[i : i + 4] for i in range(0, length, 4))
            for word in ("A", "EU", "EUR", "EURO", "SWIFT", "EUR USD"):
                values += [value, grouped]
                texts += [f"{value} {word}", f"{grouped} {word}"]
    texts += ["BE68 5390 0754 7034 EUR", "ES9121000418450200051332 USD"]
    values += ["BE68 5390 0754 7034", "ES9121000418450200051332"]
    out = mapped(spark, texts)
    for text, value, new in zip(texts, values, out, strict=True):
        found = new[: len(value)]
        assert found != value and new[len(value) :] == text[len(value) :]
        plain_new = found.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain_new[4:] + plain_new[:4])) % 97 == 1
    assert mapped(spark, out, back=True) == texts


#: Two values of every kind and format, as they stand beside each other.
SIDE = [
    ["a.b@example.com", "c@mail.example.org"],
    ["DE89 3704 0044 0532 0130 00", "BE68539007547034"],
    ["9233a8ecf7c5b09fe5949719b6b82bc439e9329b", "B44E15E09FD311C3CF3163B66D5A9875"],
    ["2024-03-05", "12/25/2024", "05.03.2024"],
    ["123-45-6789", "665-01-0001"],
    ["190.137.223.204", "8.8.8.8"],
    ["+1 (826) 555-4081", "+33 1 23 45 67 89", "(017) 555-7713", "017-555-7713"],
    ["4111 1111 1111 1111", "4845168114407329", "3782 822463 10005", "5500-0000-0000-0004"],
]


def test_values_side_by_side_are_those_they_are_alone(spark):
    values = [value for kind in SIDE for value in kind]
    alone = dict(zip(values, mapped(spark, values), strict=True))
    assert all(alone[value] != value for value in values)
    pairs = [(a, b) for a in values for b in values]
    texts = [f"{a} {b}" for a, b in pairs]
    out = mapped(spark, texts)
    wrong = [t for t, (a, b), o in zip(texts, pairs, out) if o != f"{alone[a]} {alone[b]}"]
    assert not wrong
    assert mapped(spark, out, back=True) == texts


def test_findings_end_with_their_value(spark):
    texts = [
        "+44 20 7946 0958 12 people",
        "+1 (017) 555-7713 2024 3",
        "4111 1111 1111 1111 123",
        "+49 30 1234 5678 12.50 EUR",
    ]
    ends = [" 12 people", " 2024 3", " 123", " 12.50 EUR"]
    out = mapped(spark, texts)
    for text, end, new in zip(texts, ends, out, strict=True):
        assert new.endswith(end) and new[: -len(end)] != text[: -len(end)]
    assert out[2][:19].replace(" ", "") == mapped(spark, ["4111111111111111"])[0]
    assert mapped(spark, out, back=True) == texts


def test_rows_of_numbers_stay_unless_they_pass_the_check(spark):
    plain_rows = ["years 2019 2020 2021 2022 2023", "12 15 18 22 31 45 61"]
    cards = [
        "2019 4111 1111 1111 1111",
        "41 11 11 11 11 11 11 11",
        "4111 1111 1111 1112",
        "4111111111111112",
    ]
    out = mapped(spark, plain_rows + cards)
    assert out[:2] == plain_rows
    assert all(new != text for text, new in zip(cards, out[2:], strict=True))
    assert out[2].startswith("2019 ") and luhn(out[3].replace(" ", "")) == 0
    assert luhn(out[4].replace(" ", "")) == luhn(out[5]) == luhn(cards[3])
    assert mapped(spark, out, back=True) == plain_rows + cards


def test_the_key_is_the_sessions(spark, caplog):
    docs = spark.createDataFrame([(1, "card 4111111111111111")], "doc_id long, text string")
    public = P.pseudonymised(docs).first().text
    assert "public key" in caplog.text
    spark.conf.set(P.KEY_SETTING, "of this session")
    try:
        own = P.pseudonymised(docs)
        assert own.first().text != public
        assert own.first().text == P.pseudonymised(docs, key="of this session").first().text
        assert P.pseudonymised(own, back=True).first().text == docs.first().text
    finally:
        spark.conf.unset(P.KEY_SETTING)
