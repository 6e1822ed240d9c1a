"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Found and validated are mail addresses, account numbers (IBAN, by check digits), long
hexadecimal secrets, dates (by the calendar), social security numbers and IP addresses
(by the ranges of their parts), telephone numbers and card or account numbers of 13 to 19
digits (by the mod-10 check, unless they have no separators or a card's usual groups).
What fails its check stays. Each is permuted among the values of its kind and
format by a Feistel network whose rounds are keyed hashes. The permutation depends on key
and kind alone: equal values get equal pseudonyms in all documents whatever separators
they are written with, unequal values unequal ones, and the holder of the key can go back.
Only numbers in a row of groups that can be read in several ways are permuted further,
until they are read as before. Separators stay; check digits are computed anew, and a
wrong one stays wrong by as much; a date stays in its century; the domain of a mail
address stays, letters that are not ASCII too.

Only built-in SQL functions are used: a text is split at the findings, the findings are
transformed, and both are joined again. Null and empty texts and texts without findings
stay as they are. Rows keep all their columns; repeated rows are treated alike.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: Setting of the session that names the secret key, and the key of sessions without it.
#: That one is public: whoever reads it can take the pseudonyms back.
KEY_SETTING = "spark.paritas.pseudonyms.key"
KEY = "set a secret key in production"
#: Rounds of the network; an even number.
ROUNDS = 6

_BEFORE = r"(?<![\p{L}\p{N}])"
_AFTER = r"(?![\p{L}\p{N}])"
MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: Countries by the length of their account numbers (IBAN registry).
IBAN_COUNTRIES = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    33: "RU",
}


def _iban_format(length: int) -> str:
    """What follows the check digits: groups of four and a rest."""
    fours, rest = divmod(length - 4, 4)
    return f"(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


_BY_LENGTH = "|".join(
    f"(?:{countries.replace(' ', '|')})[0-9]{{2}}{_iban_format(length)}"
    for length, countries in IBAN_COUNTRIES.items()
)
_LISTED = "|".join(IBAN_COUNTRIES.values()).replace(" ", "|")
#: Of a country in the registry a number has one length, so a word behind it is not taken.
IBAN = (
    rf"(?:{_BY_LENGTH}"
    rf"|(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)"
)
SECRET = r"(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)"
DATE = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4})"
SOCIAL = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
ADDRESS = r"(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.[0-9])"
_DAY = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}(?:/[0-9]{2}/|\.[0-9]{2}\.)[0-9]{4})"
_PART = f"(?:{_DAY}|{SOCIAL}|{ADDRESS})"
_FOUR = rf"[0-9]{{4}}{_AFTER}"
#: Between two groups of a number: the next one does not begin another value.
_GAP = rf"[ -](?!{_PART}{_AFTER})"
_UNSPACED = r"[0-9]{13,19}(?![0-9])"
_FOURS = rf"{_FOUR}(?:{_GAP}{_FOUR}){{3}}"
_SIXES = rf"[0-9]{{4}}{_GAP}[0-9]{{6}}{_GAP}[0-9]{{4,5}}(?![0-9])"
#: Card numbers without separators or in their usual groups, wherever they stand.
CLOSED = rf"(?:{_UNSPACED}|{_FOURS}|{_SIXES})"
#: Groups of four are cards where they come in fours; the last may have three more digits.
_CARDS = (
    r"(?:(?<!(?<![0-9])[0-9]{4}[ -])|(?<=\G[ -]))"
    rf"(?={_FOURS}(?:(?:{_GAP}{_FOUR}){{4}})*+(?!{_GAP}{_FOUR})){_FOURS}"
)
_LOCAL = (
    rf"(?:\([0-9]{{3}}\) ?[0-9]{{3}}-[0-9]{{4}}"
    rf"|[0-9]{{3}}[ .-][0-9]{{3}}[ .-](?!{_DAY}{_AFTER})[0-9]{{4}})"
)
_KNOWN = rf"(?:{_PART}|{_LOCAL}|{_UNSPACED}|{_CARDS}|{_SIXES}){_AFTER}"
CARD = rf"(?:{_UNSPACED}|{_CARDS}(?:[ -](?!{_KNOWN})[0-9]{{3}}(?![0-9]))?|{_SIXES})"
#: Digits in other groups, all that follow one another up to the next value.
_LOOSE = (
    r"(?:(?<![0-9][ -])|(?<=\G[ -]))(?=[0-9](?:[ -]?[0-9]){12})"
    rf"[0-9]++(?:[ -](?!{_KNOWN})[0-9]++{_AFTER})++"
)
NUMBER = f"(?:{CARD}|{_LOOSE})"
#: Country codes whose national numbers are of one length, by that length.
NATIONAL = {
    8: "45|47|65|37[0134]|38[27]|35[67]|85[23]|96[58]|97[3-6]|993",
    9: "27|31|33|34|40|41|48|56|61|93|94|351|380|42[01]|886|966|992|99[4568]",
    10: "1|7|30|44|52|57|58|90|91|98",
}
#: What a number with a country code begins with, by the plan of country codes.
COUNTRY = (
    r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
)
_NEXT = (
    rf"(?![ .-](?:{_PART}|[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}|{_UNSPACED}|{_FOURS}(?!{_GAP}{_FOUR})"
    rf"|{_SIXES}){_AFTER})"
)
_FIXED = "|".join(
    rf"\+(?:{codes})(?:{_NEXT}[ .-]?\(?[0-9]\)?){{{length}}}(?![0-9])"
    for length, codes in NATIONAL.items()
)
_ANY = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})"
#: Where the length is fixed, so many digits; else up to a decimal or another value, or,
#: where that leaves too little, as far as groups go.
PHONE = (
    rf"(?:{_FIXED}|{_ANY}(?:{_NEXT}(?! [0-9]{{2,4}}\.[0-9])[ .-]?[0-9]{{2,4}}){{2,4}}"
    rf"|{_ANY}(?:[ .-]?[0-9]{{2,4}}){{2,4}}|{_LOCAL})"
)
_PLACED = "|".join([IBAN, SECRET, DATE, SOCIAL, ADDRESS, PHONE, NUMBER])
FINDING = rf"{MAIL}|{_BEFORE}(?<!\+)(?:{_PLACED}){_AFTER}"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _mod(value: Column, radix: Column) -> Column:
    return F.pmod(value, radix).cast("int")


def permuted(values: Column, radices: Column, kind: str, key: str, back: bool = False) -> Column:
    """An array of digits of the given radices, permuted among all such arrays.

    A round adds to one half of the digits a keyed hash of the other half, digit by
    digit and each modulo its radix, and swaps the halves. ``back`` undoes the rounds.
    """
    state = "struct<l:array<int>,r:array<int>,ml:array<int>,mr:array<int>>"

    def added(to: Column, radix: Column, by: Column, i: Column) -> Column:
        said = F.concat_ws(":", F.lit(key), F.lit(kind), i.cast("string"), F.array_join(by, ","))

        def shift(h: Column, j: Column) -> Column:
            four = F.substr(h, (j % 32) * 4 + 1, F.lit(4))
            value = F.conv(four, 16, 10).cast("int")
            return -value if back else value

        return _let(
            F.sha2(said, 512),
            lambda h: F.transform(to, lambda x, j: _mod(x + shift(h, j), F.get(radix, j))),
        )

    def step(a: Column, i: Column) -> Column:
        if back:
            parts = (added(a.r, a.mr, a.l, i), a.l, a.mr, a.ml)
        else:
            parts = (a.r, added(a.l, a.ml, a.r, i), a.mr, a.ml)
        names = ("l", "r", "ml", "mr")
        fields = [part.alias(name) for part, name in zip(parts, names, strict=True)]
        return F.struct(*fields).cast(state)

    half = F.floor(F.size(values) / 2).cast("int")
    rest = F.size(values) - half
    start = F.struct(
        F.slice(values, F.lit(1), half).alias("l"),
        F.slice(values, half + 1, rest).alias("r"),
        F.slice(radices, F.lit(1), half).alias("ml"),
        F.slice(radices, half + 1, rest).alias("mr"),
    ).cast(state)
    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    rounds = F.array(*(F.lit(i) for i in order))
    return F.aggregate(rounds, start, step, lambda a: F.concat(a.l, a.r))


def _chars(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))
    )


def _first_code(c: Column) -> Column:
    """The code of a character's alphabet: digits, capitals, small letters, or itself."""
    return (
        F.when(c.rlike("[0-9]"), F.lit(48))
        .when(c.rlike("[A-Z]"), F.lit(65))
        .when(c.rlike("[a-z]"), F.lit(97))
    )


def _permuted_text(text: Column, kind: str, key: str, back: bool) -> Column:
    """ASCII digits and letters, each permuted within its alphabet; others stay."""
    radix = F.transform(
        _chars(text),
        lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1),
    )
    value = F.transform(
        _chars(text), lambda c: F.coalesce(F.ascii(c) - _first_code(c), F.lit(0))
    )
    return _let(
        permuted(value, radix, kind, key, back),
        lambda new: F.array_join(
            F.transform(
                _chars(text),
                lambda c, i: F.coalesce(F.char(_first_code(c) + F.get(new, i)), c),
            ),
            "",
        ),
    )


def _refilled(text: Column, kept: str, new: Column) -> Column:
    """``text`` with its characters of the class ``kept`` replaced by those of ``new``."""
    before = lambda i: F.length(
        F.regexp_replace(F.substr(text, F.lit(1), i + 1), f"[^{kept}]", "")
    )
    return F.array_join(
        F.transform(
            _chars(text),
            lambda c, i: F.when(c.rlike(f"[{kept}]"), F.substr(new, before(i), F.lit(1))).otherwise(
                c
            ),
        ),
        "",
    )


def _only(text: Column, kept: str) -> Column:
    return F.regexp_replace(text, f"[^{kept}]", "")


def _check_digit(payload: Column) -> Column:
    """The digit that makes payload and digit pass the mod-10 check of card numbers."""

    def weighed(c: Column, i: Column) -> Column:
        double = c.cast("int") * F.when((F.length(payload) - i) % 2 == 1, 2).otherwise(1)
        return F.when(double > 9, double - 9).otherwise(double)

    total = F.aggregate(F.transform(_chars(payload), weighed), F.lit(0), lambda a, x: a + x)
    return _mod(-total, F.lit(10))


#: Steps within which a value that has to keep a property meets another that has it.
_WALK = 24


def _passes(digits: Column) -> Column:
    payload = F.substr(digits, F.lit(1), F.length(digits) - 1)
    return F.substr(digits, F.length(digits), F.lit(1)).cast("int") == _check_digit(payload)


def _row_passes(text: Column) -> Column:
    """Whether all digits of a row of groups are one number that passes the check."""
    return _let(_only(text, "0-9"), lambda d: F.length(d).between(13, 19) & _passes(d))


def _spans(text: Column) -> Column:
    """Where numbers stand in a row of groups, as (at, n) of characters: all that pass the
    check in a usual grouping, else the row if it passes, else a card in its usual groups."""
    span = "array<struct<at:int,n:int>>"

    def starting(i: Column) -> Column:
        rest = F.substr(text, i, F.length(text))
        number = F.regexp_extract(rest, f"^{CLOSED}", 0)
        return _let(
            number,
            lambda w: F.struct(
                i.alias("at"),
                F.when(_passes(_only(w, "0-9")), F.length(w)).otherwise(0).alias("n"),
            ),
        )

    def apart(held: Column, x: Column) -> Column:
        last = F.get(held, F.size(held) - 1)
        return F.when(
            (F.size(held) == 0) | (x.at >= last.at + last.n), F.array_append(held, x)
        ).otherwise(held)

    starts = F.filter(
        F.sequence(F.lit(1), F.length(text)),
        lambda i: F.regexp_extract(F.substr(text, i, F.length(text)), f"^{CLOSED}", 0) != "",
    )
    starts = F.filter(
        starts, lambda i: (i == 1) | ~F.substr(text, i - 1, F.lit(1)).rlike("[0-9]")
    )
    passing = F.filter(F.transform(starts, starting), lambda x: x.n > 0)
    first = F.regexp_extract(text, f"^{CLOSED}", 0)
    none = F.array().cast(span)

    def whole(n: Column) -> Column:
        return F.array(F.struct(F.lit(1).alias("at"), n.alias("n"))).cast(span)

    return _let(
        F.aggregate(passing.cast(span), none, apart),
        lambda found: F.when(F.size(found) > 0, found)
        .when(_row_passes(text), whole(F.length(text)))
        .when(text.rlike(f"^{CARD}$"), whole(F.length(first)))
        .otherwise(none),
    )


def _renumbered(text: Column, key: str, back: bool) -> Column:
    digits = _only(text, "0-9")
    payload = F.substr(digits, F.lit(1), F.length(digits) - 1)
    off = F.substr(digits, F.length(digits), F.lit(1)).cast("int") - _check_digit(payload)

    def renewed(new: Column) -> Column:
        last = _mod(_check_digit(new) + off, F.lit(10)).cast("string")
        return _refilled(text, "0-9", F.concat(new, last))

    return _let(_permuted_text(payload, "number", key, back), renewed)


def _number(text: Column, key: str, back: bool) -> Column:
    """The numbers in a row of groups. Where the pseudonyms would make others in the row
    pass the check, they are permuted on, so that the way back finds the same ones."""
    walked = "struct<t:string,done:boolean>"

    def moved(row: Column, spans: Column) -> Column:
        return F.aggregate(
            spans,
            row,
            lambda t, s: F.concat(
                F.substr(t, F.lit(1), s.at - 1),
                _renumbered(F.substr(t, s.at, s.n), key, back),
                F.substr(t, s.at + s.n, F.length(t)),
            ),
        )

    def walk(spans: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            ended = _let(
                moved(state.t, spans),
                lambda t: F.struct(t.alias("t"), (_spans(t) == spans).alias("done")),
            )
            return F.when(state.done, state).otherwise(ended).cast(walked)

        begin = F.struct(text.alias("t"), F.lit(False).alias("done")).cast(walked)
        steps = F.sequence(F.lit(1), F.lit(_WALK))
        return F.when(F.size(spans) > 0, F.aggregate(steps, begin, step, lambda s: s.t))

    return _let(_spans(text), walk)


def _phone(text: Column, key: str, back: bool) -> Column:
    """The national number, or all of a number without a country code."""
    digits = _only(text, "0-9")
    code = F.when(text.startswith("+"), F.length(F.regexp_extract(digits, COUNTRY, 0))).otherwise(0)
    prefix = F.substr(digits, F.lit(1), code)
    national = F.substr(digits, code + 1, F.length(digits) - code)
    new = _permuted_text(national, "phone", key, back)
    return _let(F.concat(prefix, new), lambda all_: _refilled(text, "0-9", all_))


def _remainder(text: Column) -> Column:
    """The number that digits and letters (A is 10) spell, modulo 97."""
    return F.aggregate(
        _chars(text),
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97)
        .otherwise((a * 100 + F.ascii(c) - 55) % 97)
        .cast("int"),
    )


def _iban(text: Column, key: str, back: bool) -> Column:
    plain = _only(text, "A-Z0-9")
    country, own = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5), F.lit(30))
    valid = _remainder(F.concat(own, F.substr(plain, F.lit(1), F.lit(4)))) == 1

    def renewed(new: Column) -> Column:
        check = F.lit(98) - _remainder(F.concat(new, country, F.lit("00")))
        whole = F.concat(country, F.lpad(check.cast("string"), 2, "0"), new)
        return _refilled(text, "A-Z0-9", whole)

    return F.when(valid, _let(_permuted_text(own, "iban", key, back), renewed))


def _secret(text: Column, key: str, back: bool) -> Column:
    value = F.transform(_chars(text), lambda c: F.conv(c, 16, 10).cast("int"))
    new = permuted(value, F.transform(value, lambda _: F.lit(16)), "secret", key, back)
    spelt = F.array_join(F.transform(new, lambda x: F.hex(x)), "")
    return F.when(text.rlike("[a-f]"), F.lower(spelt)).otherwise(spelt)


def _address(text: Column, key: str, back: bool) -> Column:
    parts = F.split(text, r"\.")
    valid = F.forall(parts, lambda p: (p.cast("int") <= 255) & ~p.rlike("^0[0-9]"))
    radices = F.array(*(F.lit(256) for _ in range(4)))
    new = permuted(parts.cast("array<int>"), radices, "address", key, back)
    return F.when(valid, F.array_join(new, "."))


def _social(text: Column, key: str, back: bool) -> Column:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001."""
    area, group, serial = (F.get(F.split(text, "-"), i).cast("int") for i in range(3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    values = F.array(place, group - 1, serial - 1)
    new = permuted(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), "social", key, back)

    def spelt(n: Column) -> Column:
        back_area = F.when(F.get(n, 0) >= 665, F.get(n, 0) + 2).otherwise(F.get(n, 0) + 1)
        return F.format_string(
            "%03d-%02d-%04d", back_area.cast("int"), F.get(n, 1) + 1, F.get(n, 2) + 1
        )

    return F.when(valid, _let(new, spelt))


def _date(text: Column, key: str, back: bool) -> Column:
    """A day is permuted among the days of its century. They are 36525 = 75 * 487 in a
    century that begins with a leap year, else 36524 = 92 * 397, so a day is two digits of
    these radices and no day falls outside. Of two readings the day comes first; a date
    that can only be read month first walks on to the next such date."""
    iso = text.rlike("^[0-9]{4}-")
    mark = F.substr(text, F.lit(3), F.lit(1))
    a, b = F.substr(text, F.lit(1), F.lit(2)), F.substr(text, F.lit(4), F.lit(2))
    year = F.when(iso, F.substr(text, F.lit(1), F.lit(4))).otherwise(
        F.substr(text, F.lit(7), F.lit(4))
    )
    month_first = ~iso & (b.cast("int") > 12)
    spelt = (
        F.when(iso, text)
        .when(month_first, F.concat_ws("-", year, a, b))
        .otherwise(F.concat_ws("-", year, b, a))
    )
    day = F.try_to_timestamp(spelt, F.lit("yyyy-MM-dd")).cast("date")
    century = F.floor(year.cast("int") / 100).cast("int")
    start = F.make_date(century * 100, F.lit(1), F.lit(1))
    large = F.when(century % 4 == 0, 75).otherwise(92)
    small = F.when(century % 4 == 0, 487).otherwise(397)
    count = F.datediff(day, start)

    def at(n: Column) -> Column:
        return F.date_add(start, (F.get(n, 0) * small + F.get(n, 1)).cast("int"))

    def step(state: Column, _: Column) -> Column:
        moved = permuted(state.n, F.array(large, small), "date", key, back)
        ended = _let(moved, lambda n: F.struct(n.alias("n"), (F.day(at(n)) > 12).alias("done")))
        return F.when(state.done, state).otherwise(ended).cast(walked)

    walked = "struct<n:array<int>,done:boolean>"
    values = F.array(F.floor(count / small).cast("int"), (count % small).cast("int"))
    begin = F.struct(values.alias("n"), F.lit(False).alias("done")).cast(walked)
    steps = F.sequence(F.lit(1), F.when(month_first, _WALK).otherwise(1))

    def written(n: Column) -> Column:
        y, m, d = (F.date_format(at(n), part) for part in ("yyyy", "MM", "dd"))
        return (
            F.when(iso, F.concat_ws("-", y, m, d))
            .when(month_first, F.concat(m, mark, d, mark, y))
            .otherwise(F.concat(d, mark, m, mark, y))
        )

    valid = day.isNotNull() & (year.cast("int") >= 1000)
    return F.when(valid, _let(F.aggregate(steps, begin, step, lambda s: s.n), written))


def _mail(text: Column, key: str, back: bool) -> Column:
    local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    return F.concat(_permuted_text(local, "mail", key, back), F.lit("@"), domain)


_KINDS = (
    ("@", _mail),
    (f"^{IBAN}$", _iban),
    (f"^{SECRET}$", _secret),
    (f"^{DATE}$", _date),
    (f"^{SOCIAL}$", _social),
    (f"^{ADDRESS}$", _address),
    (f"^{PHONE}$", _phone),
    (f"^{NUMBER}$", _number),
)


def session_key(spark: SparkSession) -> str:
    """The session's secret key; without one, the public key, with a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        log.warning("%s is not set, pseudonyms are made with a public key", KEY_SETTING)
    return key or KEY


def pseudonym(finding: Column, key: str = KEY, back: bool = False) -> Column:
    """The pseudonym of one finding; what fails the checks of its kind stays."""
    first, rest = _KINDS[0], _KINDS[1:]
    new = F.when(finding.rlike(first[0]), first[1](finding, key, back))
    for pattern, transform in rest:
        new = new.when(finding.rlike(pattern), transform(finding, key, back))
    return F.coalesce(new, finding)


def pseudonymised(
    docs: DataFrame, column: str = "text", key: str | None = None, back: bool = False
) -> DataFrame:
    """The table with every finding in ``column`` replaced by its pseudonym, or, with
    ``back``, every pseudonym by what it stands for. The key is the session's unless one
    is given."""
    key = key or session_key(docs.sparkSession)
    text = F.col(column)
    found = F.array_append(F.regexp_extract_all(text, F.lit(FINDING), F.lit(0)), F.lit(""))

    def joined(parts: Column) -> Column:
        changed = F.zip_with(
            parts,
            found,
            lambda part, m: F.when(m == "", part).otherwise(
                F.concat(part, pseudonym(m, key, back))
            ),
        )
        return F.when(F.size(parts) == 1, text).otherwise(F.array_join(changed, ""))

    new = _let(F.split(text, FINDING, -1), joined)
    return docs.withColumn(column, F.when(text.rlike("[0-9@]"), new).otherwise(text))
