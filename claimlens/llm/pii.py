"""Format-preserving pseudonyms: personal numbers, dates and addresses are permuted by a keyed Feistel network.

Everything is a column expression. One pattern finds candidates, the rule of each kind validates them
(Luhn, IBAN remainder, octet range, calendar, area and group numbers, number of digits), and a valid one
is replaced by a keyed permutation of the values of its own format. What is not valid stays as it is.
The permutation depends on the key and the value alone, so equal values stay linked across documents,
different values stay different, and the holder of the key can restore the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# Turns of the permutation after which a run of numbers that still reads otherwise is left as it came out.
WALK = 64

# Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MN MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """An IBAN as long as its country says; of an unknown country, as long as no IBAN of a known one begins."""
    groups = {n: f"(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n in IBAN_LENGTHS}
    known = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}{groups[n]}(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
    codes = "|".join(" ".join(IBAN_LENGTHS.values()).split())
    other = f"(?!{codes})[A-Z]{{2}}[0-9]{{2}}(?:(?: (?!{known}))?[A-Z0-9]{{4}}){{2,7}}(?:(?: (?!{known}))?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9])"
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{known}|{other})"


# The formats looked for, in the order in which they are tried at one place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": _iban_pattern(),
    "date": r"(?<![0-9-])(?:18|19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "day_first": r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.(?:18|19|20)[0-9]{2}(?![0-9]|\.[0-9])",
    "month_first": r"(?<![0-9/])[0-9]{2}/[0-9]{2}/(?:18|19|20)[0-9]{2}(?![0-9/])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])",
}
# A run of numbers with 13 digits or more may hold cards beside other numbers; it ends before a value of another kind.
_OTHERS = "|".join(PATTERNS[kind] for kind in ("date", "day_first", "month_first", "ssn", "ip"))
_RUN = rf"(?<![0-9A-Za-z])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?![A-Za-z])(?:(?: (?!{_OTHERS})|-)[0-9]++(?![A-Za-z]))*+"
PATTERNS = {**{k: v for k, v in PATTERNS.items() if k != "phone"}, "card": _RUN, "phone": PATTERNS["phone"]}
FOUND = "|".join(PATTERNS.values())

# Date formats, the first day of the range inside which dates are permuted, and its
# 109,572 days (to 2099-12-31) as a product; valid social security areas (898), groups and serials.
DATE_FORMATS = {"date": "yyyy-MM-dd", "day_first": "dd.MM.yyyy", "month_first": "MM/dd/yyyy"}
FIRST_DAY, DAY_LOW, DAY_HIGH = "1800-01-01", 276, 397
SSN_LOW, SSN_HIGH = 898 * 99, 9999


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _keyed(key: str, kind: str, *parts: Column) -> Column:
    """A keyed 48-bit number of the parts."""
    text = F.concat_ws("|", F.lit(f"{key}|{kind}"), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def _rounds(back: bool) -> Column:
    return F.array(*[F.lit(n) for n in (reversed(range(ROUNDS)) if back else range(ROUNDS))])


def permuted_number(value: Column, low: int, high: int, key: str, kind: str, back: bool = False) -> Column:
    """Feistel permutation of 0 … low*high-1: quotient and remainder by ``high`` take turns."""
    sign = -1 if back else 1

    def turn(s: Column, n: Column) -> Column:
        left = F.when(n % 2 == 0, F.pmod(s["l"] + sign * _keyed(key, kind, n, s["r"]), F.lit(low))).otherwise(s["l"])
        right = F.when(n % 2 == 1, F.pmod(s["r"] + sign * _keyed(key, kind, n, s["l"]), F.lit(high))).otherwise(s["r"])
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    first = F.struct(F.floor(value / high).cast("long").alias("l"), F.pmod(value, F.lit(high)).cast("long").alias("r"))
    return F.aggregate(_rounds(back), first, turn, lambda s: s["l"] * high + s["r"])


def _shifted(half: Column, other: Column, n: Column, key: str, kind: str, sign: int) -> Column:
    """Each digit and letter of ``half`` moved within its alphabet by a keyed number of the other half."""

    def move(c: Column, i: Column) -> Column:
        h = sign * _keyed(key, kind, n, i, F.length(half), other)
        code = F.ascii(c)

        def around(first: int, size: int) -> Column:
            return F.char((F.lit(first) + F.pmod(code - first + h, F.lit(size))).cast("long"))

        return (
            F.when(code.between(48, 57), around(48, 10)).when(code.between(65, 90), around(65, 26)).when(code.between(97, 122), around(97, 26)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(half, ""), move), "")


def permuted_string(value: Column, key: str, kind: str, back: bool = False) -> Column:
    """Feistel permutation of the strings with the same pattern of digits, letters and other characters."""
    sign = -1 if back else 1

    def turn(s: Column, n: Column) -> Column:
        return F.struct(
            F.when(n % 2 == 0, _shifted(s["l"], s["r"], n, key, kind, sign)).otherwise(s["l"]).alias("l"),
            F.when(n % 2 == 1, _shifted(s["r"], s["l"], n, key, kind, sign)).otherwise(s["r"]).alias("r"),
        )

    middle = F.floor(F.length(value) / 2).cast("int")
    first = F.struct(F.substring(value, F.lit(1), middle).alias("l"), F.substring(value, middle + 1, F.length(value)).alias("r"))
    return F.aggregate(_rounds(back), first, turn, lambda s: F.concat(s["l"], s["r"]))


def laid_out(template: Column, symbols: Column, fixed: str) -> Column:
    """The symbols put, in order, into the template's places that do not match ``fixed``."""

    def place(c: Column, i: Column) -> Column:
        index = F.length(F.regexp_replace(F.substring(template, F.lit(1), i + 1), fixed, ""))
        return F.when(c.rlike(fixed), c).otherwise(F.substring(symbols, index, F.lit(1)))

    return F.array_join(F.transform(F.split(template, ""), place), "")


def luhn_sum(number: Column) -> Column:
    """Luhn sum of a digit string, the last digit counting once."""

    def digit(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(number), ""), digit), F.lit(0), lambda a, x: a + x)


def remainder97(text: Column) -> Column:
    """The text modulo 97, letters read as 10 to 35."""

    def step(a: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        return F.when(letter, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + c.cast("int")) % 97).cast("int")

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _email(m: Column, key: str, back: bool) -> Column:
    return F.concat(permuted_string(F.substring_index(m, "@", 1), key, "email", back), F.lit("@"), F.substring_index(m, "@", -1))


def _iban(m: Column, key: str, back: bool) -> Column:
    plain = F.regexp_replace(m, " ", "")

    def rebuilt(account: Column) -> Column:
        check = F.lpad((98 - remainder97(F.concat(account, F.substring(plain, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        return F.concat(F.substring(plain, 1, 2), check, account)

    moved = once(permuted_string(F.substring(plain, F.lit(5), F.length(plain)), key, "iban", back), rebuilt)
    valid = (remainder97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1) & F.length(plain).between(15, 34)
    return F.when(valid, once(moved, lambda x: laid_out(m, x, " ")))


def _card(m: Column, key: str, back: bool) -> Column:
    number = digits(m)

    def checked(body: Column) -> Column:
        check = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10))
        return F.concat(body, check.cast("string"))

    body = F.substring(number, F.lit(1), F.length(number) - 1)
    moved = once(permuted_string(body, key, "card", back), checked)
    return F.when(luhn_sum(number) % 10 == 0, once(moved, lambda x: laid_out(m, x, "[^0-9]")))


def _card_spans(run: Column) -> Column:
    """First number (from 0) and count of numbers of the cards in a run: the whole run, else the likeliest lengths first."""

    def at(numbers: Column) -> Column:
        def span(i: Column, w: Column) -> Column:
            def ranked(x: Column) -> Column:
                n = F.length(x)
                rank = F.when(w == F.size(numbers), 0)
                for place, size in enumerate((16, 15, 14, 19, 18, 17, 13)):
                    rank = rank.when(n == size, place + 1)
                return F.when(n.between(13, 19), F.when(luhn_sum(x) % 10 == 0, rank))

            return F.struct(once(digits(F.array_join(F.slice(numbers, i + 1, w), "")), ranked).alias("rank"), i.alias("i"), w.alias("w"))

        def spans(_: Column, i: Column) -> Column:
            widths = F.sequence(F.lit(1), F.least(F.lit(19), F.size(numbers) - i))
            return F.filter(F.transform(widths, lambda w: span(i, w)), lambda x: x["rank"].isNotNull())

        def taken(chosen: Column, x: Column) -> Column:
            meets = F.exists(chosen, lambda c: (c["i"] < x["i"] + x["w"]) & (x["i"] < c["i"] + c["w"]))
            return F.when(meets, chosen).otherwise(F.concat(chosen, F.array(F.struct(x["i"].alias("i"), x["w"].alias("w")))))

        ranked = F.array_sort(F.flatten(F.transform(numbers, spans)))
        return F.array_sort(F.aggregate(ranked, F.array().cast("array<struct<i:int,w:int>>"), taken))

    return once(F.regexp_extract_all(run, F.lit("[0-9]+[ -]?"), 0), at)


def _run(m: Column, key: str, back: bool) -> Column:
    """A run of numbers with its cards, and phones between them, replaced; null if it holds none.

    If the new run would be read otherwise than the old one, because a digit has made another span valid, the
    permutation goes on until it is read alike, so the key restores it.
    """

    def phones(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(PATTERNS["phone"]), 0)
        rest = F.split(text, PATTERNS["phone"], -1)
        return F.array_join(F.zip_with(rest, found, lambda p, x: F.concat(p, F.coalesce(_phone(x, key, back), x, F.lit("")))), "")

    def turned(run: Column, spans: Column) -> Column:
        def at(numbers: Column) -> Column:
            def text(first: Column, n: Column) -> Column:
                return F.array_join(F.slice(numbers, first + 1, n), "")

            def add(s: Column, x: Column) -> Column:
                card = text(x["i"], x["w"])
                new = F.concat(s["text"], phones(text(s["at"], x["i"] - s["at"])), F.coalesce(_card(card, key, back), card))
                return F.struct(new.alias("text"), (x["i"] + x["w"]).alias("at"))

            first = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
            return F.aggregate(spans, first, add, lambda s: F.concat(s["text"], phones(text(s["at"], F.size(numbers) - s["at"]))))

        return once(F.regexp_extract_all(run, F.lit("[0-9]+[ -]?"), 0), at)

    def walked(spans: Column) -> Column:
        def go(s: Column, _: Column) -> Column:
            def read(new: Column) -> Column:
                return F.struct(new.alias("text"), (_card_spans(new) == spans).alias("done"))

            return F.when(s["done"], s).otherwise(once(turned(s["text"], spans), read))

        first = F.struct(m.alias("text"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, go, lambda s: s["text"])

    # a run without valid cards and phones comes back as it was
    return once(once(_card_spans(m), walked), lambda x: F.when(x != m, x))


def _run_values(run: Column) -> Column:
    """How many cards and phones a run holds."""

    def counted(spans: Column) -> Column:
        def at(numbers: Column) -> Column:
            def outside(i: Column) -> Column:
                return ~F.exists(spans, lambda c: (c["i"] <= i) & (i < c["i"] + c["w"]))

            rest = F.array_join(F.transform(numbers, lambda t, i: F.when(outside(i), t).otherwise("|")), "")
            return F.size(spans) + F.size(F.filter(F.regexp_extract_all(rest, F.lit(PATTERNS["phone"]), 0), lambda x: F.length(digits(x)) == 10))

        return once(F.regexp_extract_all(run, F.lit("[0-9]+[ -]?"), 0), at)

    return once(_card_spans(run), counted)


def _phone(m: Column, key: str, back: bool) -> Column:
    """The country code after a plus sign stays; all other digits are permuted."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    size = F.length(digits(m))
    valid = F.when(m.startswith("+"), size.between(8, 15)).otherwise(size == 10)
    return F.when(valid, F.concat(code, once(permuted_string(digits(rest), key, "phone", back), lambda x: laid_out(rest, x, "[^0-9]"))))


def _ip(m: Column, key: str, back: bool) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x)

    def dotted(n: Column) -> Column:
        return F.concat_ws(".", *[(F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)])

    plain = F.forall(F.split(m, r"\."), lambda x: (x.cast("int") <= 255) & ~x.rlike("^0[0-9]"))
    return F.when(plain, once(permuted_number(number, 65536, 65536, key, "ip", back), dotted))


def _ssn(m: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.substring(m, at, size).cast("int") for at, size in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - (area > 666).cast("int")
    number = ((place * 99 + group - 1).cast("long") * SSN_HIGH) + serial - 1

    def written(n: Column) -> Column:
        front = F.floor(n / SSN_HIGH)
        place = F.floor(front / 99)
        area = place + 1 + (place >= 665).cast("int")
        parts = ((area, 3), (front % 99 + 1, 2), (n % SSN_HIGH + 1, 4))
        return F.concat_ws("-", *[F.lpad(p.cast("long").cast("string"), size, "0") for p, size in parts])

    return F.when(valid, once(permuted_number(number, SSN_LOW, SSN_HIGH, key, "ssn", back), written))


def _date(kind: str) -> Callable[[Column, str, bool], Column]:
    def moved(m: Column, key: str, back: bool) -> Column:
        layout = F.lit(DATE_FORMATS[kind])
        day = F.try_to_timestamp(m, layout).cast("date")
        number = F.date_diff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
        there = permuted_number(number, DAY_LOW, DAY_HIGH, key, "date", back)
        return F.when(day.isNotNull(), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), there.cast("int")), DATE_FORMATS[kind]))

    return moved


RULES: dict[str, Callable[[Column, str, bool], Column]] = {
    "email": _email,
    "iban": _iban,
    **{kind: _date(kind) for kind in DATE_FORMATS},
    "ssn": _ssn,
    "ip": _ip,
    "card": _run,
    "phone": _phone,
}


def pseudonym(candidate: Column, key: str, back: bool = False) -> Column:
    """The replacement of one candidate, or null if it is not valid for its kind.

    The kind is the first whose pattern is the whole candidate, so a number that fails its check
    (a card without Luhn's digit) is not tried as another kind.
    """
    out = None
    for kind, rule in RULES.items():
        # the surroundings were tested when the candidate was found
        whole = candidate.rlike("^(?:" + PATTERNS[kind] + ")$")
        out = F.when(whole, rule(candidate, key, back)) if out is None else out.when(whole, rule(candidate, key, back))
    return out


def pseudonymised(docs: DataFrame, key: str, back: bool = False, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with valid personal values in ``text`` replaced, and their number added.

    Adds ``n_replaced``. ``back=True`` restores a text made with the same key. Null texts stay null with 0
    replaced; texts without candidates come back unchanged. A column named n_replaced is overwritten.
    No row is moved, so neither skew nor repeated values matter.
    """
    column = F.col(f"`{text}`")
    likely = column.rlike("[0-9@]")
    found = F.when(likely, F.regexp_extract_all(column, F.lit(FOUND), 0)).otherwise(F.array().cast("array<string>"))
    moved = F.transform(found, lambda m: F.struct(m.alias("old"), pseudonym(m, key, back).alias("new")))
    held = "__candidates__"
    while held.lower() in {c.lower() for c in docs.columns}:  # a caller's column keeps its name
        held += "_"
    marked = docs.withColumn(held, F.when(column.isNotNull(), moved))
    pieces = F.split(column, FOUND, -1)
    joined = F.array_join(
        F.zip_with(pieces, F.col(held), lambda p, x: F.concat(p, F.coalesce(x["new"], x["old"], F.lit("")))), ""
    )
    new = F.filter(held, lambda x: x["new"].isNotNull())
    number = F.transform(new, lambda x: F.when(x["old"].rlike("^(?:" + PATTERNS["card"] + ")$"), _run_values(x["old"])).otherwise(1))
    n = F.coalesce(F.aggregate(number, F.lit(0), lambda a, x: a + x), F.lit(0))
    changed = marked.withColumns({"n_replaced": F.when(F.col(held).isNull(), 0).otherwise(n), text: F.when(F.size(held) > 0, joined).otherwise(column)})
    return changed.drop(held)
