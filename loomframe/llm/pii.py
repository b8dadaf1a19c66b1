"""Format-preserving pseudonyms for personal data, with DataFrame expressions only.

Validated numbers (payment cards by their check digit, social security numbers, phone numbers,
IPv4 addresses), calendar dates and e-mail addresses are replaced by keyed Feistel permutations of
their own format: a card stays a card with a valid check digit, a date a date written alike. The
permutation depends on the key and the format only, so equal values keep one pseudonym in every
document, and different values of a format never share one.

The plan holds a subkey derived from the key, as a literal KEY_MARK and 64 hexadecimal digits: set
spark.sql.redaction.string.regex to that form to keep it out of event logs and shown plans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_MARK = "loomframe-pii:"

ROUNDS = 10
#: Days of the 400-year cycle of the calendar, from 1800-01-01: 27 * 5411 of them.
DAYS = (27, 5411)
FIRST_DAY = "1800-01-01"
#: Area and group numbers that are given out, and serial numbers.
SSN = (898 * 99, 9999)

# Possessive repeats where nothing is ever given back, and at most 127 labels in a domain: Java's
# matcher then takes no stack for the parts of a long dotted name.

# Patterns of candidates, in the order in which they are tried at one place.
EMAIL = r"[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,126}\.[A-Za-z]{2,}"
ADDRESS = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}"
ISO_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
SSN_TEXT = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
#: Kind, pattern and layout of dates, in the order in which they are read: day first where both are possible.
DATES = (
    ("date", ISO_DATE, "yyyy-MM-dd"),
    ("date/", r"[0-9]{2}/[0-9]{2}/[0-9]{4}", "dd/MM/yyyy"),
    ("date/month", r"[0-9]{2}/[0-9]{2}/[0-9]{4}", "MM/dd/yyyy"),
    ("date/short", r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "d/M/yyyy"),
    ("date/month short", r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "M/d/yyyy"),
    ("date/year", r"[0-9]{4}/[0-9]{2}/[0-9]{2}", "yyyy/MM/dd"),
    ("date/year short", r"[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}", "yyyy/M/d"),
    ("date.", r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}", "dd.MM.yyyy"),
)
#: Usual groupings of card numbers, and a run of numbers that is long enough to hold one.
CARD = r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}"
RUN = r"(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![0-9A-Za-z])(?:[ -][0-9]++(?![0-9A-Za-z]))*+"
_NO_CARD = r"(?![0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4}|[0-9]{13})"
_REST = rf"(?:[ .-]?{_NO_CARD}[0-9])"
PHONE = "|".join(
    [
        r"\+[0-9]{1,3} ?(?:\([0-9]{3}\)|[0-9]{3})[ -]?[0-9]{3}[ -]?[0-9]{4}",
        r"(?:\+?1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}",
        r"\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}",
        rf"\+[1-9][0-9]{{0,2}}{_REST}{{6,12}}",
        rf"\+[1-9][0-9]{{0,2}}[ .-]?\([0-9]{{1,4}}\){_REST}{{4,8}}",
        *[rf"(?:1{x})?[0-9]{{3}}{x}[0-9]{{3}}{x}[0-9]{{4}}" for x in ("-", r"\.", " ")],
        r"0[1-9](?:[ .-][0-9]{2}){4}",
        rf"{_NO_CARD}0[1-9][0-9]{{1,3}}[ /-](?:[0-9]{{3,4}}[ -][0-9]{{3,4}}|[0-9]{{5,8}})",
        r"\(0[1-9][0-9]{0,3}\) ?(?:[0-9]{3,4}[ -][0-9]{3,4}|[0-9]{5,8})",
    ]
)
ANY = "|".join(
    [
        rf"(?<![A-Za-z0-9_%+.@-])(?:{EMAIL})",
        rf"(?<![0-9A-Za-z.])(?:{ADDRESS})(?![0-9A-Za-z]|\.[0-9])",
        rf"(?<![0-9A-Za-z./-])(?:{'|'.join(pattern for _, pattern, _ in DATES)}|{SSN_TEXT})(?![0-9A-Za-z/-])",
        rf"(?<![0-9A-Za-z+-])(?:{PHONE})(?![0-9A-Za-z-])",
        rf"(?<![0-9A-Za-z+-])(?:{RUN})",
    ]
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _subkey(key: str) -> str:
    if not key:
        raise ValueError("pseudonyms need a key")
    return KEY_MARK + hashlib.sha256(b"pseudonyms\0" + key.encode()).hexdigest()


def _prf(key: str, *parts: Column) -> Column:
    """64 hexadecimal digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def _number(digest: Column) -> Column:
    """60 of its bits."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel_number(value: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """value in [0, a * b) through a permutation of that range: the two digits of its mixed-radix
    form are shifted in turn by a keyed hash of the other."""
    a, b = sizes
    start = F.struct(F.floor(value / F.lit(b)).cast("long").alias("l"), F.pmod(value, F.lit(b)).cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        by_r = _number(_prf(key, F.lit(kind), i.cast("string"), s["r"].cast("string")))
        by_l = _number(_prf(key, F.lit(kind), i.cast("string"), s["l"].cast("string")))
        return F.when(
            i % 2 == 1, F.struct(F.pmod(s["l"] + by_r, F.lit(a)).cast("long").alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + by_l, F.lit(b)).cast("long").alias("r")))

    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, start, turn, lambda s: s["l"] * F.lit(b) + s["r"])


def _shifted(text: Column, digest: Column) -> Column:
    """Each digit and ASCII letter moved within its own kind by the digest's bytes; others stay."""

    def move(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(digest, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        wheel = lambda first, n: F.char(F.lit(first) + F.pmod(F.ascii(c) - first + by, F.lit(n)))
        return (
            F.when(c.between("0", "9"), wheel(48, 10))
            .when(c.between("a", "z"), wheel(97, 26))
            .when(c.between("A", "Z"), wheel(65, 26))
            .otherwise(c)
        )

    parts = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(parts, move), "")


def feistel_text(text: Column, key: str, kind: str) -> Column:
    """text through a permutation of the texts of its form (where digits, small and capital letters
    and all other characters stand): halves are shifted in turn by a keyed hash of the other."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        by = lambda side: _prf(key, F.lit(kind), i.cast("string"), s[side])
        left, right = bound(by("r"), lambda d: _shifted(s["l"], d)), bound(by("l"), lambda d: _shifted(s["r"], d))
        return F.when(i % 2 == 1, F.struct(left.alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), right.alias("r"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Of digits from the right; those at even places (doubled 0) or odd ones (1) count twice."""
    places = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.when(
            i % 2 == doubled, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
        ).otherwise(c.cast("int")),
    )
    return F.aggregate(places, F.lit(0), lambda a, x: a + x)


def laid_out(form: Column, digits: Column) -> Column:
    """form with its digits, in order, replaced by digits."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
    chars = F.filter(F.split(form, ""), lambda c: c != "")
    return F.aggregate(
        chars,
        start,
        lambda s, c: F.when(
            c.between("0", "9"),
            F.struct(F.concat(s["out"], F.substr(digits, s["next"], F.lit(1))).alias("out"), (s["next"] + 1).alias("next")),
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["next"].alias("next"))),
        lambda s: s["out"],
    )


def _card(m: Column, key: str) -> Column:
    digits = digits_of(m)
    payload = feistel_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.pmod(10 - luhn_sum(payload, 0) % 10, F.lit(10)).cast("string")
    return laid_out(m, F.concat(payload, check))


def _joined(groups: Column, start: Column, end: Column) -> Column:
    """Groups from place start, before place end. Not by slice(), which copies the whole array."""
    places = F.when(start < end, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: F.element_at(groups, i)), "")


def _cards(groups: Column) -> Column:
    """place and number of the groups of each card in a run of numbers. A number counts as a card in a
    usual grouping wherever in the run it starts; in any other grouping as the longest one from the
    run's start, or from the end of the last such try, that does not reach into one of the former."""
    text = lambda i, n: _joined(groups, i, i + n)
    valid = lambda t: luhn_sum(digits_of(t), 1) % 10 == 0

    def usual(sizes: Column, i: Column) -> Column:
        """The fewest groups from i that are a card in a usual grouping."""
        shaped = lambda t: F.regexp_like(F.regexp_replace(t, "[ -]$", ""), F.lit(f"^(?:{CARD})$"))
        to_end = F.sequence(F.lit(1), F.least(F.lit(5), F.size(groups) - i + 1))
        found = F.filter(to_end, lambda n: bound(text(i, n), lambda t: shaped(t) & valid(t)))
        first = F.element_at(sizes, i)
        return F.when((first == 4) | (first >= 13), F.get(found, F.lit(0)))

    def other(sizes: Column, i: Column) -> Column:
        """The most groups from i that hold 13 to 19 digits; 0 if none do."""
        step = lambda s, n: bound(
            s["sum"] + F.get(sizes, i + n - 2), lambda sum: F.struct(sum.alias("sum"), F.when(sum.between(13, 19), n).otherwise(s["n"]).alias("n"))
        )
        to_end = F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i + 1))
        return F.aggregate(to_end, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")), step, lambda s: s["n"])

    def walk(seen: Column) -> Column:
        def turn(s: Column, i: Column) -> Column:
            """at: the next group to read; tried: the next one that may start another grouping."""
            n, long = F.element_at(seen, i)["usual"], F.element_at(seen, i)["other"]
            card = lambda n: F.concat(s["cards"], F.array(F.struct(i.alias("i"), n.cast("int").alias("n"))))
            state = lambda cards, at, tried: F.struct(cards.alias("cards"), at.alias("at"), tried.alias("tried"))
            clear = ~F.exists(F.sequence(i, i + long - 1), lambda j: F.element_at(seen, j)["usual"].isNotNull())
            return (
                F.when(s["at"] > i, s)
                .when(n.isNotNull(), state(card(n), i + n, i + n))
                .when((s["tried"] <= i) & (long > 0) & clear & valid(text(i, long)), state(card(long), i + long, i + long))
                .otherwise(state(s["cards"], i + 1, F.when(s["tried"] <= i, i + F.greatest(long, F.lit(1))).otherwise(s["tried"])))
            )

        start = F.struct(F.array().cast("array<struct<i:int,n:int>>").alias("cards"), F.lit(1).alias("at"), F.lit(1).alias("tried"))
        return F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, turn, lambda s: s["cards"])

    def look(sizes: Column) -> Column:
        each = lambda i: F.struct(usual(sizes, i).alias("usual"), other(sizes, i).alias("other"))
        return bound(F.transform(F.sequence(F.lit(1), F.size(groups)), each), walk)

    return bound(F.transform(groups, lambda g: F.length(F.rtrim(g, F.lit(" -")))), look)


def _with_cards(m: Column, key: str) -> Column:
    """out and n: a run of numbers with pseudonyms for its n cards."""

    def put(groups: Column, cards: Column) -> Column:
        def piece(c: Column, k: Column) -> Column:
            last = F.get(cards, k - 1)
            before = _joined(groups, F.coalesce(last["i"] + last["n"], F.lit(1)), c["i"])
            return F.concat(before, bound(_joined(groups, c["i"], c["i"] + c["n"]), lambda m: _card(m, key)))

        last = F.get(cards, F.size(cards) - 1)
        rest = _joined(groups, F.coalesce(last["i"] + last["n"], F.lit(1)), F.size(groups) + 1)
        return F.struct(F.concat(F.array_join(F.transform(cards, piece), ""), rest).alias("out"), F.size(cards).alias("n"))

    groups = F.regexp_extract_all(m, F.lit("[0-9]+[ -]?"), F.lit(0))
    return bound(groups, lambda g: bound(_cards(g), lambda c: put(g, c)))


def _day(m: Column, parse: str) -> Column:
    """Its number in the cycle; null if there is no such day."""
    day = F.date_diff(F.try_to_date(m, parse), F.lit(FIRST_DAY).cast("date"))
    return F.when((day >= 0) & (day < DAYS[0] * DAYS[1]), day.cast("long"))


def _date(m: Column, kind: str, parse: str, key: str) -> Column:
    """In its own layout. A month-first date that cannot be read day first stays such a one: the
    permutation is applied until it gives one, of which three in five days are."""
    other = lambda day: feistel_number(day, DAYS, key, "date")
    date = lambda day: F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int"))
    if "month" not in kind:
        return F.date_format(date(other(_day(m, parse))), parse)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        _day(m, parse),
        lambda day, i: F.when((i > 1) & (F.dayofmonth(date(day)) > 12), day).otherwise(other(day)),
    )
    return F.date_format(date(walked), parse)


def _address(m: Column, key: str) -> Column:
    parts = F.split(m, r"\.")
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    other = feistel_number(value, (65536, 65536), key, "ipv4")
    return F.concat_ws(".", *[F.pmod(F.shiftright(other, n), F.lit(256)).cast("string") for n in (24, 16, 8, 0)])


def _ssn(m: Column, key: str) -> Column:
    """Null if the number cannot have been given out."""
    area, two, four = (F.split(m, "-")[i].cast("int") for i in range(3))
    given = (area > 0) & (area != 666) & (area < 900) & (two > 0) & (four > 0)
    place = area - F.when(area > 666, 2).otherwise(1)
    value = ((place * 99 + two - 1).cast("long") * 9999) + four - 1
    other = feistel_number(value, SSN, key, "ssn")
    back = F.floor(other / (99 * 9999)).cast("int")
    area_back = F.when(back >= 665, back + 2).otherwise(back + 1)
    two_back = F.pmod(F.floor(other / 9999), F.lit(99)) + 1
    return F.when(
        given,
        F.concat_ws(
            "-",
            F.lpad(area_back.cast("string"), 3, "0"),
            F.lpad(two_back.cast("string"), 2, "0"),
            F.lpad((F.pmod(other, F.lit(9999)) + 1).cast("string"), 4, "0"),
        ),
    )


def kind_of(m: Column) -> Column:
    """What a candidate is, once validated; null if it is none. A run of numbers is card, whether or
    not pseudonym() finds one in it."""
    whole = lambda pattern: F.regexp_like(m, F.lit(f"^(?:{pattern})$"))
    kind = F.when(F.contains(m, F.lit("@")), "email").when(whole(ADDRESS), "ipv4")
    for name, pattern, parse in DATES:
        kind = kind.when(whole(pattern) & _day(m, parse).isNotNull(), name)
    return (
        kind.when(whole(SSN_TEXT) & _ssn(m, "").isNotNull(), "ssn")
        .when(whole(PHONE), "phone")
        .when(whole(RUN), "card")
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """out and n: m with pseudonyms, and how many."""
    head = F.regexp_extract(m, r"^(\+[0-9]{1,3}|)", 1)
    tail = F.regexp_extract(m, r"(\.[A-Za-z]+)$", 1)
    other = F.when(kind == "email", F.concat(feistel_text(F.substr(m, F.lit(1), F.length(m) - F.length(tail)), key, "email"), tail))
    for name, _, parse in DATES:
        other = other.when(kind == name, _date(m, name, parse, key))
    other = (
        other.when(kind == "ipv4", _address(m, key))
        .when(kind == "ssn", _ssn(m, key))
        .when(
            kind == "phone",
            F.concat(head, laid_out(F.substr(m, F.length(head) + 1), feistel_text(digits_of(F.substr(m, F.length(head) + 1)), key, "phone"))),
        )
        .otherwise(m)
    )
    return F.when(kind == "card", _with_cards(m, key)).otherwise(F.struct(other.alias("out"), kind.isNotNull().cast("int").alias("n")))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs' doc_id, text with pseudonyms, n_replaced and kinds (distinct, sorted, comma-joined) of
    every row.

    key is a secret of the caller's: whoever has it can undo the pseudonyms. An empty one raises.

    A candidate that fails validation stays as it is, as does all other text. A null text stays
    null with nothing replaced. Dates with slashes are read as day, month, year if there is such a
    day, else as month, day, year. Rows are treated each
    by itself: no shuffle, and copies and repeated rows come out alike. Columns other than doc_id
    and text are ignored.
    """
    from loomframe.llm._common import columns_of

    key = _subkey(key)
    rows = columns_of(docs, "doc_id", "text")
    text = F.col("text")
    # A quick look first: every candidate holds an @ or five digits with little between them.
    maybe = F.regexp_like(text, F.lit(r"@|[0-9](?:[^0-9A-Za-z]{0,2}[0-9]){3}")) & F.regexp_like(text, F.lit(ANY))
    found = F.when(
        maybe,
        F.transform(
            F.arrays_zip(
                F.split(text, ANY, -1).alias("before"),
                F.transform(
                    F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))
                ).alias("match"),
            ),
            lambda x: F.struct(
                x["match"]["kind"].alias("kind"),
                x["before"].alias("before"),
                F.when(x["match"].isNotNull(), pseudonym(x["match"]["m"], x["match"]["kind"], key)).alias("new"),
            ),
        ),
    )
    parts = rows.withColumn("parts", found)
    kinds = F.transform(F.filter("parts", lambda p: p["new"]["n"] > 0), lambda p: p["kind"])
    return parts.select(
        "doc_id",
        F.when(F.col("parts").isNull(), text).otherwise(F.array_join(F.transform("parts", lambda p: F.concat(p["before"], F.coalesce(p["new"]["out"], F.lit("")))), "")).alias("text"),
        F.coalesce(F.aggregate("parts", F.lit(0), lambda n, p: n + F.coalesce(p["new"]["n"], F.lit(0))), F.lit(0)).cast("long").alias("n_replaced"),
        F.coalesce(
            F.array_join(F.array_sort(F.array_distinct(F.transform(kinds, lambda k: F.regexp_replace(k, "[./].*", "")))), ","), F.lit("")
        ).alias("kinds"),
    )
