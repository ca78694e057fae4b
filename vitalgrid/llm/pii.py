"""Format-preserving pseudonyms for validated numbers, dates and addresses.

Every value becomes an array of digits with a radix each (a real phone number's
first area digit has radix 8, an IPv4 part radix 256, a calendar day the two
factors of the days of a 400-year cycle, ...). A keyed Feistel network adds to
each half, digit by digit, a hash of the other half: a permutation of all
values of that format, whatever their number. All of it is DataFrame
expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# Formats with their valid ranges, so that what matches is valid. NB: Java regular expressions, tried in
# this order.
EMAIL = "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\\.)+[A-Za-z]{2,}"
_YEAR = "(?:1[6-9]|2[0-3])"
_DAY = ("[0-9]{2}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|"
        "02-(?:0[1-9]|1[0-9]|2[0-8]))")
_LEAP_DAY = f"(?:{_YEAR}(?:0[48]|[2468][048]|[13579][26])|1600|2000)-02-29"
DATE = f"(?<![0-9A-Za-z-])(?:{_YEAR}{_DAY}|{_LEAP_DAY})(?![0-9A-Za-z-])"
SSN = "(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])"
# A country code or brackets make any area and exchange code certain; without them both start with 2 to 9.
_CERTAIN = "(?:(?:\\+?1[ .-]?)?\\([0-9]{3}\\) ?|(?:\\+1[ .-]?|1[ .-])[0-9]{3}[ .-])[0-9]{3}"
PHONE = f"(?<![0-9A-Za-z(+])(?:{_CERTAIN}|(?:\\+?1)?[2-9][0-9]{{2}}[ .-][2-9][0-9]{{2}})[ .-][0-9]{{4}}(?![0-9A-Za-z])"
_BYTE = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
IPV4 = f"(?<![0-9A-Za-z.])(?:{_BYTE}\\.){{3}}{_BYTE}(?![0-9A-Za-z]|\\.[0-9])"
# Dates of other layouts: 31/12/1999, 31.12.1999, 12/31/1999; Dec 31, 1999; 31 December 1999.
_MONTH_DAY = "(?:0?[1-9]|[12][0-9]|3[01])"
NUMBER_DATE = "|".join(f"(?<![0-9A-Za-z/.-]){_MONTH_DAY}{x}{_MONTH_DAY}{x}{_YEAR}[0-9]{{2}}(?![0-9A-Za-z/-]|\\.[0-9])"
                       for x in ("/", "\\."))
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November",
          "December")
_MONTH = "(?:" + "|".join(f"{x[:3]}(?:{x[3:]})?" if x[3:] else x for x in MONTHS) + ")"
NAME_DATE = (f"(?<![0-9A-Za-z-])(?:{_MONTH} {_MONTH_DAY}, {_YEAR}[0-9]{{2}}|{_MONTH_DAY} {_MONTH} {_YEAR}[0-9]{{2}})"
             "(?![0-9A-Za-z-])")
# Country, two check digits, 11 to 30 characters, solid or in groups of four.
IBAN = ("(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,4})?)(?![0-9A-Za-z])")
KINDS = {"email": EMAIL, "iban": IBAN, "date": DATE, "number_date": NUMBER_DATE, "name_date": NAME_DATE, "ssn": SSN,
         "phone": PHONE, "ip": IPV4}
#: Any of the formats.
FOUND = "|".join(f"(?:{x})" for x in KINDS.values())
#: A run of digit groups that may hold payment card numbers of 13 to 19 digits among other numbers.
RUN = ("(?<![0-9A-Za-z-])(?=(?:[ -]?[0-9]){13})[0-9]++(?![A-Za-z])(?:[ -][0-9]++(?![A-Za-z]))*+(?!-[0-9])")
#: Digit groups in which cards are written.
CARD_GROUPS = ("^(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){3}(?:-[0-9]{1,3})?|[0-9]{4}-[0-9]{6}-[0-9]{4,5}|"
               "[0-9]{4}-[0-9]{4}-[0-9]{5}|[0-9]{4}(?:-[0-9]{3}){3})$")
#: Days of a 400-year cycle of the calendar, as two radices (189 * 773 = 146097).
CYCLE = (189, 773)
_EPOCH = "1600-01-01"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def feistel(values: Column, radices: Column, domain: Column, key: str, rounds: int = ROUNDS) -> Column:
    """Permute an array of digits (``values[i] < radices[i]``) under ``key``.

    The array is halved; in turn each half gets, digit by digit and modulo its
    radix, a keyed SHA-256 of the other half. ``domain`` names the format and
    is part of the key. The inverse subtracts in reverse order.
    """
    cut = F.floor(F.size(values) / 2).cast("int")
    start = F.struct(values.alias("v"), radices.alias("r"), domain.alias("d"), cut.alias("cut"))
    halves = let(start, lambda s: F.struct(
        F.slice(s["v"], 1, s["cut"]).alias("l"), F.slice(s["v"], s["cut"] + 1, F.size(s["v"])).alias("r"),
        F.slice(s["r"], 1, s["cut"]).alias("lr"), F.slice(s["r"], s["cut"] + 1, F.size(s["r"])).alias("rr"),
        s["d"].alias("d")))

    def add(half: Column, other: Column, radix: Column, name: Column, turn: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), name, turn.cast("string"), F.array_join(other.cast("array<string>"), ","))
        return let(seed, lambda s: F.transform(half, lambda v, i: F.pmod(v + F.conv(F.substring(F.sha2(F.concat_ws(
            "|", s, i.cast("string")), 256), 1, 12), 16, 10).cast("long"), F.get(radix, i))))

    def step(x: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        return F.struct(F.when(even, add(x["l"], x["r"], x["lr"], x["d"], turn)).otherwise(x["l"]).alias("l"),
                        F.when(even, x["r"]).otherwise(add(x["r"], x["l"], x["rr"], x["d"], turn)).alias("r"),
                        x["lr"].alias("lr"), x["rr"].alias("rr"), x["d"].alias("d"))

    return let(F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), halves, step), lambda x: F.concat(x["l"], x["r"]))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _digits(s: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(s, "[^0-9]", "")), lambda c: c.cast("long"))


def _filled(shape: Column, digits: Column) -> Column:
    """``shape`` with its decimal digits replaced in order by ``digits``."""
    state = F.struct(F.lit("").alias("s"), digits.alias("d"), F.lit(0).alias("i"))

    def put(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(acc["s"], F.when(digit, F.get(acc["d"], acc["i"]).cast("string")).otherwise(c)).alias("s"),
                        acc["d"].alias("d"), (acc["i"] + digit.cast("int")).alias("i"))

    return F.aggregate(_chars(shape), state, put, lambda acc: acc["s"])


def luhn_sum(digits: Column, shift: int = 0) -> Column:
    """Luhn sum of digits, the last one counting once (``shift`` 0) or doubled (1)."""

    def weighed(all_: Column) -> Column:
        n = F.size(all_)
        return F.transform(all_, lambda d, i: F.when((n - 1 - i + shift) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0))
                           .otherwise(d))

    return F.aggregate(let(digits, weighed), F.lit(0).cast("long"), lambda a, x: a + x)


def _longs(*values: int) -> Column:
    return F.array(*[F.lit(x).cast("long") for x in values])


def _plus(a: Column, b: Column, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def _card(d: Column, key: str) -> Column:
    """Digits of a card: the first one (the scheme) and the length stay, the check digit is made anew."""

    def new(d: Column) -> Column:
        n = F.size(d)
        body = F.slice(d, 2, n - 2)
        name = F.concat(F.lit("card"), n.cast("string"), F.get(d, F.lit(0)).cast("string"))
        mixed = F.concat(F.slice(d, 1, 1), feistel(body, F.array_repeat(F.lit(10).cast("long"), n - 2), name, key))
        return let(mixed, lambda x: F.concat(x, F.array(F.pmod(10 - luhn_sum(x, 1) % 10, F.lit(10)))))

    return let(d, new)


def _cards(run: Column, key: str) -> Column:
    """(text, number of cards) of a ``RUN``. Cards begin and end at its digit
    groups and have a right Luhn sum. From the left, the longest one at each
    group is taken, those in ``CARD_GROUPS`` before others that overlap them."""

    def span(g: Column, first: Column, last: Column) -> Column:
        return F.slice(g, first + 1, last - first + 1)

    def fits(g: Column, first: Column) -> Column:
        ends = F.sequence(first, F.least(first + 18, F.size(g) - 1))
        texts = F.transform(ends, lambda last: F.struct(F.array_join(span(g, first, last), "-").alias("s"),
                                                        last.alias("last")))
        valid = F.filter(texts, lambda x: let(F.regexp_replace(x["s"], "-", ""), lambda t: F.length(t).between(13, 19)
                                              & F.when(F.length(t).between(13, 19), luhn_sum(_digits(t)) % 10 == 0)))
        return F.array_max(F.transform(valid, lambda x: F.struct(x["s"].rlike(CARD_GROUPS).alias("usual"),
                                                                 x["last"].alias("last"), first.alias("first"))))

    def pick(best: Column) -> Column:
        start = F.struct(F.lit(0).alias("free"), F.filter(best, lambda b: F.lit(False)).alias("picked"))

        def step(acc: Column, b: Column) -> Column:
            free = b.isNotNull() & (b["first"] >= acc["free"])
            later = F.slice(best, b["first"] + 2, b["last"] - b["first"])
            take = free & (b["usual"] | ~F.exists(later, lambda x: F.coalesce(x["usual"], F.lit(False))))
            return F.when(take, F.struct((b["last"] + 1).alias("free"),
                                         F.concat(acc["picked"], F.array(b)).alias("picked"))).otherwise(acc)

        return F.aggregate(best, start, step, lambda acc: acc["picked"])

    def put(g: Column, picked: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<bigint>").alias("d"))
        plain = lambda first, last: _digits(F.array_join(span(g, first, last), ""))

        def step(acc: Column, p: Column) -> Column:
            return F.struct((p["last"] + 1).alias("at"), F.concat(
                acc["d"], plain(acc["at"], p["first"] - 1), _card(plain(p["first"], p["last"]), key)).alias("d"))

        digits = F.aggregate(picked, start, step, lambda acc: F.concat(acc["d"], plain(acc["at"], F.size(g) - 1)))
        return F.struct(F.when(F.size(picked) > 0, _filled(run, digits)).otherwise(run).alias("text"),
                        F.size(picked).alias("n"))

    def new(g: Column) -> Column:
        best = F.transform(F.sequence(F.lit(0), F.size(g) - 1), lambda first: fits(g, first))
        return let(let(best, pick), lambda picked: put(g, picked))

    return let(F.split(run, "[ -]"), new)


def _without_cards(piece: Column, key: str) -> Column:
    """(text, kinds replaced) of a text between other values."""
    runs = F.transform(F.regexp_extract_all(piece, F.lit(RUN), F.lit(0)), lambda run: _cards(run, key))

    def weave(new: Column) -> Column:
        text = F.array_join(F.zip_with(F.split(piece, RUN, -1), new, lambda a, b: F.concat(
            a, F.coalesce(b["text"], F.lit("")))), "")
        n = F.aggregate(new, F.lit(0), lambda acc, x: acc + x["n"])
        return F.struct(text.alias("text"), F.array_repeat(F.lit("card"), n).alias("kinds"))

    plain = F.struct(piece.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return F.when(piece.rlike(RUN), let(runs, weave)).otherwise(plain)


def _phone(m: Column, key: str) -> Column:
    """A country code 1 stays. Area and exchange codes that start with 2 to 9 keep doing so; a first digit 0 or 1,
    which no real number has, stays one of these two."""

    def new(d: Column) -> Column:
        lead = F.size(d) - 10
        national = F.slice(d, lead + 1, 10)
        area, exchange = F.get(national, F.lit(0)) >= 2, F.get(national, F.lit(3)) >= 2
        first = lambda real: (F.when(real, 2).otherwise(0).cast("long"), F.when(real, 8).otherwise(2).cast("long"))
        (low_a, radix_a), (low_e, radix_e) = first(area), first(exchange)
        low = F.concat(F.array(low_a), _longs(0, 0), F.array(low_e), _longs(*[0] * 6))
        radix = F.concat(F.array(radix_a), _longs(10, 10), F.array(radix_e), _longs(*[10] * 6))
        name = F.concat(F.lit("phone"), F.when(area, "").otherwise("a"), F.when(exchange, "").otherwise("e"))
        mixed = _plus(feistel(_plus(national, low, -1), radix, name, key), low)
        return _filled(m, F.concat(F.slice(d, 1, lead), mixed))

    return let(_digits(m), new)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""

    def new(part: Column) -> Column:
        area, group, serial = (F.get(part, F.lit(i)) for i in range(3))
        ok = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
        values = F.array(area - 1 - (area > 666).cast("long"), group - 1, serial - 1)
        mixed = _plus(feistel(values, _longs(898, 99, 9999), F.lit("ssn"), key), _longs(1, 1, 1))
        return F.when(ok, let(mixed, lambda x: F.format_string(
            "%03d-%02d-%04d", F.get(x, F.lit(0)) + (F.get(x, F.lit(0)) >= 666).cast("long"), F.get(x, F.lit(1)),
            F.get(x, F.lit(2)))))

    return let(F.split(m, "-").cast("array<bigint>"), new)


def _ip(m: Column, key: str) -> Column:
    def new(part: Column) -> Column:
        mixed = feistel(part, _longs(256, 256, 256, 256), F.lit("ip"), key)
        return F.when(F.forall(part, lambda x: x <= 255), F.array_join(mixed.cast("array<string>"), "."))

    return let(F.split(m, "\\.").cast("array<bigint>"), new)


def _moved(since: Column, key: str, show: Callable[[Column], Column]) -> Column:
    """``show`` of the day that takes the place of a day since 1600-01-01: valid days of the years 1600 to 2399,
    permuted within their 400-year cycle."""
    days = CYCLE[0] * CYCLE[1]

    def new(day: Column) -> Column:
        within = F.pmod(day, F.lit(days))
        values = F.array(F.floor(within / CYCLE[1]).cast("long"), F.pmod(within, F.lit(CYCLE[1])))
        moved = let(feistel(values, _longs(*CYCLE), F.lit("date"), key),
                    lambda x: (day - within) + F.get(x, F.lit(0)) * CYCLE[1] + F.get(x, F.lit(1)))
        ok = day.isNotNull() & (day >= 0) & (day < 2 * days)
        return F.when(ok, let(F.date_add(F.lit(_EPOCH).cast("date"), moved.cast("int")), show))

    return let(since.cast("long"), new)


def _since(iso: Column) -> Column:
    """Days from 1600-01-01 to a day as yyyy-MM-dd; null if there is no such day."""
    return F.datediff(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), F.lit(_EPOCH).cast("date"))


def _date(m: Column, key: str) -> Column:
    return _moved(_since(m), key, lambda d: F.date_format(d, "yyyy-MM-dd"))


def _number_date(m: Column, key: str) -> Column:
    """Day first, or month first where that is no day; digits are filled up with 0 where they were two."""

    def new(part: Column) -> Column:
        a, b, year = (F.get(part, F.lit(i)) for i in range(3))
        iso = lambda month, day: F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
        width = lambda old, x: F.when(F.length(old) == 2, F.lpad(x, 2, "0")).otherwise(x)
        mark = F.when(m.contains("/"), "/").otherwise(".")
        day, month = (lambda d: F.dayofmonth(d).cast("string")), (lambda d: F.month(d).cast("string"))

        def shown(d: Column, first: Column, second: Column) -> Column:
            return F.concat(width(a, first), mark, width(b, second), mark, F.date_format(d, "yyyy"))

        return F.coalesce(_moved(_since(iso(b, a)), key, lambda d: shown(d, day(d), month(d))),
                          _moved(_since(iso(a, b)), key, lambda d: shown(d, month(d), day(d))))

    return let(F.split(m, "[/.]"), new)


def _name_date(m: Column, key: str) -> Column:
    """The order and the length of the month's name stay (May counts as a whole name)."""
    name = F.regexp_extract(m, "[A-Za-z]+", 0)
    short = (F.length(name) == 3) & (name != "May")
    numbers = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    number = F.array_position(F.array(*[F.lit(x[:3]) for x in MONTHS]), F.substring(name, 1, 3)).cast("string")
    iso = F.concat_ws("-", F.get(numbers, F.lit(1)), F.lpad(number, 2, "0"), F.lpad(F.get(numbers, F.lit(0)), 2, "0"))

    def show(d: Column) -> Column:
        month = F.get(F.array(*[F.lit(x) for x in MONTHS]), F.month(d) - 1)
        month = F.when(short, F.substring(month, 1, 3)).otherwise(month)
        day = F.dayofmonth(d).cast("string")
        day = F.when(F.length(F.get(numbers, F.lit(0))) == 2, F.lpad(day, 2, "0")).otherwise(day)
        year = F.date_format(d, "yyyy")
        return F.when(m.contains(","), F.concat(month, F.lit(" "), day, F.lit(", "), year)).otherwise(
            F.concat_ws(" ", day, month, year))

    return _moved(_since(iso), key, show)


def _mod97(text: Column) -> Column:
    """Capital letters (A = 10) and digits as one number, modulo 97."""
    return F.aggregate(_chars(text), F.lit(0).cast("long"), lambda acc, c: F.when(
        c.between("0", "9"), (acc * 10 + c.try_cast("long")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, key: str) -> Column:
    """The country and which places hold letters stay, the check digits are made anew; not valid modulo 97: null."""

    def new(solid: Column) -> Column:
        country, account = F.substring(solid, 1, 2), F.substring(solid, 5, 40)
        code = F.transform(_chars(account), lambda c: F.ascii(c).cast("long"))
        low = F.transform(code, lambda c: F.when(c >= 65, 65).otherwise(48).cast("long"))
        radix = F.transform(code, lambda c: F.when(c >= 65, 26).otherwise(10).cast("long"))
        name = F.concat(F.lit("iban"), country, F.array_join(F.transform(low, lambda x: x.cast("string")), ","))
        mixed = F.array_join(F.transform(_plus(feistel(_plus(code, low, -1), radix, name, key), low), lambda c: F.chr(c)), "")

        def checked(account: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
            return F.concat(country, check, account)

        valid = _mod97(F.concat(account, F.substring(solid, 1, 4))) == 1
        # blanks go back to where they were, after every fourth character
        spaced = lambda x: F.when(m.contains(" "), F.trim(F.regexp_replace(x, "(.{4})", "$1 "))).otherwise(x)
        return F.when(valid, spaced(let(mixed, checked)))

    return let(F.regexp_replace(m, " ", ""), new)


def _email(m: Column, key: str) -> Column:
    """Letters of the local part stay letters of their case, digits digits; the rest and the domain stay."""
    local, rest = F.substring_index(m, "@", 1), F.concat(F.lit("@"), F.substring_index(m, "@", -1))
    low = lambda a: F.when(a.between(97, 122), 97).when(a.between(65, 90), 65).when(a.between(48, 57), 48).otherwise(a)
    radix = lambda a: F.when(a.between(97, 122) | a.between(65, 90), 26).when(a.between(48, 57), 10).otherwise(1)

    def new(code: Column) -> Column:
        base = F.transform(code, lambda a: low(a).cast("long"))
        return let(base, lambda b: F.array_join(F.transform(
            _plus(feistel(_plus(code, b, -1), F.transform(code, lambda a: radix(a).cast("long")),
                          F.concat(F.lit("email"), F.array_join(b.cast("array<string>"), ",")), key), b),
            lambda a: F.chr(a)), ""))

    return F.concat(let(F.transform(_chars(local), lambda c: F.ascii(c).cast("long")), new), rest)


def pseudonym(m: Column, key: str) -> Column:
    """(kind, new value) of a match of ``FOUND``; a null value if it is not valid."""
    makers = {"email": _email, "iban": _iban, "date": _date, "number_date": _number_date, "name_date": _name_date,
              "ssn": _ssn, "phone": _phone, "ip": _ip}
    full = {k: f"^(?:{v})$" for k, v in KINDS.items()}
    kind = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for k in reversed(list(KINDS)):
        kind = F.when(m.rlike(full[k]), k.removeprefix("number_").removeprefix("name_")).otherwise(kind)
        value = F.when(m.rlike(full[k]), makers[k](m, key)).otherwise(value)
    return F.struct(kind.alias("kind"), value.alias("value"))


def pseudonymise(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts with their validated personal values replaced by pseudonyms of the same format.

    Looks for e-mail addresses (local part), IBANs, dates (1999-12-31,
    31/12/1999, 31.12.1999, 12/31/1999, Dec 31, 1999, 31 December 1999), US
    social security and phone numbers, IPv4 addresses and payment card numbers
    in the whole text. A value that is not valid in its format (Luhn sum, modulo
    97, calendar, ranges) stays. Phone numbers with a country code or brackets
    may have any area code; cards are also found beside other digit groups, at
    group bounds. Values are compared by their digits, so separators do not
    matter, and a day gets the same new day in every layout (of numbers alone
    the first is the day unless there is no such day): equal values get equal
    pseudonyms in every document under one ``key``, different values of a
    format different ones.

    Returns one row per input row: ``doc_id, text`` (null stays null),
    ``n_replaced`` and ``kinds`` (names of the kinds replaced, in order). An
    empty table gives an empty result; other columns are ignored. DataFrame
    expressions only, no shuffle.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    some = F.col("text").rlike("[0-9@]")
    none = F.array().cast("array<string>")
    found = F.when(some, F.regexp_extract_all("text", F.lit(FOUND), 0)).otherwise(none)
    rows = rows.withColumn("_found", F.coalesce(found, none))
    rows = rows.withColumn("_new", F.transform("_found", lambda m: pseudonym(m, key)))
    values = F.zip_with("_found", "_new", lambda m, n: F.coalesce(n["value"], m))
    pieces = F.transform(F.split("text", FOUND, -1), lambda piece: _without_cards(piece, key))
    new = F.zip_with("_found", "_new", lambda m, n: F.struct(
        F.coalesce(n["value"], m).alias("text"),
        F.when(n["value"].isNotNull(), F.array(n["kind"])).otherwise(none).alias("kinds")))
    rows = rows.withColumn("_all", F.when(some, F.zip_with(pieces, new, lambda a, b: F.struct(
        F.concat(a["text"], F.coalesce(b["text"], F.lit(""))).alias("text"),
        F.concat(a["kinds"], F.coalesce(b["kinds"], none)).alias("kinds")))))
    rows = rows.withColumn("_kinds", F.coalesce(F.flatten(F.transform("_all", lambda x: x["kinds"])), none))
    woven = F.array_join(F.transform("_all", lambda x: x["text"]), "")
    return rows.select("doc_id", F.when(F.size("_kinds") > 0, woven).otherwise(F.col("text")).alias("text"),
                       F.size("_kinds").alias("n_replaced"), F.array_join("_kinds", ",").alias("kinds"))
