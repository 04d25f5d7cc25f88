"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Validated card, telephone and social security numbers, IPv4 addresses, dates and
the local parts of e-mail addresses are permuted within their format under a key:
equal values get equal pseudonyms in all documents, different values different
ones, a pseudonym is valid itself, and with the key the text can be restored.
Numbers are mapped to pairs of a product of two ranges; each round adds a keyed hash
of one part to the other modulo its range, so no value leaves its format and no
round needs to be repeated. Letters and digits of addresses are shifted likewise,
half by half, within their class. Everything is DataFrame functions.

What fails validation (a wrong check digit, an octet over 255, a day that does not
exist) stays as it is. Cards keep their first digit and get a new check digit;
separators stay. Where a run of digits and single separators holds a number of one
group, or of groups 4-4-4-4 or 4-6-5, that is the card, and what stands before and behind
it stays; else the whole run is. So 19 digits in groups 4-4-4-4-3 count as 16 and three
others. Days are of 1900 to 2099. With slashes, month/day/year is read first,
day/month/year where that is no date.

Not handled: domains of e-mail addresses, telephone numbers outside the North American
plan, bank account numbers, IPv6 addresses, dates in words. A local part of one letter
is shifted by the same amount wherever it stands.

The key is read from a table of one row while the plan runs, so it is in no plan,
event log or web page.

Defined cases: null text stays null; empty texts and texts without such data are
unchanged; texts of any length are taken whole, and all their matches; repeated rows
are changed alike; other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "ip", "date", "phone", "ssn", "card")
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "date": r"(?<!\d)(?:(?:19|20)\d\d-\d\d-\d\d|\d\d/\d\d/(?:19|20)\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?!\d)",
    "phone": r"(?<!\d)(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}
ANY = "|".join(PATTERNS[k] for k in KINDS)
#: Where in a run of digits a card number stands; the whole run where none of these does.
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\d)"
#: 1900-01-01 to 2099-12-31 are 73049 = 17 * 4297 days.
FIRST_DAY, DAY_RANGES = "1900-01-01", (17, 4297)


def _hash(key: Column | str, tag: str, i: Column, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(key) if isinstance(key, str) else key, F.lit(f"|{tag}|"), i.cast("string"), F.lit("|"), value.cast("string")), 256)


def _rounds(reverse: bool) -> Column:
    return F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if reverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def permute(x: Column, a: Column | int, b: Column | int, key: Column | str, tag: str, reverse: bool = False) -> Column:
    """A keyed permutation of 0 .. a * b - 1 (bigint)."""
    a, b = (F.lit(v).cast("bigint") if isinstance(v, int) else v for v in (a, b))
    sign = -1 if reverse else 1
    number = lambda i, v: F.conv(F.substring(_hash(key, tag, i, v), 1, 14), 16, 10).cast("bigint")

    # what rounds share is in their state: a lambda works out again whatever else it names
    def one(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, F.pmod(s["l"] + sign * F.pmod(number(i, s["r"]), s["a"]), s["a"])).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + sign * F.pmod(number(i, s["l"]), s["b"]), s["b"]))
        return F.struct(left.alias("l"), right.alias("r"), s["a"].alias("a"), s["b"].alias("b"))

    start = F.struct(F.call_function("div", x, b).alias("l"), F.pmod(x, b).alias("r"), a.alias("a"), b.alias("b"))
    return F.aggregate(_rounds(reverse), start, one, lambda s: s["l"] * s["b"] + s["r"])


def permute_letters(s: Column, key: Column | str, tag: str, reverse: bool = False) -> Column:
    """A keyed permutation of strings: letters keep their case, digits stay digits, other
    characters stay. The parts' hashes ignore case, so spellings that differ in case only stay so."""
    sign = -1 if reverse else 1
    half = F.floor(F.length(s) / 2).cast("int")

    def moved(part: Column, by: Column) -> Column:
        """Each character moved by its two hexadecimal digits, which repeat after 32 characters."""

        def shift(c: Column, pair: Column) -> Column:
            v = F.conv(pair, 16, 10).cast("int")
            to = lambda base, n: F.char((base + F.pmod(F.ascii(c) - base + sign * v, F.lit(n))).cast("bigint"))
            return F.when(c.rlike("^[0-9]$"), to(48, 10)).when(c.rlike("^[a-z]$"), to(97, 26)).when(c.rlike("^[A-Z]$"), to(65, 26)).otherwise(c)

        pairs = F.regexp_extract_all(F.repeat(by, (F.length(part) / 32 + 1).cast("int")), F.lit(".."), F.lit(0))
        return F.array_join(F.zip_with(F.split(part, ""), F.slice(pairs, F.lit(1), F.length(part)), shift), "")

    def one(p: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, moved(p["l"], _hash(key, tag, i, F.lower(p["r"])))).otherwise(p["l"])
        right = F.when(even, p["r"]).otherwise(moved(p["r"], _hash(key, tag, i, F.lower(p["l"]))))
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s)).alias("r"))
    return F.aggregate(_rounds(reverse), start, one, lambda p: F.concat(p["l"], p["r"]))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def lay(m: Column, digits: Column) -> Column:
    """m with its digits, in order, replaced by those given."""

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["o"], F.when(is_digit, F.substr(s["d"], s["k"], F.lit(1))).otherwise(c)).alias("o"), (s["k"] + is_digit.cast("int")).alias("k"), s["d"].alias("d"))

    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("o"), F.lit(1).alias("k"), digits.alias("d")), step, lambda s: s["o"])


def padded(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def luhn_sum(d: Column, doubled: int) -> Column:
    """Luhn sum of a digit string, doubling every second digit from the last (doubled 0) or the last but one (1)."""

    def add(s: Column, c: Column) -> Column:
        v = c.cast("int")
        value = F.when(s["i"] % 2 == doubled, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)
        return F.struct((s["t"] + value).alias("t"), (s["i"] + 1).alias("i"))

    return F.aggregate(F.reverse(F.split(d, "")), F.struct(F.lit(0).alias("t"), F.lit(0).alias("i")), add, lambda s: s["t"])


def card_in(m: Column) -> Column:
    """The part of a run of digits that is a card's number, by its groups alone."""
    return F.when(m.rlike(CARD), F.regexp_extract(m, CARD, 0)).otherwise(m)


def _card(m: Column, key: Column, reverse: bool) -> Column:
    part, at = card_in(m), F.when(m.rlike(CARD), F.regexp_instr(m, F.lit(CARD))).otherwise(F.lit(1))
    d = digits_of(part)
    size = F.length(d) - 2
    low = F.floor(size / 2).cast("int")
    power = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("bigint")
    body = permute(F.substr(d, F.lit(2), size).cast("bigint"), power(size - low), power(low), key, "card", reverse)
    kept = F.concat(F.substr(d, F.lit(1), F.lit(1)), padded(body, size))
    new = lay(part, F.concat(kept, F.pmod(-luhn_sum(kept, 0), F.lit(10)).cast("string")))
    return F.concat(F.substr(m, F.lit(1), at - 1), new, F.substr(m, at + F.length(part), F.length(m)))


def _phone(m: Column, key: Column, reverse: bool) -> Column:
    """Numbers whose area and exchange start with 2 to 9 are permuted among themselves, and
    the 3.6 * 10**9 others, which count with a country code or parentheses only, too."""
    d = digits_of(m)
    own = F.right(d, F.lit(10))
    million = 1_000_000
    n = lambda at, size: F.substr(own, F.lit(at), F.lit(size)).cast("bigint")
    usual = own.rlike("^[2-9][0-9]{2}[2-9]")
    x = permute(((n(1, 3) - 200) * 8 + n(4, 1) - 2) * million + n(5, 6), 6400, million, key, "phone", reverse)
    top = F.floor(x / million).cast("bigint")
    one = F.concat((F.floor(top / 8) + 200).cast("string"), (top % 8 + 2).cast("string"), padded(x % million, 6))
    low = 2000 * million  # areas under 200; then exchanges under 200 of the others
    start = F.when(n(1, 3) < 200, own.cast("bigint")).otherwise(low + ((n(1, 3) - 200) * 2 + n(4, 1)) * million + n(5, 6))
    y = permute(start, 60_000, 60_000, key, "phone2", reverse)
    rest = F.call_function("div", y - low, F.lit(million).cast("bigint"))
    other = F.when(y < low, padded(y, 10)).otherwise(F.concat((F.floor(rest / 2) + 200).cast("string"), (rest % 2).cast("string"), padded((y - low) % million, 6)))
    return lay(m, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), F.when(usual, one).otherwise(other)))


def _ssn(m: Column, key: Column, reverse: bool) -> Column:
    p = F.split(m, "-")
    area = p[0].cast("bigint") - 1  # 1 to 899 without 666
    x = permute(((area - F.when(area > 665, 1).otherwise(0)) * 99 + p[1].cast("bigint") - 1) * 9999 + p[2].cast("bigint") - 1, 898 * 99, 9999, key, "ssn", reverse)
    top = F.floor(x / 9999).cast("bigint")
    back = F.floor(top / 99).cast("bigint")
    return F.concat_ws("-", padded(back + F.when(back > 664, 2).otherwise(1), 3), padded(top % 99 + 1, 2), padded(x % 9999 + 1, 4))


def _ip(m: Column, key: Column, reverse: bool) -> Column:
    o = F.transform(F.split(m, r"\."), lambda c: c.cast("bigint"))
    x = permute(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 1 << 16, 1 << 16, key, "ip", reverse)
    part = lambda k: (F.shiftright(x, k) % 256).cast("string")
    return F.concat_ws(".", part(24), part(16), part(8), part(0))


def _formats(m: Column) -> Column:
    """The date format of a match; null if it is no date."""
    ok = lambda f: F.try_to_timestamp(m, F.lit(f)).isNotNull()
    return F.when(m.contains("-"), F.when(ok("yyyy-MM-dd"), "yyyy-MM-dd")).when(m.contains("."), F.when(ok("dd.MM.yyyy"), "dd.MM.yyyy")).otherwise(F.when(ok("MM/dd/yyyy"), "MM/dd/yyyy").when(ok("dd/MM/yyyy"), "dd/MM/yyyy"))


def _date(m: Column, key: Column, reverse: bool) -> Column:
    out: Column = m
    for f in ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy"):
        day = F.datediff(F.try_to_timestamp(m, F.lit(f)).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("bigint")
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), permute(day, *DAY_RANGES, key, "date", reverse).cast("int"))
        out = F.when(_formats(m) == f, F.date_format(new, f)).otherwise(out)
    return out


def _email(m: Column, key: Column, reverse: bool) -> Column:
    at = F.instr(m, "@")
    return F.concat(permute_letters(F.substr(m, F.lit(1), at - 1), key, "email", reverse), F.substr(m, at, F.length(m)))


_CHANGE: dict[str, Callable[[Column, Column, bool], Column]] = {"email": _email, "ip": _ip, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}


def kind_of(m: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """The kind of a match that is valid, else null."""
    d = digits_of(m)
    ten = F.right(d, F.lit(10))
    valid = {
        "email": F.lit(True),
        "ip": F.forall(F.split(m, r"\."), lambda c: c.cast("int") < 256) & ~m.rlike(r"(^|\.)0\d"),
        "date": _formats(m).isNotNull(),
        "phone": ten.rlike("^[2-9][0-9]{2}[2-9]") | (F.length(d) == 11) | m.contains("("),
        "ssn": ~m.rlike("^(000|666|9)|-00-|-0000$"),
        "card": luhn_sum(digits_of(card_in(m)), 1) % 10 == 0,
    }
    out: Column = F.lit(None).cast("string")
    for k in reversed(KINDS):
        if k in kinds:
            out = F.when(m.rlike(f"^(?:{PATTERNS[k]})$"), F.when(valid[k], F.lit(k))).otherwise(out)
    return out


def _equals(k: str) -> Callable[[Column], Column]:
    return lambda v: v == k


def pseudonymise(df: DataFrame, key: str, text: str = "text", kinds: tuple[str, ...] = KINDS, reverse: bool = False, count: str | None = None) -> DataFrame:
    """Replace the valid matches in ``text``; with ``reverse`` restore them. ``count`` names a
    column for a map of kind -> matches replaced."""
    whole = "|".join(PATTERNS[k] for k in KINDS if k in kinds)
    some = F.coalesce(F.col(text).rlike("[0-9@]"), F.lit(False))
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(whole), F.lit(0)), lambda m: F.struct(m.alias("m"), kind_of(m, kinds).alias("k")))

    def change(p: Column) -> Column:
        out: Column = p["m"]
        for k in kinds:
            out = F.when(p["k"] == k, _CHANGE[k](p["m"], F.col("__key"), reverse)).otherwise(out)
        return out

    secret = df.sparkSession.createDataFrame(pa.table({"key": [key]}))  # a row on the driver
    marked = df.withColumns({"__found": F.when(some, found), "__key": secret.scalar()})
    new = F.array_join(F.zip_with(F.split(F.col(text), whole, -1), F.transform("__found", change), lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")
    out = F.when(F.size("__found") > 0, new).otherwise(F.col(text))
    cols = [out.alias(text) if c == text else F.col(c) for c in df.columns]
    if count:
        valid = F.filter(F.transform(F.coalesce("__found", F.array().cast("array<struct<m:string,k:string>>")), lambda p: p["k"]), lambda k: k.isNotNull())
        cols.append(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*[F.size(F.filter(valid, _equals(k))) for k in kinds])).alias(count))
    return marked.select(*cols)
