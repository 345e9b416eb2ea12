"""Format-preserving pseudonyms for personal data in texts, by keyed Feistel permutations in DataFrame functions only.

Found values that pass their validity check are permuted within their own format: a card stays a card with a right check
digit, a date a date of its century, an address an address. The permutation depends on the key and the value alone, so
equal values get equal pseudonyms in all documents, different values different ones, and who has the key can go back.

| kind | found | valid if | kept |
|---|---|---|---|
| card | 13 to 19 digits, plain or in groups | Luhn, first digit 2 to 6 | first digit, grouping |
| phone | 10 digits in groups, with or without country code | format | country code, grouping |
| ip | four numbers with dots | each at most 255 | dots |
| date | YYYY-MM-DD, MM/DD/YYYY, DD.MM.YYYY | day exists | century, format |
| ssn | DDD-DD-DDDD | area, group and serial in use | dashes |
| iban | country, check digits, account | remainder 1 modulo 97 | country, kinds of characters |
| mail | address | format | domain, case, kinds of characters |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_FREE = r"(?<![0-9A-Za-z])"
_PATTERNS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.)+[A-Za-z]{2,24}",
    "iban": _FREE + r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])",
    "phone": r"(?:\+[0-9]{1,3}[ -]?\([0-9]{3}\) ?|\+[0-9]{1,3}[ -][0-9]{3}[ -]|(?<![0-9A-Za-z+-])\([0-9]{3}\) ?"
             r"|(?<![0-9A-Za-z.+-])[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})"
            r"(?![0-9A-Za-z/-]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ip": r"(?<![0-9A-Za-z.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![0-9A-Za-z]|\.[0-9])",
    "card": _FREE + r"(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}"
                    r"|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9A-Za-z])",
}
PATTERN = "|".join(_PATTERNS.values())
KINDS = tuple(_PATTERNS)
_ROUNDS = 10


def _mac(key: str, *said) -> Column:
    """60 keyed bits of what is said."""
    text = F.concat_ws("|", F.lit(key), *[x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in said])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _steps(back: bool) -> Column:
    return F.sequence(F.lit(_ROUNDS), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(_ROUNDS))


def _permuted(left: Column, right: Column, a, b, key: str, kind: str, back: bool) -> Column:
    """Feistel permutation of the pairs below (a, b); numbers as fields ``l`` and ``r``."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def turn(x, by, size):
        return F.pmod(x - F.pmod(by, size) if back else x + F.pmod(by, size), size)

    def step(s, n):
        odd = n % 2 == 1
        return F.struct(F.when(odd, turn(s["l"], _mac(key, kind, n, s["r"]), a)).otherwise(s["l"]).alias("l"),
                        F.when(odd, s["r"]).otherwise(turn(s["r"], _mac(key, kind, n, s["l"]), b)).alias("r"))
    return F.aggregate(_steps(back), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _padded(number: Column, width) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _chars(text: Column, change) -> Column:
    """Text of ``change(character, place)`` for each character, places from 1."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: change(F.substring(text, i, F.lit(1)), i)), "")


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order."""
    def place(c, i):
        before = F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), "[^0-9]", ""))
        return F.when(c.between("0", "9"), F.substring(digits, before, F.lit(1))).otherwise(c)
    return _chars(shape, place)


def _spelled(text: Column, key: str, kind: str, back: bool) -> Column:
    """Feistel permutation of a text: letters stay letters of their case, digits digits, the rest as it is."""
    half = F.floor(F.length(text) / 2).cast("int")

    def shifted(part, n, other):
        def change(c, i):
            by = _mac(key, kind, n, i, F.length(text), F.lower(other))
            by = -by if back else by

            def within(first, size):
                return F.char(F.pmod(F.ascii(c) - F.lit(first) + F.pmod(by, F.lit(size)), F.lit(size)) + F.lit(first))
            return (F.when(c.between("0", "9"), within(48, 10)).when(c.between("a", "z"), within(97, 26))
                    .when(c.between("A", "Z"), within(65, 26)).otherwise(c))
        return _chars(part, change)

    def step(s, n):
        if back:
            return F.struct(shifted(s["b"], n, s["a"]).alias("a"), s["a"].alias("b"))
        return F.struct(s["b"].alias("a"), shifted(s["a"], n, s["b"]).alias("b"))
    start = F.struct(F.substring(text, F.lit(1), half).alias("a"),
                     F.substring(text, half + 1, F.length(text)).alias("b"))
    done = F.aggregate(_steps(back), start, step)
    return F.concat(done["a"], done["b"])


def _luhn(body: Column) -> Column:
    """Check digit after ``body``."""
    n = F.length(body)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + _luhn_part(F.substring(body, i, F.lit(1)).cast("int"), n - i))
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def _luhn_part(digit: Column, from_right: Column) -> Column:
    twice = digit * 2
    return F.when(from_right % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)


def _card(m: Column, key: str, back: bool) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    body = F.substring(digits, F.lit(1), n - 1)
    valid = digits.between("2", "7") & (_luhn(body) == F.substring(digits, n, F.lit(1)))
    low = F.floor((n - 2) / 2).cast("int")
    a, b = (F.rpad(F.lit("1"), x + 1, F.lit("0")).cast("long") for x in (low, n - 2 - low))
    p = _permuted(F.substring(digits, F.lit(2), low), F.substring(digits, low + 2, n - 2 - low), a, b, key, "card", back)
    changed = F.concat(F.substring(digits, F.lit(1), F.lit(1)), _padded(p["l"], low), _padded(p["r"], n - 2 - low))
    return F.when(valid, _refilled(m, F.concat(changed, _luhn(changed))))


def _phone(m: Column, key: str, back: bool) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    p = _permuted(F.substring(digits, n - 9, F.lit(5)), F.substring(digits, n - 4, F.lit(5)), 100_000, 100_000, key, "phone", back)
    return _refilled(m, F.concat(F.substring(digits, F.lit(1), n - 10), _padded(p["l"], 5), _padded(p["r"], 5)))


def _ip(m: Column, key: str, back: bool) -> Column:
    x = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    p = _permuted(x[0] * 256 + x[1], x[2] * 256 + x[3], 65536, 65536, key, "ip", back)
    return F.concat_ws(".", *[v.cast("string") for n in ("l", "r") for v in (F.shiftright(p[n], 8), p[n].bitwiseAND(255))])


def _ssn(m: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.substring(m, F.lit(i), F.lit(k)).cast("long") for i, k in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    p = _permuted(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn", back)
    new = F.when(p["l"] >= 665, p["l"] + 2).otherwise(p["l"] + 1)
    return F.when(valid, F.concat_ws("-", _padded(new, 3), _padded(F.floor(p["r"] / 9999) + 1, 2), _padded(p["r"] % 9999 + 1, 4)))


def _date(m: Column, key: str, back: bool) -> Column:
    """Days of a century are 36,524, or 36,525 if its first year is a leap year: 92 x 397 or 75 x 487."""
    part = F.split(m, r"[-/.]")
    iso, us = m.contains("-"), m.contains("/")
    year = F.when(iso, part[0]).otherwise(part[2])
    month = F.when(iso, part[1]).when(us, part[0]).otherwise(part[1])
    day = F.when(iso, part[2]).when(us, part[1]).otherwise(part[0])
    date = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")
    first = F.make_date((F.floor(year.cast("int") / 100) * 100).cast("int"), F.lit(1), F.lit(1))
    leap = year.cast("int") % 400 < 100
    a, b = (F.when(leap, F.lit(x)).otherwise(F.lit(y)).cast("long") for x, y in ((75, 92), (487, 397)))
    days = F.datediff(date, first).cast("long")
    p = _permuted(F.floor(days / b), days % b, a, b, key, "date", back)
    new = F.date_add(first, (p["l"] * b + p["r"]).cast("int"))
    text = F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(us, F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))
    return F.when(date.isNotNull() & (year.cast("int") >= 100), text)


def _iban(m: Column, key: str, back: bool) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))

    def left_over(account, country_check):
        text = F.concat(account, country_check)
        return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), lambda s, i: _base97(s, F.substring(text, i, F.lit(1))))
    country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    valid = left_over(account, F.substring(plain, 1, 4)) == 1
    changed = _spelled(account, key, "iban", back)
    check = _padded(F.lit(98) - left_over(changed, F.concat(country, F.lit("00"))), 2)
    whole = F.concat(country, check, changed)

    def place(c, i):
        before = F.length(F.replace(F.substring(m, F.lit(1), i), F.lit(" "), F.lit("")))
        return F.when(c == " ", c).otherwise(F.substring(whole, before, F.lit(1)))
    return F.when(valid, _chars(m, place))


def _base97(total: Column, c: Column) -> Column:
    return F.when(c.between("0", "9"), (total * 10 + c.cast("int")) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)


def _mail(m: Column, key: str, back: bool) -> Column:
    return F.concat(_spelled(F.substring_index(m, "@", 1), key, "mail", back), F.lit("@"), F.substring_index(m, "@", -1))


_MADE = {"mail": _mail, "iban": _iban, "phone": _phone, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card}


def _kind(m: Column) -> Column:
    return (F.when(m.contains("@"), "mail").when(m.rlike("^[A-Z]"), "iban").when(m.rlike(r"^[+(]|^[0-9]{3}[.-][0-9]{3}[ .-][0-9]{4}$"), "phone")
            .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-"), "ssn").when(m.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|/|^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), "date")
            .when(m.contains("."), "ip").otherwise("card"))


def replaced(docs: DataFrame, *, key: str, back: bool = False) -> DataFrame:
    """``docs`` with its ``text`` replaced and ``_found``: array of (kind, value, pseudonym), in order.

    What only looks like a value but is not valid stays in the text and is not listed. NULL and empty texts stay as
    they are, with nothing found; repeated rows and ids are rows of their own; other columns are carried along. A row is worked on alone:
    no shuffle, and texts without a digit or @ are not searched.
    """
    text = F.col("text")
    hits = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(
        F.array().cast("array<string>"))

    def one(m):
        kind = _kind(m)
        new = F.lit(None).cast("string")
        for name, made in _MADE.items():
            new = F.when(kind == name, made(m, key, back)).otherwise(new)
        return F.struct(kind.alias("kind"), m.alias("value"), new.alias("pseudonym"))
    found = docs.withColumn("_hits", F.coalesce(hits, F.array().cast("array<string>")))
    found = found.withColumn("_all", F.when(F.size("_hits") > 0, F.transform("_hits", one)))
    gaps = F.split(text, PATTERN, -1)
    joined = F.array_join(F.zip_with(gaps, F.col("_all"), lambda g, h: F.concat(g, F.coalesce(h["pseudonym"], h["value"], F.lit("")))), "")
    kept = F.filter(F.col("_all"), lambda h: h["pseudonym"].isNotNull())
    return found.withColumn("text", F.when(F.size("_hits") > 0, joined).otherwise(text)).withColumn(
        "_found", F.coalesce(kept, F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>"))).drop("_hits", "_all")


DEFAULT_KEY = "set a secret of your own"


def pseudonymized(docs: DataFrame, *, key: str = DEFAULT_KEY) -> DataFrame:
    """The documents with pseudonyms in their texts, columns as they were."""
    return replaced(docs.drop("_found", "_hits", "_all"), key=key).select(*[c for c in docs.columns if c not in ("_found", "_hits", "_all")])


def restored(docs: DataFrame, *, key: str = DEFAULT_KEY) -> DataFrame:
    """The way back: texts with the values that ``pseudonymized`` replaced under this key."""
    return replaced(docs, key=key, back=True).drop("_found")


def report(docs: DataFrame, *, key: str = DEFAULT_KEY) -> DataFrame:
    """``doc_id``, the new ``text``, ``n_found``, and how many values of each kind were replaced."""
    rows = replaced(docs.select("doc_id", "text"), key=key)
    counts = [F.size(F.filter("_found", _is(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return rows.select("doc_id", "text", F.size("_found").cast("long").alias("n_found"), *counts)


def _is(kind: str):
    return lambda h: h["kind"] == kind
