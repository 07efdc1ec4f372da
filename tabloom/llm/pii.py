"""Personal data: format-preserving Feistel pseudonyms, in built-in functions only.

Found values are validated (card numbers by Luhn, IBANs by their check digits, addresses, social security numbers and
dates by their ranges) and then permuted under a key within their own format, so a pseudonym is again a valid value
of the kind, and equal values stay equal across documents. Strings go through an alternating Feistel network whose
rounds shift each digit or letter of one half by a keyed hash of the other half; numbers of a range a x b through the
same network with addition modulo a and b. Values that fail validation are left as they are.

Kinds: mail address (letters and digits but for the last label), IPv4 address (32 bits; octets without leading
zeros), telephone number (last ten digits), payment card (all but the check digit, which follows), IBAN (account part;
check digits follow), social security number (valid ranges), date (1700 to 2099). A date keeps its layout, with as many
digits of day and month as written; with slashes the day comes first where that is a date, otherwise the month, and
either sort of strings is permuted within itself. So different strings of a kind have different pseudonyms.

Edge cases: a null text stays null and has no finds; empty texts and texts without finds stay as they are; a text of
any length is searched whole, repeated groups that could be long are possessive, so they need no stack; repeated rows
get equal results; a table without rows gives none; all columns stay, whatever their names, but one named `pii`, which
the finds replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm._base import plain

KINDS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d]|[./-]\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|\+\d{8,15}(?!\d)",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d]|[.-]\d)",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
ROUNDS = 8
#: Years of the dates that are found, and tries to land on a day that exists; each fails for 2 % of the places or less.
_YEARS, _WALK = (1700, 400), 24


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _number(hexed: Column, at: Column, digits: int) -> Column:
    return F.conv(F.substring(hexed, at, F.lit(digits)), 16, 10).cast("long")


def _shift(c: Column, by: Column) -> Column:
    def turn(first: str, n: int) -> Column:
        return F.char(F.lit(ord(first)) + (F.ascii(c) - ord(first) + by) % n)

    return F.when(c.between("0", "9"), turn("0", 10)).when(c.between("a", "z"), turn("a", 26)).when(c.between("A", "Z"), turn("A", 26)).otherwise(c)


def permute_text(s: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of strings that keeps each character's class (digit, lower case, capital, other).

    A round hashes the other half once and draws a block of shifts for 12 characters from each hash after it.
    """
    half = F.floor(F.length(s) / 2).cast("int")
    state = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.length(s)).alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        source = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), acc["r"]), 256)
        stream = _let(source, lambda h: F.transform(F.sequence(F.lit(0), F.floor(F.length(acc["l"]) / 12).cast("int")), lambda block: F.sha2(F.concat_ws("|", h, block.cast("string")), 256)))
        moved = _let(
            F.struct(F.split(acc["l"], "").alias("chars"), stream.alias("stream")),
            lambda x: F.array_join(F.transform(x["chars"], lambda c, j: _shift(c, _number(F.get(x["stream"], F.floor(j / 12).cast("int")), ((j % 12) * 5 + 1).cast("int"), 5))), ""),
        )
        return F.struct(acc["r"].alias("l"), moved.alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, turn, lambda acc: F.concat(acc["l"], acc["r"]))


def permute_number(v: Column, a: Column | int, b: Column | int, key: str, tweak: Column) -> Column:
    """A keyed permutation of 0 .. a x b - 1."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    state = F.struct(F.floor(v / b).cast("long").alias("l"), F.pmod(v, b).cast("long").alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        def add(x: Column, y: Column, n: Column, part: int) -> Column:
            drawn = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), F.lit(str(part)), y.cast("string")), 256)
            return F.pmod(x + _number(drawn, F.lit(1), 12), n).cast("long")

        return _let(add(acc["l"], acc["r"], a, 0), lambda l2: F.struct(l2.alias("l"), add(acc["r"], l2, b, 1).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), state, turn, lambda acc: acc["l"] * b + acc["r"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _refill(m: Column, pattern: str, compact: Column) -> Column:
    """m with its characters of the pattern replaced by those of compact, in turn."""
    return F.array_join(F.zip_with(F.split(m, pattern, -1), F.split(compact, ""), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def luhn(d: Column) -> Column:
    """Luhn sum of a digit string, the last digit counting once."""
    n = F.length(d)
    each = F.transform(F.split(d, ""), lambda c, i: F.when((n - i) % 2 == 1, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + x)


def _mod97(s: Column) -> Column:
    """An IBAN's letters and digits as a number modulo 97, the first four at the end."""
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    value = F.transform(F.split(turned, ""), lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda acc, v: F.when(v > 9, acc * 100 + v).otherwise(acc * 10 + v) % 97)


def _mail(m: Column, key: str) -> Column:
    last = F.length(F.substring_index(m, ".", -1)) + 1
    return F.concat(permute_text(F.substring(m, F.lit(1), F.length(m) - last), key, F.lit("mail")), F.substring(m, F.length(m) - last + 1, last))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    v = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)
    moved = F.transform(F.array(permute_number(v, 65536, 65536, key, F.lit("ip"))), lambda p: F.concat_ws(".", *[F.pmod(F.floor(p / (1 << s)), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))
    return F.when(F.forall(parts, lambda x: x < 256) & ~m.rlike(r"(^|\.)0\d"), moved[0])


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = permute_text(F.substring(d, F.lit(1), F.length(d) - 1), key, F.concat(F.lit("card"), F.length(d)))
    done = F.transform(F.array(body), lambda x: F.concat(x, F.pmod(-luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))
    return F.when(luhn(d) % 10 == 0, _refill(m, r"\d", done[0]))


def _iban(m: Column, key: str) -> Column:
    s = F.regexp_replace(m, " ", "")
    body = permute_text(F.substring(s, F.lit(5), F.length(s)), key, F.concat(F.lit("iban"), F.substring(s, 1, 2)))
    done = F.transform(F.array(body), lambda x: F.concat(F.substring(s, 1, 2), F.lpad((98 - _mod97(F.concat(F.substring(s, 1, 2), F.lit("00"), x))).cast("string"), 2, "0"), x))
    return F.when((F.length(s) >= 15) & (_mod97(s) == 1), _refill(m, "[A-Z0-9]", done[0]))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    v = index.cast("long") * (99 * 9999) + (group - 1) * 9999 + serial - 1
    def show(p: Column) -> Column:
        i = F.floor(p / (99 * 9999))
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in ((F.when(i >= 665, i + 2).otherwise(i + 1), 3), (F.pmod(F.floor(p / 9999), F.lit(99)) + 1, 2), (F.pmod(p, F.lit(9999)) + 1, 4))])

    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, F.transform(F.array(permute_number(v, 898, 99 * 9999, key, F.lit("ssn"))), show)[0])


def _date(m: Column, key: str) -> Column:
    """A day among those that could be written alike: with `days` days of `months` months, days from `least` on."""
    p = F.split(m, "[-/.]")
    first, second, third = (F.get(p, i).cast("int") for i in range(3))
    iso, digits = m.rlike(r"^\d{4}-"), (F.length(F.get(p, 0)), F.length(F.get(p, 1)))

    def exists(year: Column, month: Column, day: Column) -> Column:
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        length = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
        return year.between(_YEARS[0], sum(_YEARS) - 1) & month.between(1, 12) & day.between(1, length)

    def moved(year: Column, month: Column, day: Column, months: Column, days: Column, least: int, order: str) -> Column:
        """Pseudonym as (year, month, day)."""
        tweak = F.concat(F.lit(f"date{order}"), months.cast("string"), F.lit("x"), days.cast("string"))

        def split(v: Column) -> Column:
            return F.struct((F.floor(v / (months * days)) + _YEARS[0]).cast("int").alias("y"), (F.pmod(F.floor(v / days), months) + 1).cast("int").alias("m"), (F.pmod(v, days) + least).cast("int").alias("d"))

        def walk(acc: Column, i: Column) -> Column:
            at = split(acc)
            return F.when((i > 1) & exists(at["y"], at["m"], at["d"]), acc).otherwise(permute_number(acc, _YEARS[1], months * days, key, tweak))

        start = (((year - _YEARS[0]) * months + month - 1) * days + day - least).cast("long")
        return _let(F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), start, walk), split)

    def show(layout: str):
        width = {layout[0]: digits[0], layout[1]: digits[1]} if layout[0] != "y" else {"m": F.lit(2), "d": F.lit(2)}
        between = F.when(m.contains("/"), "/").when(m.contains("."), ".").otherwise("-")
        one = lambda x, k: F.lpad(x[k].cast("string"), width.get(k, F.lit(4)), "0")
        return lambda x: F.concat(one(x, layout[0]), between, one(x, layout[1]), between, one(x, layout[2]))

    def wide(n: Column, two: int) -> Column:
        return F.when(n == 1, 9).otherwise(two)

    forms = [
        (iso, (first, second, third), F.lit(12), F.lit(31), 1, "ymd"),
        (~iso, (third, second, first), wide(digits[1], 12), wide(digits[0], 31), 1, "dmy"),
        (~iso & m.contains("/") & (second > 12), (third, first, second), wide(digits[0], 12), F.lit(19), 13, "mdy"),
    ]
    out = F.lit(None).cast("string")
    for case, ymd, months, days, least, layout in reversed(forms):
        out = F.when(case & exists(*ymd), _let(moved(*ymd, months, days, least, layout), show(layout))).otherwise(out)
    return out


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    keep = F.greatest(F.length(d) - 10, F.lit(0))
    return F.when(F.length(d).between(8, 15), _refill(m, r"\d", F.concat(F.substring(d, F.lit(1), keep), permute_text(F.substring(d, keep + 1, F.length(d)), key, F.lit("phone")))))


_MOVES = {"mail": _mail, "ip": _ip, "iban": _iban, "ssn": _ssn, "date": _date, "phone": _phone, "card": _card}


def kind_of(m: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        out = F.when(m.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def pseudonyms(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """df with column text pseudonymised and pii (kind, value's place among the finds, pseudonym) of what was replaced."""
    df = df.drop("pii")
    named = plain(df, text)  # so that no column of df is taken for one of these
    found = named.withColumn("finds_", F.when(F.col(text).rlike(r"[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))

    def move(m: Column, kind: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, f in _MOVES.items():
            out = F.when(kind == name, f(m, key)).otherwise(out)
        return out

    some = F.size("finds_") > 0
    found = found.withColumn("kinds_", F.when(some, F.transform("finds_", kind_of)))
    found = found.withColumn("moved_", F.when(some, F.zip_with("finds_", "kinds_", move)))
    between = F.split(text, ANY, -1)
    put = F.zip_with(between, F.zip_with("moved_", "finds_", lambda a, b: F.coalesce(a, b)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    listed = F.filter(F.transform(F.arrays_zip("kinds_", "moved_"), lambda x, i: F.struct(x["kinds_"].alias("kind"), i.alias("place"), x["moved_"].alias("pseudonym"))), lambda x: x["pseudonym"].isNotNull())
    empty = F.array().cast("array<struct<kind:string,place:int,pseudonym:string>>")
    out = found.select(*[F.when(some, F.array_join(put, "")).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in named.columns], F.when(some, listed).otherwise(empty).alias("pii"))
    return out.toDF(*df.columns, "pii")


def query(docs: DataFrame, key: str = "a key of the deployment") -> DataFrame:
    out = pseudonyms(docs.select("doc_id", "text"), key)
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"), F.array_join(F.array_sort(F.transform("pii", lambda x: x["kind"])), ",").alias("kinds"))
