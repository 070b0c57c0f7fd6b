"""Format-preserving pseudonyms of personal data; only DataFrame functions, no Python on the executors.

A value is permuted within its format by a keyed Feistel network, so equal values get equal pseudonyms in every
document, different values of one format get different ones, and whoever has the key can undo it. What is permuted
is the value and not its spelling: a number's digits without separators or country code, a name or secret in small
letters; the separators, country code and capitals of the place are put back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

ROUNDS = 10
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: A whole cycle of the Gregorian calendar, 1800 to 2199: 146,097 days, 189 times 773.
FIRST_DAY, DAYS_HIGH, DAYS_LOW = "1800-01-01", 189, 773

#: What may be personal data. Every pattern starts where no word goes on and can't run twice over the same text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?<![\w-])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,48})(?![\w-])",
    "card": r"(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\w-])",
    "ip": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])",
    "date": r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\w/-])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w.+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![\w-])"
    r"|(?<![\w.+-])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![\w-])",
}
#: The only back reference, to the separator of a card, gets its number in the whole pattern.
PATTERN = "|".join(PATTERNS.values())


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("bigint")


def _code(key: str, kind: str | Column, turn: Column, half: Column) -> Column:
    """64 hex digits that depend on the key, the kind of value, the round and the other half."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.sha2(F.concat_ws("|", F.lit(key), kind, turn.cast("string"), half.cast("string")), 256)


def feistel_number(value: Column, high: int, low: int, key: str, kind: str | Column) -> Column:
    """Permutes whole numbers from 0 to high * low - 1."""

    def turn(s: Column, i: Column) -> Column:
        a, b = s["a"], s["b"]
        mixed = F.when(i % 2 == 0, _number(F.substring(_code(key, kind, i, b), 1, 12)) % high)
        mixed = mixed.otherwise(_number(F.substring(_code(key, kind, i, a), 1, 12)) % low)
        return F.struct(
            F.when(i % 2 == 0, (a + mixed) % high).otherwise(a).alias("a"),
            F.when(i % 2 == 0, b).otherwise((b + mixed) % low).alias("b"),
        )

    value = value.cast("bigint")
    halves = F.struct(F.floor(value / low).cast("bigint").alias("a"), (value % low).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn, lambda s: s["a"] * low + s["b"])


def _shift(half: Column, code: Column, hexadecimal: Column) -> Column:
    """Moves each letter and digit within its alphabet by two hex digits of the code; other characters stay."""

    def one(k: Column) -> Column:
        c = F.substr(half, k, F.lit(1))
        by = _number(F.substr(code, (k - 1) % 32 * 2 + 1, F.lit(2)))

        def within(alphabet: str) -> Column:
            at = (F.instr(F.lit(alphabet), c) - 1 + by) % len(alphabet) + 1
            return F.substr(F.lit(alphabet), at.cast("int"), F.lit(1))

        return (
            F.when(hexadecimal & c.between("0", "f") & F.contains(F.lit(HEX), c), within(HEX))
            .when(hexadecimal, within(HEX.upper()))
            .when(c.between("0", "9"), within(DIGITS))
            .when(c.between("a", "z"), within(LOWER))
            .when(c.between("A", "Z"), within(UPPER))
            .otherwise(c)
        )

    ks = F.when(F.length(half) > 0, F.sequence(F.lit(1), F.length(half))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(ks, one), "")


def feistel_text(value: Column, key: str, kind: Column, hexadecimal: Column) -> Column:
    """Permutes strings of one layout: digits, small and capital letters (or hex digits) stay what they are."""
    cut = F.floor(F.length(value) / 2).cast("int")
    halves = F.struct(
        F.substr(value, F.lit(1), cut).alias("a"), F.substr(value, cut + 1, F.length(value)).alias("b")
    )

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        moved = _shift(F.when(even, s["a"]).otherwise(s["b"]), _code(key, kind, i, F.when(even, s["b"]).otherwise(s["a"])), hexadecimal)
        return F.struct(F.when(even, moved).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(moved).alias("b"))

    both = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn, lambda s: F.concat(s["a"], s["b"]))
    return F.when(F.length(value) == 1, feistel_character(value, key, kind, hexadecimal)).otherwise(both)


def feistel_character(value: Column, key: str, kind: Column, hexadecimal: Column) -> Column:
    """Permutes the alphabet of a single character, which has no halves: its place is the number."""

    def within(alphabet: str) -> Column:
        at = feistel_number(F.instr(F.lit(alphabet), value) - 1, len(alphabet) // 2, 2, key, kind)
        return F.substr(F.lit(alphabet), (at + 1).cast("int"), F.lit(1))

    return (
        F.when(hexadecimal & F.contains(F.lit(HEX), value), within(HEX))
        .when(value.between("0", "9"), within(DIGITS))
        .when(value.between("a", "z"), within(LOWER))
        .when(value.between("A", "Z"), within(UPPER))
        .otherwise(value)
    )


def luhn_digit(body: Column) -> Column:
    """The check digit that makes a string of digits, with it, pass the Luhn test."""
    plain = F.regexp_replace(body, "[^0-9]", "")

    def add(total: Column, k: Column) -> Column:
        d = F.substr(plain, F.length(plain) + 1 - k, F.lit(1)).cast("int") * (1 + k % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(1), F.length(plain)), F.lit(0), add)
    return ((10 - total % 10) % 10).cast("string")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _body(m: Column) -> Column:
    return F.substr(m, F.lit(1), F.length(m) - 1)


def _laid_out(m: Column, digits: Column) -> Column:
    """m with its digits replaced by others, one by one."""
    return F.array_join(F.transform(F.split(m, "[0-9]", -1), lambda p, i: F.concat(p, F.substr(digits, i + 1, F.lit(1)))), "")


def _cased(like: Column, lower: Column) -> Column:
    """Small letters as capitals where another string has capitals."""
    ks = F.when(F.length(lower) > 0, F.sequence(F.lit(1), F.length(lower))).otherwise(F.array().cast("array<int>"))

    def one(k: Column) -> Column:
        c = F.substr(lower, k, F.lit(1))
        return F.when(F.substr(like, k, F.lit(1)).between("A", "Z"), F.upper(c)).otherwise(c)

    return F.array_join(F.transform(ks, one), "")


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    body = feistel_text(_body(digits), key, F.concat(F.lit("card:"), F.length(digits).cast("string")), F.lit(False))
    return let(body, lambda b: let(F.concat(b, luhn_digit(b)), lambda new: _laid_out(m, new)))


def _phone(m: Column, key: str) -> Column:
    """The national number is permuted, so it is the same with and without a country code, which stays."""
    country = F.regexp_extract(m, r"^(\+1(?=[0-9]{10}$)|\+[0-9]{1,3}(?=[ .(-]))", 1)
    rest = F.substr(m, F.length(country) + 1, F.length(m))
    digits = _digits(rest)
    new = feistel_text(digits, key, F.concat(F.lit("phone:"), F.length(digits).cast("string")), F.lit(False))
    return F.concat(country, let(new, lambda d: _laid_out(rest, d)))


#: Social security numbers that are given out: areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999.
AREAS, GROUPS, SERIALS = 898, 99, 9999


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = [F.split_part(m, F.lit("-"), F.lit(k)).cast("bigint") for k in (1, 2, 3)]
    n = ((area - F.when(area > 666, 2).otherwise(1)) * GROUPS + group - 1) * SERIALS + serial - 1

    def spelled(n: Column) -> Column:
        area = F.floor(n / (GROUPS * SERIALS)) + 1
        parts = (area + (area >= 666).cast("int"), 3), (F.floor(n / SERIALS) % GROUPS + 1, 2), (n % SERIALS + 1, 4)
        return F.concat_ws("-", *[F.lpad(x.cast("string"), w, "0") for x, w in parts])

    return let(feistel_number(n, AREAS * GROUPS, SERIALS, key, "ssn"), spelled)


def _email(m: Column, key: str) -> Column:
    """The name is permuted, whatever its case; the domain stays."""
    name, domain = F.split_part(m, F.lit("@"), F.lit(1)), F.split_part(m, F.lit("@"), F.lit(2))
    new = feistel_text(F.lower(name), key, F.concat(F.lit("email:"), F.lower(domain)), F.lit(False))
    return F.concat(let(new, lambda x: _cased(name, x)), F.lit("@"), domain)


def _secret(m: Column, key: str) -> Column:
    hexadecimal = F.rlike(m, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$"))
    plain = F.when(hexadecimal, F.lower(m)).otherwise(m)
    new = feistel_text(plain, key, F.concat(F.lit("secret:"), F.length(m).cast("string")), hexadecimal)
    return let(new, lambda x: F.when(hexadecimal & F.rlike(m, F.lit("[A-F]")), F.upper(x)).otherwise(x))


def _ip(m: Column, key: str) -> Column:
    o = [F.split_part(m, F.lit("."), F.lit(k)).cast("bigint") for k in (1, 2, 3, 4)]
    n = feistel_number(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 65536, 65536, key, "ip")
    return let(n, lambda x: F.concat_ws(".", *[(F.shiftright(x, s) % 256).cast("string") for s in (24, 16, 8, 0)]))


def _date_order(m: Column) -> Column:
    """Where year, month and day stand; of d/m/y and m/d/y the second, unless only the first is a date."""
    return (
        F.when(F.rlike(m, F.lit("^[0-9]{4}")), F.lit("ymd"))
        .when(F.contains(m, F.lit(".")), F.lit("dmy"))
        .when(F.regexp_extract(m, "^([0-9]+)", 1).cast("int") <= 12, F.lit("mdy"))
        .otherwise(F.lit("dmy"))
    )


def _day(m: Column) -> Column:
    """The day that a date means, or null if there is none in the cycle."""
    p = [F.regexp_extract(m, "([0-9]+)[^0-9]([0-9]+)[^0-9]([0-9]+)", k) for k in (1, 2, 3)]
    order = _date_order(m)
    iso = F.when(order == "ymd", F.concat_ws("-", *p)).when(order == "mdy", F.concat_ws("-", p[2], p[0], p[1])).otherwise(F.concat_ws("-", p[2], p[1], p[0]))
    n = F.date_diff(iso.try_cast("date"), F.lit(FIRST_DAY).cast("date"))
    return F.when(n.between(0, DAYS_HIGH * DAYS_LOW - 1), n)


def _date(m: Column, key: str) -> Column:
    """Another day of the cycle, in the same order and with the same separators; months and days get two digits
    where the year comes first or the original had two digits for each."""
    n = feistel_number(_day(m), DAYS_HIGH, DAYS_LOW, key, "date")
    order, mark = _date_order(m), F.regexp_extract(m, "([^0-9])", 1)
    wide = (order == "ymd") | F.rlike(m, F.lit("^[0-9]{2}[^0-9][0-9]{2}[^0-9]"))

    def spelled(d: Column) -> Column:
        month, day = [F.when(wide, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string")) for x in (F.month(d), F.day(d))]
        year = F.lpad(F.year(d).cast("string"), 4, "0")
        return (
            F.when(order == "ymd", F.concat(year, mark, month, mark, day))
            .when(order == "mdy", F.concat(month, mark, day, mark, year))
            .otherwise(F.concat(day, mark, month, mark, year))
        )

    return let(F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int")), spelled)


def kind_of(m: Column) -> Column:
    """What a found string is, or null if it doesn't hold: cards by Luhn, addresses by their octets, dates by the
    calendar, social security numbers by their reserved parts."""
    digits = _digits(m)

    def looks(name: str) -> Column:
        return F.rlike(m, F.lit(f"^(?:{PATTERNS[name]})$"))

    octets = F.forall(F.split(m, "[.]"), lambda x: (x.try_cast("int") <= 255) & (F.length(x) <= 3))
    return (
        F.when(looks("email"), "email")
        .when(looks("card"), F.when(F.substr(digits, F.length(digits), F.lit(1)) == luhn_digit(_body(digits)), "card"))
        .when(looks("secret"), "secret")
        .when(looks("ip"), F.when(octets, "ip"))
        .when(looks("date"), F.when(_day(m).isNotNull(), "date"))
        .when(looks("ssn"), F.when(~F.rlike(m, F.lit("^(000|666|9..)-|-00-|-0000$")), "ssn"))
        .when(looks("phone"), "phone")
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a string of a kind; without a kind the string itself."""
    return (
        F.when(kind == "card", _card(m, key))
        .when(kind == "ip", _ip(m, key))
        .when(kind == "date", _date(m, key))
        .when(kind == "ssn", _ssn(m, key))
        .when(kind == "phone", _phone(m, key))
        .when(kind == "email", _email(m, key))
        .when(kind == "secret", _secret(m, key))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replaces personal data in a text column and adds found, an array of (kind, pseudonym) in text order.

    Numbers and dates that don't hold (see kind_of), dates outside 1800 to 2199 and the domains of mail addresses stay
    as they are. A null text stays null and has nothing
    found, an empty one stays empty. Rows are worked on one by one, whole, without a shuffle; a text of any
    length is read a fixed number of times. Other columns stay; one named found is replaced.
    """
    # the pattern's groups: only the card's separator is one
    step = docs.drop("found", "_m", "_k", "_r").withColumn(
        "_m", F.when(F.rlike(text, F.lit("[0-9@]")), F.regexp_extract_all(text, F.lit(PATTERN), 0))
    )
    step = step.withColumn("_k", F.transform("_m", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))))
    step = step.withColumn("_r", F.transform("_k", lambda x: pseudonym(x["m"], x["kind"], key)))
    pieces = F.zip_with(F.split(text, PATTERN, -1), "_r", lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
    kinds = F.zip_with("_k", "_r", lambda k, r: F.struct(k["kind"].alias("kind"), r.alias("pseudonym")))
    none = F.array().cast("array<struct<kind: string, pseudonym: string>>")
    some = F.size("_m") > 0
    return step.select(
        *[F.when(some, F.array_join(pieces, "")).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in docs.columns if c != "found"],
        F.when(some, F.filter(kinds, lambda k: k["kind"].isNotNull())).otherwise(none).alias("found"),
    )


#: A demonstration key for the registered query; callers bring their own.
DEMO_KEY = "demonstration key, not a secret"


def op7_feistel_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and how many values of each kind."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymise(docs, DEMO_KEY)

    def count(*kinds: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"].isin(*kinds))).cast("long")

    return out.select(
        "doc_id",
        "text",
        count("card", "phone", "ssn", "ip").alias("n_numbers"),
        count("date").alias("n_dates"),
        count("email", "secret").alias("n_other"),
    )
