"""Format-preserving Feistel pseudonyms for personal data, Spark expressions only.

A value is first validated (Luhn digit, octet range, calendar).  Its variable part is
then mapped onto itself by an alternating Feistel network keyed with SHA-256, so that
the format stays and equal values stay equal in all documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 6

#: What is looked for, in order of precedence.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{64}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{32})(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])",
    "card": r"(?<![0-9])(?:[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{13,19})(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without these has no match.
HINT = r"[0-9]{2}|[0-9][.A-Fa-f]|@"
#: The Gregorian cycle is 146,097 days = 189 * 773.
CYCLE_START, CYCLE_LEFT, CYCLE_RIGHT = "1800-01-01", 189, 773


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, as a lambda's variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _mix(key: str, kind: str, i: Column, value: Column, modulus: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), value.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A keyed permutation of Z_a x Z_b; a struct of left and right."""
    a, b = a.cast("long"), b.cast("long")

    def step(acc: Column, i: Column) -> Column:
        l2 = F.pmod(acc["left"] + _mix(key, kind, i, acc["right"], a), a)
        return let(l2, lambda x: F.struct(x.alias("left"), F.pmod(acc["right"] + _mix(key, kind, -i, x, b), b).alias("right")))

    start = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column, doubled_from: int) -> Column:
    """Digit sum in which every second digit from the right is doubled, beginning
    with the last (doubled_from 1) or the one before it (2)."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == doubled_from % 2, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add)


def _refill(value: Column, digits: Column) -> Column:
    """value with its digits replaced, in order, by those of digits."""

    def filled(digits: Column) -> Column:
        def put(acc: Column, c: Column) -> Column:
            is_digit = c.between("0", "9")
            return F.struct(
                F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["i"], F.lit(1))).otherwise(c)).alias("out"),
                F.when(is_digit, acc["i"] + 1).otherwise(acc["i"]).alias("i"),
            )

        return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), put, lambda acc: acc["out"])

    return let(digits, filled)


def card(value: Column, key: str) -> Column:
    """All digits but the last are permuted; the last makes the Luhn sum right."""

    def permuted(digits: Column) -> Column:
        n = F.char_length(digits)
        low = F.floor((n - 1) / 2).cast("int")
        a, b = F.pow(F.lit(10.0), n - 1 - low).cast("long"), F.pow(F.lit(10.0), low).cast("long")
        got = feistel(F.substring(digits, F.lit(1), n - 1 - low).cast("long"), F.substring(digits, n - low, low).cast("long"), a, b, key, "card")
        pad = lambda x, size: F.lpad(x.cast("string"), size, F.lit("0"))
        body = let(got, lambda g: F.concat(pad(g["left"], n - 1 - low), pad(g["right"], low)))
        whole = let(body, lambda x: F.concat(x, F.pmod(-luhn_sum(x, 1), F.lit(10)).cast("string")))
        return F.when(luhn_sum(digits, 2) % 10 == 0, _refill(value, whole))

    return let(_digits(value), permuted)


def ip(value: Column, key: str) -> Column:
    o = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    got = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")

    def dotted(g: Column) -> Column:
        parts = [F.floor(g["left"] / 256), g["left"] % 256, F.floor(g["right"] / 256), g["right"] % 256]
        return F.concat_ws(".", *[p.cast("long").cast("string") for p in parts])

    return F.when(F.forall(o, lambda x: x < 256), let(got, dotted))


def phone(value: Column, key: str) -> Column:
    """The area and the last seven digits are permuted; +1 and separators stay."""
    digits = F.right(_digits(value), F.lit(10))
    got = feistel(F.substring(digits, 1, 3), F.substring(digits, 4, 7), F.lit(1000), F.lit(10_000_000), key, "phone")
    fresh = let(got, lambda g: F.concat(F.lpad(g["left"].cast("string"), 3, "0"), F.lpad(g["right"].cast("string"), 7, "0")))
    country = F.char_length(_digits(value)) == 11
    return _refill(value, F.when(country, F.concat(F.lit("1"), fresh)).otherwise(fresh))


def ssn(value: Column, key: str) -> Column:
    """Valid numbers only: area 001-899 but 666, group 01-99, serial 0001-9999."""
    area = F.substring(value, 1, 3).cast("long")
    group, serial = F.substring(value, 5, 2).cast("long"), F.substring(value, 8, 4).cast("long")
    left = area - 1 - F.when(area > 666, 1).otherwise(0)
    got = feistel(left, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")

    def joined(g: Column) -> Column:
        fresh = g["left"] + 1 + F.when(g["left"] + 1 >= 666, 1).otherwise(0)
        return F.format_string("%03d-%02d-%04d", fresh, (F.floor(g["right"] / 9999) + 1).cast("long"), (g["right"] % 9999 + 1).cast("long"))

    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), let(got, joined))


def date(value: Column, key: str) -> Column:
    """Dates from 1800 to 2199, permuted among those days.  yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy."""
    parts = F.when(value.contains("-"), value)
    parts = parts.when(value.contains("."), F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2)))
    iso = parts.otherwise(F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 1, 2), F.substring(value, 4, 2)))
    day = F.try_to_date(iso, "yyyy-MM-dd")
    n = F.datediff(day, F.lit(CYCLE_START).cast("date"))
    got = feistel(F.floor(n / CYCLE_RIGHT), n % CYCLE_RIGHT, F.lit(CYCLE_LEFT), F.lit(CYCLE_RIGHT), key, "date")
    fresh = let(got, lambda g: F.date_add(F.lit(CYCLE_START).cast("date"), (g["left"] * CYCLE_RIGHT + g["right"]).cast("int")))

    def written(x: Column) -> Column:
        y, m, d = F.date_format(x, "yyyy"), F.date_format(x, "MM"), F.date_format(x, "dd")
        dashed = F.when(value.contains("-"), F.concat_ws("-", y, m, d))
        return dashed.when(value.contains("."), F.concat_ws(".", d, m, y)).otherwise(F.concat_ws("/", m, d, y))

    return F.when(day.isNotNull() & (n >= 0) & (n < CYCLE_LEFT * CYCLE_RIGHT), let(fresh, written))


def letters(value: Column, key: str, kind: str, alphabets: list[str]) -> Column:
    """A Feistel network on the halves of a string: each half is shifted, character by
    character within its alphabet, by a key stream made from the other half.
    Characters of no alphabet stay.  At most 128 characters."""
    half = F.floor(F.char_length(value) / 2).cast("int")

    def shifted(text: Column, other: Column, i: Column) -> Column:
        def one(stream: Column, c: Column, at: Column) -> Column:
            k = F.conv(F.substring(stream, 2 * at + 1, F.lit(2)), 16, 10).cast("int")
            out = c
            for abc in alphabets:
                here = F.instr(F.lit(abc), c)
                out = F.when((c != "") & (here > 0), F.substring(F.lit(abc), F.pmod(here - 1 + k, F.lit(len(abc))) + 1, F.lit(1))).otherwise(out)
            return out

        made = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other), 512)
        return let(made, lambda stream: F.array_join(F.transform(F.split(text, ""), lambda c, at: one(stream, c, at)), ""))

    def step(acc: Column, i: Column) -> Column:
        return let(shifted(acc["left"], acc["right"], i), lambda x: F.struct(x.alias("left"), shifted(acc["right"], x, -i).alias("right")))

    start = F.struct(F.substring(value, F.lit(1), half).alias("left"), F.substring(value, half + 1, F.char_length(value)).alias("right"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.concat(acc["left"], acc["right"]))


def email(value: Column, key: str) -> Column:
    """The local part is permuted within letters and digits; the domain stays."""
    abc = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"]
    local = F.substring_index(value, "@", 1)
    return F.concat(letters(local, key, "email", abc), F.lit("@"), F.substring_index(value, "@", -1))


def secret(value: Column, key: str) -> Column:
    """Hexadecimal keys stay hexadecimal; case of the whole is kept."""
    lower = letters(F.lower(value), key, "secret", ["0123456789abcdef"])
    return F.when(value == F.upper(value), F.upper(lower)).otherwise(lower)


MAKERS = {"email": email, "secret": secret, "ip": ip, "phone": phone, "ssn": ssn, "date": date, "card": card}


def pseudonymise(docs: DataFrame, key: str | Column, text_col: str = "text", count_cols: bool = False) -> DataFrame:
    """docs with its texts pseudonymised; all other columns stay as they are.

    key is a string, or a column such as a scalar subquery, so that the key itself is in
    no plan.  Null text stays null.  Values that fail validation stay as they are.  With
    count_cols, columns n_<kind> tell how many values of each kind were replaced;
    columns of those names are replaced.
    """
    if count_cols:
        docs = docs.select(*[c for c in docs.columns if c.lower() not in {f"n_{k}" for k in PATTERNS} or c == text_col])
    text, found_col, new_col = F.col(text_col), fresh(docs, "_found"), fresh(docs, "_new")
    columns = docs.columns
    if isinstance(key, Column):  # bound as a column, which lambdas may refer to
        key_col = fresh(docs, "_key")
        docs, key = docs.withColumn(key_col, key), F.col(key_col)

    def told(m: Column) -> Column:
        out = kind = None
        for name, pattern in PATTERNS.items():
            mine = m.rlike(f"^(?:{pattern})$")
            fresh = MAKERS[name](m, key)
            out = F.when(mine, fresh) if out is None else out.when(mine, fresh)
            kind = F.when(mine, name) if kind is None else kind.when(mine, name)
        return F.struct(kind.alias("kind"), m.alias("old"), out.alias("new"))

    found = F.when(text.rlike(HINT) & text.rlike(ANY), F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), told))
    marked = docs.withColumn(found_col, found)
    pieces = F.split(text, ANY, -1)
    filled = F.zip_with(pieces, F.col(found_col), lambda p, m: F.concat(p, F.coalesce(m["new"], m["old"], F.lit(""))))
    out = marked.withColumn(new_col, F.when(F.col(found_col).isNotNull(), F.array_join(filled, "")).otherwise(text))

    def count_of(kind: str) -> Column:
        replaced = F.filter(found_col, lambda m: (m["kind"] == kind) & m["new"].isNotNull())
        return F.when(F.col(found_col).isNull(), 0).otherwise(F.size(replaced)).cast("long").alias(f"n_{kind}")

    counts = [count_of(k) for k in PATTERNS]
    kept = [F.col(new_col).alias(c) if c == text_col else F.col(c) for c in columns]
    return out.select(*kept, *(counts if count_cols else []))
