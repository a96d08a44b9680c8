"""Format-preserving pseudonyms for personal data, in Spark expressions only.

Values are found by pattern, validated (Luhn checksum, octet ranges, calendar,
ranges of social numbers) and replaced by a keyed Feistel permutation of their own
domain: a card stays a valid card with its separators, an address stays an
address, a date a date.  A permutation maps equal values to equal pseudonyms
and different ones to different ones, so records stay linked across documents.

Numbers live in a domain of ``a * b`` values: a value is the pair (v div b,
v mod b), and each round adds a keyed hash of one half to the other, modulo
that half's size; this permutes the domain exactly, without cycle walking.
Mail names and secrets are permuted as strings: each round adds a keyed hash
of one half to the letters and digits of the other, each within its class.

Defined results: null texts stay null with 0 values; empty texts stay empty;
texts are read whole; values that fail their validation stay as they are;
dates are found as yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy and dd/mm/yyyy (1800 to 2199), phones as ten
digits in the common North American forms with or without +1, other countries' not at all;
the key is a secret of the caller's, ``KEY`` only an example;
numbers with one blank or hyphen between them are one run, in which cards and
other values are found between separators;
repeated rows get the same result; empty tables give empty results; other
columns are carried or ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "change-me"
ROUNDS = 8

#: Kinds in the order in which they are tried at a place in the text.
PATTERNS = {
    "mail": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "secret": r"\b[0-9a-fA-F]{32,}\b",
    "date": r"\b(?:1[89]|2[01])\d\d-\d\d-\d\d(?=T\d|\b)|\b\d\d/\d\d/(?:1[89]|2[01])\d\d\b|\b\d\d\.\d\d\.(?:1[89]|2[01])\d\d\b",
    "card": r"\b\d(?:[ -]?\d){12,}+\b",
    "address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "phone": r"(?:\+1 ?)?\(\d{3}\) ?\d{3}-\d{4}\b|(?:\+1[ .-]?|\b)\d{3}[.-]\d{3}[.-]\d{4}\b|\+1 ?\d{3} ?\d{3} ?\d{4}\b",
    "social": r"\b\d{3}-\d{2}-\d{4}\b",
}
ANY = "|".join(f"(?:{x})" for x in PATTERNS.values())
#: Signs (not characters) put around the cards of a text before its values are replaced.
OPEN, CLOSE = "\ufdd0", "\ufdd1"
VALUES = PATTERNS | {"card": f"{OPEN}[0-9 -]+{CLOSE}"}
SOME = "|".join(f"(?:{x})" for x in VALUES.values())


def _column(x: Column | int | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _hash(key: str, kind: Column | str, step: int, half: Column) -> Column:
    """60 keyed bits."""
    text = F.concat(F.lit(f"{key}|"), _column(kind), F.lit(f"|{step}|"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("bigint")


def _then(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value computed once."""
    return F.transform(F.array(value), f)[0]


def pair(left: Column, right: Column, a: Column | int, b: Column | int, key: str, kind: Column | str, out: Callable[[Column, Column], Column]) -> Column:
    """The pair (left < a, right < b) permuted, as ``out(left, right)``."""
    state = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    a, b = _column(a), _column(b)
    # A step's number is bound by a call: a second parameter of the lambda would get Spark's index column.
    def left_round(step: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(F.pmod(s["l"] + F.pmod(_hash(key, kind, step, s["r"]), a), a).alias("l"), s["r"].alias("r"))

    def right_round(step: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(_hash(key, kind, step, s["l"]), b), b).alias("r"))

    for step in range(ROUNDS):
        state = _then(state, left_round(step) if step % 2 == 0 else right_round(step))
    return _then(state, lambda s: out(s["l"], s["r"]))


def _padded(v: Column, width: int | Column) -> Column:
    return F.lpad(v.cast("string"), width, "0")


def luhn(digits: Column) -> Column:
    """The sum of a card's digits, every second from the right doubled."""
    back = F.reverse(digits)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + _then(back.substr(i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))


def refill(shape: Column, digits: Column) -> Column:
    """The digits of ``shape`` replaced in order by ``digits``."""
    start = F.struct(F.lit("").alias("t"), F.lit(1).alias("i"))
    return F.aggregate(
        F.split(shape, ""), start,
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["t"], digits.substr(s["i"], F.lit(1))).alias("t"), (s["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["i"].alias("i"))),
        lambda s: s["t"],
    )


def card(v: Column, key: str) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")

    def permuted(body: Column) -> Column:
        # All but the check digit, as two halves of equal or nearly equal length (6 to 9 digits).
        n = F.length(body)
        lo, ten = F.floor(n / 2).cast("int"), F.lit(10.0)
        hi = n - lo
        return pair(body.substr(F.lit(1), lo), body.substr(lo + 1, hi), F.pow(ten, lo).cast("bigint"), F.pow(ten, hi).cast("bigint"), key, F.concat(F.lit("card"), n.cast("string")), lambda x, y: F.concat(_padded(x, lo), _padded(y, hi)))

    def checked(body: Column) -> Column:
        return F.concat(body, F.pmod(10 - luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))

    new = _then(_then(digits, lambda d: permuted(d.substr(F.lit(1), F.length(d) - 1))), checked)
    return F.when(luhn(digits) % 10 == 0, _then(new, lambda d: refill(v, d))).otherwise(v)


def marked(v: Column) -> Column:
    """A run of digits with its cards between signs: from its start, the longest part between separators that is valid, and so on.

    A run of up to 19 digits without any is one invalid card, unless it holds a value of another kind.
    """
    ok = lambda t: _then(F.regexp_replace(t, "[^0-9]", ""), lambda d: F.when(F.length(d).between(13, 19), luhn(d) % 10 == 0).otherwise(False))

    def whole(ps: Column) -> Column:
        # Digits and separators in turn.
        at = lambda i, j: F.array_join(F.slice(ps, i, j - i + 1), "")
        end = lambda i: F.array_max(F.filter(F.sequence(i, F.least(i + 36, F.size(ps)), F.lit(2)), lambda j: ok(at(i, j))))

        def step(s: Column, i: Column) -> Column:
            plain = F.struct(F.concat(s["t"], F.element_at(ps, i)).alias("t"), (i + 1).alias("i"))
            found = lambda e: F.when(e.isNull(), plain).otherwise(F.struct(F.concat(s["t"], F.lit(OPEN), at(i, e), F.lit(CLOSE)).alias("t"), (e + 1).alias("i")))
            return F.when(i < s["i"], s).when(i % 2 == 0, plain).otherwise(_then(end(i), found))

        return F.aggregate(F.sequence(F.lit(1), F.size(ps)), F.struct(F.lit("").alias("t"), F.lit(1).alias("i")), step, lambda s: s["t"])

    one = ~v.rlike("|".join(f"(?:{x})" for k, x in PATTERNS.items() if k != "card")) & (F.length(F.regexp_replace(v, "[^0-9]", "")) <= 19)
    return _then(whole(F.split(v, "(?<=[ -])|(?=[ -])")), lambda t: F.when(~t.contains(OPEN) & one, F.concat(F.lit(OPEN), v, F.lit(CLOSE))).otherwise(t))


def address(v: Column, key: str) -> Column:
    def go(o: Column) -> Column:
        n = [o[k].cast("int") for k in range(4)]
        valid = F.forall(o, lambda x: (x.cast("int") <= 255) & (x == x.cast("int").cast("string")))
        new = pair(n[0] * 256 + n[1], n[2] * 256 + n[3], 1 << 16, 1 << 16, key, "address", lambda x, y: F.concat_ws(".", F.shiftright(x, 8).cast("string"), (x % 256).cast("string"), F.shiftright(y, 8).cast("string"), (y % 256).cast("string")))
        return F.when(valid, new).otherwise(v)

    return _then(F.split(v, r"\."), go)


#: The days of 1800-01-01 to 2199-12-31, a full period of the calendar: 400 years are 189 * 773 days.
FIRST_DAY = -62091
FORMS = ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy")


def date(v: Column, key: str) -> Column:
    """A day as year-month-day, day.month.year or month/day/year, or day/month/year where that is the only reading; each form is permuted in itself."""

    def written(form: str) -> Column:
        day = F.datediff(F.try_to_timestamp(v, F.lit(form)).cast("date"), F.lit("1970-01-01").cast("date")) - FIRST_DAY
        new = _then(day, lambda d: pair(F.floor(d / 773), F.pmod(d, F.lit(773)), 189, 773, key, "date" if form == FORMS[0] else form, lambda x, y: F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (x * 773 + y + FIRST_DAY).cast("int")), form)))
        return F.when(day.isNotNull(), new)

    slashed = F.coalesce(written(FORMS[2]), written(FORMS[3]), v)
    return F.when(v.contains("-"), F.coalesce(written(FORMS[0]), v)).when(v.contains("."), F.coalesce(written(FORMS[1]), v)).otherwise(slashed)


def phone(v: Column, key: str) -> Column:
    """All ten digits are permuted; the country code and the signs stay."""
    digits = F.substring(F.regexp_replace(v, r"^\+1|[^0-9]", ""), -10, 10)

    def go(d: Column) -> Column:
        new = pair(d.substr(1, 3), d.substr(4, 7), 1000, 10**7, key, "phone", lambda x, y: F.concat(_padded(x, 3), _padded(y, 7)))
        return _then(F.concat(F.when(v.startswith("+1"), F.lit("1")).otherwise(F.lit("")), new), lambda n: refill(v, n))

    return _then(digits, go)


def social(v: Column, key: str) -> Column:
    area, rest = v.substr(1, 3).cast("int"), (v.substr(5, 2).cast("int") - 1) * 9999 + v.substr(8, 4).cast("int") - 1
    valid = (area > 0) & (area < 900) & (area != 666) & (v.substr(5, 2) != "00") & (v.substr(8, 4) != "0000")
    at = area - F.when(area > 666, 2).otherwise(1)
    text = lambda x, y: F.concat_ws("-", _padded(x + F.when(x >= 665, 2).otherwise(1), 3), _padded(F.floor(y / 9999) + 1, 2), _padded(y % 9999 + 1, 4))
    return F.when(valid, pair(at, rest, 898, 99 * 9999, key, "social", text)).otherwise(v)


def string(v: Column, key: str, kind: Column | str, letters: int = 26) -> Column:
    """Letters and digits permuted within their classes; ``letters`` is 6 for hexadecimal."""

    def shifted(c: Column, by: Column) -> Column:
        at = F.ascii(c)
        move = lambda base, n: F.chr(F.pmod(at - base + by, F.lit(n)) + base)
        return F.when(c.rlike("[a-z]"), move(97, letters)).when(c.rlike("[0-9]"), move(48, 10)).when(c.rlike("[A-Z]"), move(65, letters)).otherwise(c)

    def add(half: Column, other: Column, step: int) -> Column:
        # A hash per 8 characters of the half, as many as it takes.
        digest = lambda i: F.sha2(F.concat(F.lit(f"{key}|"), _column(kind), F.lit(f"|{step}|"), F.floor((i - 1) / 8).cast("string"), F.lit("|"), other).cast("binary"), 256)
        one = lambda i: shifted(half.substr(i.cast("int"), F.lit(1)), F.conv(F.substring(digest(i), F.pmod(i - 1, F.lit(8)) * 8 + 1, F.lit(7)), 16, 10).cast("bigint"))
        return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), one), ""))

    cut_at = F.floor(F.length(v) / 2).cast("int")
    state = F.struct(v.substr(F.lit(1), cut_at).alias("l"), v.substr(cut_at + 1, F.length(v)).alias("r"))

    def left_round(step: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(add(s["l"], s["r"], step).alias("l"), s["r"].alias("r"))

    def right_round(step: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["l"].alias("l"), add(s["r"], s["l"], step).alias("r"))

    for step in range(4):
        state = _then(state, left_round(step) if step % 2 == 0 else right_round(step))
    return _then(state, lambda s: F.concat(s["l"], s["r"]))


def mail(v: Column, key: str) -> Column:
    at = F.instr(v, "@")
    # The host takes part, so that one-letter names of different hosts move apart.
    return F.concat(string(v.substr(F.lit(1), at - 1), key, F.concat(F.lit("mail"), v.substr(at, F.length(v)))), v.substr(at, F.length(v)))


def pseudonym(v: Column, key: str) -> Column:
    make = {"mail": mail, "secret": lambda x, k: string(x, k, "secret", 6), "card": lambda x, k: card(F.translate(x, OPEN + CLOSE, ""), k), "address": address, "date": date, "phone": phone, "social": social}
    out = None
    for kind, pattern in VALUES.items():
        hit = v.rlike(f"^(?:{pattern})$")
        out = F.when(hit, make[kind](v, key)) if out is None else out.when(hit, make[kind](v, key))
    return out.otherwise(v)


def replaced(docs: DataFrame, key: str = KEY, text: str = "text", found: str = "__found", new: str = "__new") -> DataFrame:
    """``docs`` with its text rewritten, and the values found and their pseudonyms as arrays."""
    t, runs = F.col(text), PATTERNS["card"]
    woven = lambda x, pattern, values: F.array_join(F.transform(F.arrays_zip(F.split(x, pattern, -1).alias("a"), values.alias("b")), lambda z: F.concat(z["a"], F.coalesce(z["b"], F.lit("")))), "")
    cards = F.transform(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), lambda v: F.when(v.rlike(f"^(?:{runs})$") & ~v.rlike(f"^(?:{PATTERNS['secret']})$"), marked(v)).otherwise(v))
    rows = docs.withColumn("__text", F.when(t.rlike(runs), woven(t, ANY, cards)).otherwise(t))
    m = F.col("__text")
    rows = rows.withColumn(found, F.when(m.rlike("[0-9@]|[a-fA-F]{32}"), F.regexp_extract_all(m, F.lit(SOME), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn(new, F.when(F.size(found) > 0, F.transform(found, lambda v: pseudonym(v, key))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn(found, F.transform(found, lambda v: F.translate(v, OPEN + CLOSE, "")))
    return rows.withColumn(text, F.when(F.size(found) > 0, woven(m, SOME, F.col(new))).otherwise(t)).drop("__text")


def pseudonymise(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    return replaced(docs, key, text).select(*docs.columns)


def op3(docs: DataFrame) -> DataFrame:
    """doc_id, the rewritten text, how many values were found and how many were replaced."""
    rows = replaced(docs.select("doc_id", "text"))
    changed = F.size(F.filter(F.arrays_zip(F.col("__found").alias("a"), F.col("__new").alias("b")), lambda z: z["a"] != z["b"]))
    return rows.select("doc_id", "text", F.size("__found").cast("bigint").alias("n_found"), changed.cast("bigint").alias("n_replaced"))
