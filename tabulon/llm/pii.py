"""Personal data: format-preserving Feistel pseudonyms. DataFrame operations only.

Validated values are replaced by a keyed permutation of their own format: a card number becomes another card number
with the right check digit, a date another date, so equal values stay linked across documents and texts stay parseable.
A value is a row of symbols with a radix each. Feistel rounds add keyed digests of one half to the other, modulo each
radix, so no round leaves the format and every key gives a bijection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import table

ROUNDS = 8
#: Dates are permuted among the 73,049 days of 1900 to 2099: in 319 x 229 places, of which the last two hold no day.
FIRST_DAY, DAYS, HIGH, LOW = "1900-01-01", 73_049, 319, 229
#: The session setting that holds the key, and the key of sessions without it, which is no secret.
KEY_SETTING, OPEN_KEY = "spark.tabulon.pii.key", "tabulon"

# One pattern per kind, tried in this order at each place.
NOT_IN = r"(?<![0-9A-Za-z])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "date": NOT_IN + r"(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3][0-9]\.[01][0-9]\.(?:19|20)[0-9]{2}|[01][0-9]/[0-3][0-9]/(?:19|20)[0-9]{2})(?![0-9A-Za-z])",
    "ssn": NOT_IN + r"[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?:\+1[ .-]?|(?<![0-9+]))(?:\([2-9][0-9]{2}\) ?|(?<![0-9A-Za-z])[2-9][0-9]{2}[.-]|(?<=\+1[ .-])[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9A-Za-z.])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
KINDS = tuple(PATTERNS)


def let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(symbols: Column, radices: Column, label: Column) -> Column:
    """The permutation keyed by label of a row of whole numbers, each below its radix (arrays of int of one length)."""
    state = "struct<l:array<int>,r:array<int>>"
    half = F.ceil(F.size(symbols) / 2).cast("int")
    begin = F.struct(F.slice(symbols, F.lit(1), half).alias("l"), F.slice(symbols, half + 1, F.greatest(F.size(symbols) - half, F.lit(0))).alias("r")).cast(state)

    def added(to: Column, other: Column, k: Column, first: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", label, k.cast("string"), F.size(symbols).cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ",")), 256)
        noise = lambda d, i: F.conv(F.substring(d, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return let(digest, lambda d: F.transform(to, lambda x, i: F.pmod(x + noise(d, i), F.element_at(radices, (first + i + 1).cast("int"))).cast("int")))

    def step(s: Column, k: Column) -> Column:
        even = F.struct(added(s["l"], s["r"], k, F.lit(0)).alias("l"), s["r"].alias("r")).cast(state)
        odd = F.struct(s["l"].alias("l"), added(s["r"], s["l"], k, half).alias("r")).cast(state)
        return F.when(k % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step, lambda s: F.concat(s["l"], s["r"]))


def _ints(*values: Column) -> Column:
    return F.array(*[F.coalesce(v, F.lit(0)).cast("int") for v in values]).cast("array<int>")


def _digits(value: Column) -> Column:
    return F.transform(F.filter(F.split(F.regexp_replace(value, "[^0-9]", ""), ""), lambda c: c != ""), lambda c: c.cast("int"))


def _filled(template: Column, digits: Column) -> Column:
    """template with its digits replaced, in order, by digits (array of int)."""
    place = lambda i: F.length(F.regexp_replace(F.substring(template, F.lit(1), i), "[^0-9]", ""))
    one = lambda i: F.when(F.substring(template, i, F.lit(1)).rlike("[0-9]"), F.element_at(digits, place(i)).cast("string")).otherwise(F.substring(template, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(template)), one), "")


def _luhn_sum(digits: Column, shift: int) -> Column:
    """Luhn's sum where the last digit's weight is 2 if shift is 1."""
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    weighed = lambda ds: F.transform(ds, lambda d, i: F.when((F.size(ds) - 1 - i + shift) % 2 == 1, doubled(d)).otherwise(d))
    return let(digits, lambda ds: F.aggregate(weighed(ds), F.lit(0), lambda a, x: (a + x).cast("int")))


#: What is taken off the ten digits of a telephone number: area and exchange begin with 2 to 9.
PHONE_LOW = (2, 0, 0, 2, 0, 0, 0, 0, 0, 0)


def _local(m: Column) -> Column:
    return F.transform(F.filter(F.split(F.substring_index(m, "@", 1), ""), lambda c: c != ""), lambda c: F.ascii(c))


def _first(c: Column) -> Column:
    return F.when(c.between(97, 122), 97).when(c.between(65, 90), 65).when(c.between(48, 57), 48).otherwise(c)


def _radix(c: Column) -> Column:
    return F.when(c.between(97, 122) | c.between(65, 90), 26).when(c.between(48, 57), 10).otherwise(1)


def _calendar(m: Column) -> tuple[Column, Column, Column]:
    parts = F.split(m, "[-./]")
    return tuple(F.when(m.contains("-"), parts[i]).when(m.contains("."), parts[j]).otherwise(parts[k]).cast("int") for i, j, k in ((0, 2, 2), (1, 1, 0), (2, 0, 1)))


def symbols_of(m: Column, kind: Column) -> Column:
    """(valid, symbols, radices) of a matched value."""
    digits = _digits(m)
    body = F.slice(digits, F.lit(1), F.size(digits) - 1)
    area, group, serial = (F.substring(m, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    national = _digits(F.regexp_replace(m, r"^\+1", ""))
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("int"))
    y, a, d = _calendar(m)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    month = F.array(*[F.lit(x) for x in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)])
    real = a.between(1, 12) & (d >= 1) & (d <= F.element_at(month, F.greatest(F.lit(1), F.least(F.lit(12), a))) + F.when(leap & (a == 2), 1).otherwise(0))
    day = F.date_diff(F.when(real, F.make_date(y, a, d)), F.lit(FIRST_DAY).cast("date"))
    low = F.array(*[F.lit(x) for x in PHONE_LOW])
    row = lambda valid, symbols, radices: F.struct(F.coalesce(valid, F.lit(False)).alias("valid"), symbols.cast("array<int>").alias("symbols"), radices.cast("array<int>").alias("radices"))
    return (
        F.when(kind == "card", row(_luhn_sum(digits, 0) % 10 == 0, body, F.array_repeat(F.lit(10), F.size(digits) - 1)))
        .when(kind == "phone", row(F.size(national) == 10, F.zip_with(national, low, lambda x, o: x - o), F.transform(low, lambda o: 10 - o)))
        # Area 001 to 899 but 666; group and serial not 0. The area's rank skips 666.
        .when(kind == "ssn", row(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), _ints(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1), _ints(F.lit(898), F.lit(99), F.lit(9999))))
        .when(kind == "ip", row(F.forall(octets, lambda o: o <= 255) & octets[0].between(1, 254), _ints(octets[0] - 1, octets[1], octets[2], octets[3]), _ints(F.lit(254), F.lit(256), F.lit(256), F.lit(256))))
        .when(kind == "date", row(real, _ints(F.floor(day / LOW), day % LOW), _ints(F.lit(HIGH), F.lit(LOW))))
        .otherwise(row(F.lit(True), F.transform(_local(m), lambda c: c - _first(c)), F.transform(_local(m), _radix)))
    )


def shown(m: Column, kind: Column, new: Column) -> Column:
    """A value of m's format with the symbols new."""
    check = F.pmod(10 - _luhn_sum(new, 1) % 10, F.lit(10)).cast("int")
    low = F.array(*[F.lit(x) for x in PHONE_LOW])
    then = F.date_add(F.lit(FIRST_DAY).cast("date"), (new[0] * LOW + new[1]).cast("int"))
    return (
        F.when(kind == "card", let(F.concat(new, F.array(check)), lambda ds: _filled(m, ds)))
        .when(kind == "phone", F.concat(F.regexp_extract(m, r"^(?:\+1)?", 0), let(F.zip_with(new, low, lambda x, o: x + o), lambda ds: _filled(F.regexp_replace(m, r"^\+1", ""), ds))))
        .when(kind == "ssn", F.format_string("%03d-%02d-%04d", new[0] + F.when(new[0] + 1 >= 666, 2).otherwise(1), new[1] + 1, new[2] + 1))
        .when(kind == "ip", F.concat_ws(".", (new[0] + 1).cast("string"), new[1].cast("string"), new[2].cast("string"), new[3].cast("string")))
        .when(kind == "date", F.when(m.contains("-"), F.date_format(then, "yyyy-MM-dd")).when(m.contains("."), F.date_format(then, "dd.MM.yyyy")).otherwise(F.date_format(then, "MM/dd/yyyy")))
        # Letters and digits of a mail name stay letters and digits, by class and case; the domain stays.
        .otherwise(F.concat(F.array_join(F.zip_with(new, F.transform(_local(m), _first), lambda x, o: F.chr((x + o).cast("long"))), ""), F.lit("@"), F.substring_index(m, "@", -1)))
    )


def kind_of(m: Column) -> Column:
    """The kind of a matched value."""
    shapes = {
        "email": m.contains("@"), "date": m.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4})$"), "ssn": m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
        "ip": m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "phone": m.rlike(r"^(?:\+1|\(|[0-9]{3}[.-][0-9]{3}[ .-][0-9]{4}$)"),
    }
    out = F.lit("card")
    for kind in reversed(list(shapes)):
        out = F.when(shapes[kind], F.lit(kind)).otherwise(out)
    return out


def permuted(symbols: Column, radices: Column, kind: Column, label: Column) -> Column:
    """The keyed permutation of a value's symbols. A date that meets a place without a day walks on to the next one: two steps at most."""
    once = lambda row: feistel(row, radices, label)
    walk = lambda row, _: F.when((kind == "date") & (row[0] * LOW + row[1] >= DAYS), once(row)).otherwise(row)
    return F.aggregate(F.array(F.lit(1), F.lit(2)), once(symbols), walk)


def pseudonyms(values: Column, key: str) -> Column:
    """(old, kind, valid, new) of an array of matched values; new is old where the value isn't valid. Each step reads the one before."""
    kinds = F.transform(values, lambda m: F.struct(m.alias("old"), kind_of(m).alias("kind")))
    parsed = F.transform(kinds, lambda s: F.struct(s["old"].alias("old"), s["kind"].alias("kind"), symbols_of(s["old"], s["kind"]).alias("p")))
    tweak = lambda s: F.when(s["kind"] == "email", F.substring_index(s["old"], "@", -1)).otherwise(F.lit(""))
    label = lambda s: F.concat(F.lit(f"{key}|"), s["kind"], F.lit("|"), tweak(s))
    moved = F.transform(parsed, lambda s: F.struct(s["old"].alias("old"), s["kind"].alias("kind"), s["p"]["valid"].alias("valid"), F.when(s["p"]["valid"], permuted(s["p"]["symbols"], s["p"]["radices"], s["kind"], label(s))).alias("new")))
    return F.transform(moved, lambda s: F.struct(s["old"].alias("old"), s["kind"].alias("kind"), s["valid"].alias("valid"), F.when(s["valid"], shown(s["old"], s["kind"], s["new"])).otherwise(s["old"]).alias("new")))


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """docs with personal data in text replaced, and pii_<kind>: how many valid values of each kind it holds.

    Null texts stay null, without values. Values that fail validation stay. Equal values get equal pseudonyms under a
    key, in every row; a permutation can leave single values where they are. The key is the session's KEY_SETTING, if not
    said. Mail domains stay, and key the rounds of their names: a name of one character moves by a constant of its domain.
    Columns named pii_<kind> are replaced. Texts without a match are not touched. Empty in, empty out.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, OPEN_KEY)
    t = F.col(text)
    has = t.rlike("[0-9@]") & t.rlike(ANY)
    found = F.when(has, pseudonyms(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), key))
    marked = docs.withColumn("__tb_new", found)
    count = lambda k: F.coalesce(F.size(F.filter("__tb_new", lambda x: (x["kind"] == k) & x["valid"])), F.lit(0)).cast("long")
    pieces = F.zip_with(F.split(t, ANY), F.col("__tb_new"), lambda between, x: F.concat(between, F.coalesce(x["new"], F.lit(""))))
    counts = {f"pii_{k}": F.when(F.col("__tb_new").isNotNull(), count(k)).otherwise(F.lit(0).cast("long")) for k in KINDS}
    return marked.withColumns({text: F.when(F.col("__tb_new").isNotNull(), F.array_join(pieces, "")).otherwise(t)} | counts).drop("__tb_new")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *[f"pii_{k}" for k in KINDS], "text")
