"""Format-preserving Feistel pseudonyms for validated numbers, dates and addresses in texts.

A text is cut at the values found; each is validated and permuted by a keyed Feistel network
within its own format, so that equal values get equal pseudonyms in every document:

- card numbers of 13 to 19 digits with a right check digit keep length, first digit and validity;
- telephone numbers keep their punctuation and country code (by the table of codes), their national
  digits are permuted; those of the form NXX NXX XXXX among each other, with and without +1, so that
  both spellings of a number stay linked;
- social security numbers are permuted among valid ones (walking the cycle);
- dates of 1900-01-01 plus 72,900 days are permuted among these days and keep their pattern
  (dd/MM/yyyy, or MM/dd/yyyy where the day is over 12);
- IPv4 addresses are permuted among all addresses;
- e-mail addresses have no numeric format: a keyed digest replaces the local part and the host.

Numbers that fail validation stay. A walk among social security numbers ends after 64 steps; one
step in eight meets an invalid number, so that one value in 10**57 would need more.

The key is a secret: it is the session's spark.gazelark.pseudonym.secret (a name that Spark hides
in its logs), or else a random one for each Spark application, so that equal values are linked
within it and nowhere else. It enters the plan as a subquery over a table of one row, of which
plans and event logs show no value.

Edge cases: a null text stays null and counts no value; an
empty or very long text is treated whole; repeated rows give repeated results; an empty table
gives an empty result; other columns are ignored by the query and kept by `pseudonymise`.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazelark.llm.tables import read

ROUNDS = 8
KEY_CONF = "spark.gazelark.pseudonym.secret"
DAYS, HALF = 72_900, 270
FIRST_DAY = "1900-01-01"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    # a host has at most 127 labels; the matcher goes a level deeper with each
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,127}[A-Za-z]{2,}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<!\d)\([2-9]\d{2}\) ?[2-9]\d{2}[-. ]\d{4}(?!\d)|(?<![\d-])[2-9]\d{2}([-. ])[2-9]\d{2}\1\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|\d{4}([ -])\d{6}\3\d{5})(?!\d)",
}
ALL = "|".join(PATTERNS.values())
#: The international country codes of one and two digits; all others have three.
SHORT_CODES = ["1", "7"]
MIDDLE_CODES = [
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
]
_DATE_FORMATS = {r"^\d{4}-": "yyyy-MM-dd", r"^\d{4}/": "yyyy/MM/dd", r"^\d{2}/(?:1[3-9]|[23]\d)/": "MM/dd/yyyy", r"^\d{2}/": "dd/MM/yyyy", r"^\d{2}\.": "dd.MM.yyyy"}


def _round(key: Column, tweak: Column, i: Column, other: Column, modulus: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", key, tweak, i.cast("string"), other.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long") % modulus


def feistel(a: Column, b: Column, of_a: Column, of_b: Column, key: Column, tweak: Column) -> Column:
    """struct(a, b) permuted within [0, of_a) x [0, of_b): the halves take turns."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(x: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (x["a"] + _round(key, tweak, i, x["b"], of_a)) % of_a).otherwise(x["a"]).alias("a"),
            F.when(even, x["b"]).otherwise((x["b"] + _round(key, tweak, i, x["a"], of_b)) % of_b).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted_digits(digits: Column, key: Column, kind: Column) -> Column:
    """A digit string of 2 to 20 digits, permuted among those of its length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    power = F.array(*[F.lit(10**k).cast("long") for k in range(12)])
    # one-element transforms hold a value that is used twice
    out = F.transform(
        F.array(feistel(F.substring(digits, F.lit(1), u).cast("long"), F.substring(digits, u + 1, n).cast("long"), F.get(power, u), F.get(power, n - u), key, F.concat_ws("|", kind, n.cast("string")))),
        lambda x: F.concat(F.lpad(x["a"].cast("string"), u, "0"), F.lpad(x["b"].cast("string"), n - u, "0")),
    )
    return F.get(out, 0)


def check_sum(digits: Column) -> Column:
    """The Luhn sum modulo 10; the last digit counts once."""
    n = F.length(digits)

    def weight(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((n - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + weight(i)) % 10


def refilled(value: Column, digits: Column) -> Column:
    """value with its digits replaced, in order, by those given."""
    one = F.aggregate(
        F.sequence(F.lit(1), F.length(value)),
        F.struct(F.lit("").alias("text"), F.lit(1).alias("k")),
        lambda x, i: F.struct(
            F.concat(x["text"], F.when(F.substring(value, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, x["k"], F.lit(1))).otherwise(F.substring(value, i, F.lit(1)))).alias("text"),
            (x["k"] + F.when(F.substring(value, i, F.lit(1)).rlike("[0-9]"), 1).otherwise(0)).alias("k"),
        ),
    )
    return one["text"]


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _card(value: Column, key: Column) -> Column:
    def body(digits: Column) -> Column:
        inner = F.substring(digits, F.lit(2), F.length(digits) - 2)
        new = F.concat(F.substring(digits, 1, 1), permuted_digits(inner, key, F.concat(F.lit("card"), F.substring(digits, 1, 1))))
        whole = _let(new, lambda p: F.concat(p, ((10 - check_sum(F.concat(p, F.lit("0")))) % 10).cast("string")))
        return F.when(check_sum(digits) == 0, refilled(value, whole))

    return _let(F.regexp_replace(value, "[^0-9]", ""), body)


def country_code_length(digits: Column) -> Column:
    """How many of an international number's first digits are its country code; no code begins another."""
    return F.when(F.substring(digits, 1, 1).isin(SHORT_CODES), 1).when(F.substring(digits, 1, 2).isin(MIDDLE_CODES), 2).otherwise(3)


def _phone(value: Column, key: Column) -> Column:
    def american(digits: Column) -> Column:
        """Ten digits NXX NXX XXXX, as two numbers that any permutation leaves of this form."""
        n = lambda at, size: F.substring(digits, at, size).cast("long")
        halves = feistel(n(1, 3) - 200, n(4, 7) - 2_000_000, F.lit(800).cast("long"), F.lit(8_000_000).cast("long"), key, F.lit("phone"))
        return _let(halves, lambda h: F.concat((h["a"] + 200).cast("string"), (h["b"] + 2_000_000).cast("string")))

    def body(digits: Column) -> Column:
        kept = F.when(value.startswith("+"), country_code_length(digits)).otherwise(0)
        code, tail = F.substring(digits, F.lit(1), kept), F.substring(digits, kept + 1, F.length(digits))
        new = F.when((code.isin("", "1")) & tail.rlike(r"^[2-9]\d{2}[2-9]\d{6}$"), american(tail)).otherwise(permuted_digits(tail, key, F.concat(F.lit("phone"), code)))
        return F.when(F.length(digits).between(9, 15), refilled(value, F.concat(code, new)))

    return _let(F.regexp_replace(value, "[^0-9]", ""), body)


def _ssn(value: Column, key: Column) -> Column:
    def step(digits: Column) -> Column:
        return permuted_digits(digits, key, F.lit("ssn"))

    valid = r"^(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}$"
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), step(F.regexp_replace(value, "-", "")), lambda d, _: F.when(d.rlike(valid), d).otherwise(step(d)))
    return refilled(value, walked)


def _date(value: Column, key: Column) -> Column:
    first = F.lit(FIRST_DAY).cast("date")
    half = F.lit(HALF).cast("long")

    def moved(pattern: str):
        def body(n: Column) -> Column:
            halves = feistel(F.floor(n / HALF), n % HALF, half, half, key, F.lit("date"))
            day = _let(halves, lambda h: F.date_format(F.date_add(first, (h["a"] * HALF + h["b"]).cast("int")), pattern))
            return F.when(n.between(0, DAYS - 1), day)

        return _let(F.datediff(F.try_to_timestamp(value, F.lit(pattern)).cast("date"), first), body)

    out = None
    for opening, pattern in _DATE_FORMATS.items():
        out = F.when(value.rlike(opening), moved(pattern)) if out is None else out.when(value.rlike(opening), moved(pattern))
    return out


def _ip(value: Column, key: Column) -> Column:
    o = F.split(value, r"\.")
    part = [F.get(o, k).cast("long") for k in range(4)]
    size = F.lit(65_536).cast("long")
    halves = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], size, size, key, F.lit("ip"))
    return _let(halves, lambda h: F.concat_ws(".", *[x.cast("string") for half in (h["a"], h["b"]) for x in (F.floor(half / 256), half % 256)]))


def _email(value: Column, key: Column) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(key, F.lit("|email|"), F.lower(value)), 256), 1, 16), F.lit("@example.com"))


_PERMUTE = {"email": _email, "ip": _ip, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}


def replaced(value: Column, key: Column) -> Column:
    """struct(kind, text): the pseudonym, or the value itself with a null kind where it isn't valid."""
    # what only one kind has is looked at before the patterns
    kind = F.when(F.contains(value, F.lit("@")), F.lit("email")).when(value.startswith("+"), F.lit("phone"))
    for name, pattern in PATTERNS.items():
        if name != "email":
            kind = kind.when(value.rlike("^(?:" + pattern.replace(r"\2", r"\1").replace(r"\3", r"\2") + ")$"), F.lit(name))

    def body(k: Column) -> Column:
        new = F.lit(None).cast("string")
        for name, permute in reversed(_PERMUTE.items()):
            new = F.when(k == name, permute(value, key)).otherwise(new)
        return _let(new, lambda text: F.struct(F.when(text.isNotNull(), k).alias("kind"), F.coalesce(text, value).alias("text")))

    return _let(kind, body)


def session_key(spark: SparkSession) -> str:
    """The session's secret, or a random one of this application."""
    given = spark.conf.get(KEY_CONF, None)
    return given or _random.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


_random: dict[str, str] = {}


def pseudonymise(docs: DataFrame, key: str, text: str = "text", out: str = "pseudonymised") -> DataFrame:
    """docs with a column `out`: struct(text, kinds array<string>), one kind for each value replaced.

    Names that start with _gz_ are the operator's own; docs' other columns may have any.
    """
    if not key:
        raise ValueError("a key is needed")
    column = F.col(text)
    hidden = docs.sparkSession.createDataFrame([(key,)], "key string").scalar()
    secret = F.col("_gz_key")
    pieces = F.split(column, ALL, -1)
    values = F.transform(F.regexp_extract_all(column, F.lit(ALL), F.lit(0)), lambda v: replaced(v, secret))
    whole = F.struct(
        F.array_join(F.zip_with(F.col("_gz_pieces"), F.col("_gz_values"), lambda p, v: F.concat(p, F.coalesce(v["text"], F.lit("")))), "").alias("text"),
        F.filter(F.transform("_gz_values", lambda v: v["kind"]), lambda k: k.isNotNull()).alias("kinds"),
    )
    # a text without digits or @ holds no value
    some = column.rlike("[0-9@]") & column.rlike(ALL)
    cut = docs.withColumns({"_gz_some": some, "_gz_key": hidden})
    cut = cut.withColumns({"_gz_pieces": F.when(F.col("_gz_some"), pieces), "_gz_values": F.when(F.col("_gz_some"), values)})
    plain = F.struct(column.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return cut.withColumn(out, F.when(F.col("_gz_some"), whole).otherwise(plain)).drop("_gz_some", "_gz_key", "_gz_pieces", "_gz_values")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, the number of values replaced and their kinds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymise(docs, session_key(spark))
    return out.select(
        "doc_id",
        F.col("pseudonymised.text").alias("text"),
        F.size("pseudonymised.kinds").cast("long").alias("n_values"),
        F.array_join(F.array_sort(F.array_distinct("pseudonymised.kinds")), ",").alias("kinds"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with pseudonymised texts; n_chars follows a text that changes."""
    out = pseudonymise(docs, session_key(spark), out="_gz_out")
    changed = F.size("_gz_out.kinds") > 0
    replaced_columns = {"text": F.col("_gz_out.text"), "n_chars": F.when(changed, F.length("_gz_out.text").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[replaced_columns.get(c, F.col(c)).alias(c) for c in docs.columns])
