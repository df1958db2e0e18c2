"""Format-preserving pseudonyms for validated numbers and dates, by a keyed Feistel network.

A value is read as a number inside the domain of its format, split into two halves (left in 0..a-1, right in 0..b-1, a*b the
domain's size) and run through ROUNDS rounds; each adds a keyed hash of one half to the other, modulo its size. That is a
permutation of the domain: a pseudonym is again a valid value of the same format, and equal values get equal pseudonyms in
every document. Kinds are keyed apart. Built-in functions only; no shuffle.

card: 13-19 digits with a right Luhn digit: the first digit and the length stay, the check digit is worked out anew.
phone: +1 (aaa) eee-nnnn; those with aaa and eee in 200..999 are permuted among themselves, and so are all others.  ip: dotted quad, parts 0..255 without leading zeros.
ssn: aaa-gg-nnnn, aaa 001..899 but 666, gg 01..99, nnnn 0001..9999.
date: yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, mm/dd/yyyy that exist, 1900 to 2099.
email: the letters and digits before the @, in runs of at most 11, lower-cased. A domain has at most 127 labels, the most that names allow.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

ROUNDS = 8
# fixed formats
FORMS = {
    # a name starts where its characters start or where the last match ended; possessive runs and bounded labels keep the search linear
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}",
    "phone": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|(?:19|20)[0-9]{2}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9A-Za-z/-]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z.-])[0-9]{13,19}(?![0-9A-Za-z])",
}
ANY = "|".join(FORMS.values())
KINDS = {"email": r"@", "phone": r"^\+", "ssn": r"^[0-9]{3}-[0-9]{2}-", "card": r"^[0-9]+$", "ip": r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\."}  # anything else: date
DAYS = 73_049  # 1900-01-01 .. 2099-12-31, 229 * 319


def keyed(key: str, kind: str, tweak: Column, round_: Column, half: Column) -> Column:
    """60 keyed bits."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), tweak.cast("string"), round_.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(x: Column, a: Column | int, b: Column | int, key: str, kind: str, tweak: Column | None = None) -> Column:
    """x in 0..a*b-1 to its image under the keyed permutation."""
    a, b = (F.lit(v).cast("long") if isinstance(v, int) else v.cast("long") for v in (a, b))
    tweak = F.lit(0) if tweak is None else tweak
    right = F.pmod(x, b)
    start = F.struct(F.call_function("div", x, b).alias("l"), right.alias("r"))

    def step(s: Column, i: Column) -> Column:
        l, r = s["l"], s["r"]  # noqa: E741
        return F.struct(F.when(i % 2 == 0, (l + keyed(key, kind, tweak, i, r)) % a).otherwise(l).alias("l"),
                        F.when(i % 2 == 1, (r + keyed(key, kind, tweak, i, l)) % b).otherwise(r).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _int(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(0).cast("long"))


def _zeros(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width, F.lit("0"))


def _power(base: int, n: Column) -> Column:
    """base ** n as an exact long; n is 0..18 at most."""
    return F.element_at(F.array(*[F.lit(base**k).cast("long") for k in range(19) if base**k < 2**63]), n.cast("int") + 1)


def luhn_digit(body: Column) -> Column:
    """The check digit to be appended to a string of digits."""
    back = F.split(F.reverse(body), "")
    total = F.aggregate(F.sequence(F.lit(0), F.length(body) - 1), F.lit(0), lambda s, i: s + _doubled(F.get(back, i).cast("int"), i))
    return (F.lit(10) - total % 10) % 10


def _doubled(d: Column, i: Column) -> Column:
    return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)


def card(v: Column, key: str) -> Column:
    n = F.length(v)
    body, inner = F.left(v, n - 1), F.substring(v, F.lit(2), n - 2)
    half = F.call_function("div", n - 2, F.lit(2)).cast("int")
    image = _zeros(feistel(_int(inner), _power(10, n - 2 - half), _power(10, half), key, "card", n), n - 2)
    new = F.concat(F.left(v, F.lit(1)), image)
    return F.when(luhn_digit(body) == F.right(v, F.lit(1)).cast("int"), F.concat(new, luhn_digit(new).cast("string")))


def phone(v: Column, key: str) -> Column:
    d = F.regexp_replace(v, r"[^0-9]", "")
    area, mid, line = (_int(F.substring(d, i, n)) for i, n in ((2, 3), (5, 3), (8, 4)))
    # area code and exchange as one number: 800 * 800 usual ones, and the others, 200 * 1000 with a low area code before 800 * 200
    usual, low = (area >= 200) & (mid >= 200), area < 200
    other = F.when(low, area * 1000 + mid).otherwise(200_000 + (area - 200) * 200 + mid)
    top = F.when(usual, (area - 200) * 800 + mid - 200).otherwise(other)
    half = F.when(usual, 80_000).otherwise(60_000)
    x = feistel(top * 10_000 + line, half, half, key, "phone", F.when(usual, 0).otherwise(1))
    top, div = F.call_function("div", x, F.lit(10_000).cast("long")), lambda n, d: F.call_function("div", n, F.lit(d).cast("long"))
    area = F.when(usual, div(top, 800) + 200).when(top < 200_000, div(top, 1000)).otherwise(div(top - 200_000, 200) + 200)
    mid = F.when(usual, top % 800 + 200).when(top < 200_000, top % 1000).otherwise((top - 200_000) % 200)
    return F.concat(F.lit("+1 ("), _zeros(area, 3), F.lit(") "), _zeros(mid, 3), F.lit("-"), _zeros(x % 10_000, 4))


def ssn(v: Column, key: str) -> Column:
    area, group, serial = (_int(F.substring(v, i, n)) for i, n in ((1, 3), (5, 2), (8, 4)))
    place = area - F.when(area > 666, 2).otherwise(1)
    x = feistel((place * 99 + group - 1) * 9_999 + serial - 1, 898 * 99, 9_999, key, "ssn")
    top = F.call_function("div", x, F.lit(9_999).cast("long"))
    new = F.call_function("div", top, F.lit(99).cast("long")) + 1
    fine = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    return F.when(fine, F.concat(_zeros(new + F.when(new >= 666, 1).otherwise(0), 3), F.lit("-"), _zeros(top % 99 + 1, 2), F.lit("-"), _zeros(x % 9_999 + 1, 4)))


def ip(v: Column, key: str) -> Column:
    parts = F.split(v, r"\.")
    x = feistel(F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 256 + _int(p)), 65_536, 65_536, key, "ip")
    new = F.concat_ws(".", *[(F.shiftright(x, k) % 256).cast("string") for k in (24, 16, 8, 0)])
    return F.when(F.forall(parts, lambda p: (_int(p) <= 255) & ((p == "0") | ~p.startswith("0"))), new)


def date(v: Column, key: str) -> Column:
    iso, slash, dots = v.rlike(r"^[0-9]{4}-"), v.rlike(r"^[0-9]{4}/"), v.contains(".")
    text = F.when(iso, v).when(slash, F.replace(v, F.lit("/"), F.lit("-"))).when(
        dots, F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 4, 2), F.substring(v, 1, 2))).otherwise(F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 1, 2), F.substring(v, 4, 2)))
    day = F.call_function("try_to_date", text, F.lit("yyyy-MM-dd"))
    first = F.lit("1900-01-01").cast("date")
    new = F.date_add(first, feistel(F.datediff(day, first).cast("long"), 229, 319, key, "date").cast("int"))
    shown = F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(slash, F.date_format(new, "yyyy/MM/dd")).when(dots, F.date_format(new, "dd.MM.yyyy")).otherwise(F.date_format(new, "MM/dd/yyyy"))
    return F.when(day.isNotNull(), shown)


def email(v: Column, key: str) -> Column:
    name, host = F.lower(F.substring_index(v, "@", 1)), F.substring_index(v, "@", -1)

    def run(s: Column) -> Column:
        n = F.length(s)
        half = F.call_function("div", n, F.lit(2)).cast("int")
        x = feistel(_int(F.conv(s, 36, 10)), _power(36, n - half), _power(36, half), key, "email", n)
        return F.lpad(F.lower(F.conv(x.cast("string"), 10, 36)), n, F.lit("0"))

    return F.concat(_joined(name, "[a-z0-9]{1,11}", run), F.lit("@"), host)


def _joined(text: Column, pattern: str, image) -> Column:
    """text with each match of pattern replaced by its image."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(found)), F.transform(found, image), lambda g, m: F.concat(g, m)), ""), F.element_at(gaps, -1))


def pseudonym(v: Column, key: str) -> Column:
    """The pseudonym of one match; null if it isn't a valid value."""
    make = {"email": email, "phone": phone, "ssn": ssn, "card": card, "ip": ip}
    out = None
    for kind, pattern in KINDS.items():
        out = (F if out is None else out).when(v.rlike(pattern), make[kind](v, key))
    return out.otherwise(date(v, key))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with `text` rewritten, plus n_values (values replaced) and n_invalid (matches left because they are no valid value).

    Null texts stay null, empty ones empty, with 0 and 0. Repeated rows are rewritten alike; all other columns pass through,
    columns named n_values or n_invalid are replaced; empty tables give empty ones.
    """
    rest = docs.drop("n_values", "n_invalid")
    # every match of ANY holds two digits side by side or across a dot, or an @
    has = F.coalesce(F.col("text").rlike("[0-9][.]?[0-9]|@") & F.col("text").rlike(ANY), F.lit(False))
    found = F.when(has, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rest.withColumn("_found", found)
    rows = rows.withColumn("_new", F.transform("_found", lambda v: pseudonym(v, key)))
    gaps = F.split("text", ANY, -1)
    full = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size("_found")), F.zip_with("_found", "_new", lambda v, n: F.coalesce(n, v)), lambda g, m: F.concat(g, m)), ""), F.element_at(gaps, -1))
    text = F.when(F.size("_found") == 0, F.col("text")).otherwise(full)
    bad = F.size(F.filter("_new", lambda v: v.isNull()))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in rest.columns],
                       (F.size("_found") - bad).cast("long").alias("n_values"), bad.cast("long").alias("n_invalid"))


QUERY_KEY = "corpus-key-1"  # of the test tables only; callers bring their own


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
