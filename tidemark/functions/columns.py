"""Column builders: parsing, validity, physical ranges and guarded arithmetic.

Every function returns a Spark ``Column`` (or takes and returns one), so all of
it stays inside whole-stage code generation.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

# Fixed values of the observation contract.
HARD_FLAGS = ("invalid", "conflict")
SOFT_FLAGS = ("flatline", "suspect")
UNUSABLE_FLAGS = ("invalid", "conflict", "suspect", "flatline", "gap")
LAB_DELAY_MINUTES = 240
FRESHNESS_MINUTES = {"kip": 10, "pak": 30, "lims": 2880}
LOG_FLOOR = 0.3


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- time -------------------------------------------------------------------

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00", "Etc/GMT", "Zulu", "Universal")


def micros(ts: Column | str) -> Column:
    """Zone-free microseconds of a TIMESTAMP_NTZ.

    TIMESTAMPDIFF reads its operands in the session zone.  In a UTC session that is exact; elsewhere the day and
    the time of day are taken separately (both zone-free) and only the sub-second part comes from the difference.
    """
    ts = c(ts)
    diff = F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts)
    session = SparkSession.getActiveSession()
    if session is None or session.conf.get("spark.sql.session.timeZone") in UTC_NAMES:
        return diff
    day = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return (day * 86400 + clock) * F.lit(SECOND) + F.pmod(diff, F.lit(SECOND))


def from_micros(t: Column | str) -> Column:
    return F.timestamp_add("MICROSECOND", c(t), F.expr(EPOCH))


def ntz_literal(micros: int) -> Column:
    """The TIMESTAMP_NTZ at that clock, folded to a constant: a comparison with it reaches the files."""
    return F.expr(f"TIMESTAMP_NTZ'{datetime(1970, 1, 1) + timedelta(microseconds=micros)}'")


def drawn(n: Column, *keys: str) -> Column:
    """A number in 0..n-1 drawn independently for each combination of keys: 60 bits of an MD5 modulo n."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), n)


def bucket(t: Column | str, width: int) -> Column:
    """Floor of ``t / width`` in exact integer arithmetic (right for negative times too)."""
    t = c(t)
    return ((t - F.pmod(t, F.lit(width))) / F.lit(width)).cast("long")


def half_open(t: Column | str, start, end) -> Column:
    return (c(t) >= F.lit(start)) & (c(t) < F.lit(end))


def in_period(start: int, end: int) -> Column:
    """``timestamp`` inside [start, end) as a comparison of the stored column with literals, which scans can use."""
    return (F.col("timestamp") >= from_micros(F.lit(start))) & (F.col("timestamp") < from_micros(F.lit(end)))


# --- lenient parsing ----------------------------------------------------------


def parse_number(raw: Column | str) -> Column:
    """Trim, decimal comma to dot, cast; anything unreadable or non-finite is NULL."""
    return finite(F.translate(F.trim(c(raw)), ",", ".").try_cast("double"))


def is_zoned(raw: Column | str) -> Column:
    """Ends with Z or an offset; the pattern is tried only where a cheap look finds a sign or a Z after the date."""
    x = F.trim(c(raw))
    clock = F.substring(x, 11, 40)
    hint = F.contains(clock, F.lit("+")) | F.contains(clock, F.lit("-")) | F.contains(clock, F.lit("Z")) | F.contains(clock, F.lit("z"))
    return hint & x.rlike(r"(?i)(\d\s*z|:\d\d(\.\d+)?\s*[+-]\d\d:?\d\d)$")


def parse_time(raw: Column | str) -> Column:
    """Local time, or NULL for a zoned or unreadable text."""
    return F.when(~is_zoned(raw), F.trim(c(raw)).try_cast("timestamp_ntz"))


def finite(x: Column | str) -> Column:
    """NaN and infinities become NULL."""
    x = c(x)
    return F.when(F.abs(x) < F.lit(float("inf")), x)  # NaN sorts above infinity


def plant_of(text: Column | str, plants: dict[str, tuple[str, ...]], default: str) -> Column:
    """First plant whose keyword occurs in the header text."""
    low = F.lower(c(text))
    out = F.lit(default)
    for plant, words in reversed(list(plants.items())):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), F.lit(plant)).otherwise(out)
    return out


# --- flags --------------------------------------------------------------------


def has_flag(flags: Column | str, name: str) -> Column:
    return F.contains(c(flags), F.lit(name))


def is_valid(value="value", flags="flags", exclude_suspect: bool = False) -> Column:
    ok = finite(value).isNotNull() & ~has_flag(flags, "invalid") & ~has_flag(flags, "conflict")
    return ok & ~is_suspect(flags) if exclude_suspect else ok


def is_suspect(flags="flags") -> Column:
    return has_flag(flags, "flatline") | has_flag(flags, "suspect")


def valid_value(value="value", flags="flags", exclude_suspect: bool = False) -> Column:
    return F.when(is_valid(value, flags, exclude_suspect), c(value))


def pack_flags(**marks: Column) -> Column:
    """``pack_flags(invalid=cond, ...)`` -> sorted names of the true conditions, pipe joined."""
    return F.array_join(F.array_compact(F.array(*[F.when(marks[k], F.lit(k)) for k in sorted(marks)])), "|")


def merge_flags(*flags: Column | str) -> Column:
    """Sorted distinct union of pipe-joined flag sets."""
    parts = [F.split(F.coalesce(c(x), F.lit("")), r"\|") for x in flags]
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.flatten(F.array(*parts)), lambda x: x != ""))), "|")


def concat_flags(*flags: Column | str) -> Column:
    """Plain concatenation of non-empty flag strings (the form used by derived differences)."""
    return F.concat_ws("|", *[F.when(c(x) != "", c(x)) for x in flags])


def suspect_range(metric_id: Column | str, value: Column | str) -> Column:
    """Physically implausible by metric code (fixed plausibility limits)."""
    mid, v = c(metric_id), c(value)
    code = F.substring_index(mid, ".", -1)
    rule = (
        F.when(code.isin("I250", "I350"), ~v.between(0, 100))
        .when(code == "D15", ~v.between(500, 1200))
        .when(mid.startswith("lims.") & mid.endswith(".T"), v > 1000)
        .when(F.contains(code, F.lit("Sulfur")), v < 0)
        .otherwise(F.lit(False))
    )
    return F.coalesce(rule, F.lit(False))


# --- guarded arithmetic ---------------------------------------------------------


def floored_ln(x: Column | str, floor: float = LOG_FLOOR) -> Column:
    x = finite(x)
    return F.when(x.isNotNull(), F.ln(F.greatest(x, F.lit(floor))))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b where b is a positive denominator, else NULL."""
    return F.when(c(b) > 0, c(a) / c(b))


def guarded_divide(a: Column | str, b: Column | str, eps: float = 1e-9) -> Column:
    return F.when(F.abs(c(b)) >= eps, c(a) / c(b))


def inside(x: Column | str, low: float, high: float) -> Column:
    return F.when(c(x).between(low, high), c(x))


def cetane_index(density: Column | str, t50: Column | str) -> Column:
    """ASTM D976 calculated index; NULL outside the guarded input ranges."""
    d, t = c(density) / 1000, c(t50)
    lg = F.log10(t)
    y = 454.74 - 1641.416 * d + 774.74 * d * d - 0.554 * t + 97.803 * lg * lg
    return F.when(d.between(0.7, 1.0) & t.between(100, 450), y)


def median_of(values: Column) -> Column:
    """Exact median of a short array column (NULL entries ignored)."""
    s = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(s)
    lo = F.get(s, F.floor((n - 1) / 2).cast("int"))
    hi = F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lo + hi) / 2)


def csv_safe(text: Column | str) -> Column:
    """Prefix text a spreadsheet would run as a formula."""
    return F.when(c(text).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c(text))).otherwise(c(text))


def reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """Ordered texts whose condition holds (NULL counts as not holding)."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(text) if isinstance(text, str) else text) for cond, text in pairs]))
