"""Column helpers. All of them stay inside Spark's built-in, code-generated expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- money -------------------------------------------------------------------------------
# Money is summed as whole cents in 64-bit integers: exact, independent of the order in which
# partitions are merged, and an overflow raises under ANSI mode instead of wrapping.

def cents(c: Column | str) -> Column:
    return F.floor(as_col(c) * 100 + F.lit(0.5))


def from_cents(c: Column | str) -> Column:
    return as_col(c) / F.lit(100.0)


def money_sum(c: Column | str) -> Column:
    return from_cents(F.sum(cents(c)))


def money_avg(c: Column | str) -> Column:
    return F.try_divide(money_sum(c), F.count(as_col(c)))


# --- numbers -----------------------------------------------------------------------------

def rnd(c: Column | str, digits: int = 2) -> Column:
    """Round half away from zero on the decimal value, so float noise cannot flip a tie."""
    return F.round(as_col(c).cast("decimal(28,8)"), digits).cast("double")


def to_long(c: Column | str) -> Column:
    """Float to integer, half away from zero (a plain cast would truncate)."""
    return F.round(as_col(c).cast("decimal(28,8)"), 0).cast("bigint")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double, NULL for a zero or NULL denominator."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def pct(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(as_col(a) * F.lit(100.0), as_col(b).cast("double"))


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def rate_where(cond: Column, digits: int = 2) -> Column:
    """Percentage of the group's rows for which ``cond`` holds."""
    return rnd(pct(F.count_if(cond), F.count(F.lit(1))), digits)


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation that is NULL for zero variance (``corr`` raises there under ANSI)."""
    x, y = as_col(x).cast("double"), as_col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


# --- dates -------------------------------------------------------------------------------

def day_diff(end: Column | str, start: Column | str) -> Column:
    """Calendar days between two dates or timestamps."""
    return F.datediff(F.to_date(as_col(end)), F.to_date(as_col(start))).cast("bigint")


def month_diff(end: Column | str, start: Column | str) -> Column:
    """Number of month boundaries crossed (31 Jan to 1 Mar is 2)."""
    e, s = as_col(end), as_col(start)
    return ((F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)).cast("bigint")


def month_start(c: Column | str) -> Column:
    return F.trunc(F.to_date(as_col(c)), "month")


def week_start(c: Column | str) -> Column:
    """The Sunday that begins the week."""
    return F.date_sub(F.trunc(F.date_add(F.to_date(as_col(c)), 1), "week"), 1)


def as_timestamp(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def season(month: Column) -> Column:
    """Southern-hemisphere season of a month number."""
    return (
        F.when(month.isin(12, 1, 2), "Summer")
        .when(month.isin(3, 4, 5), "Fall")
        .when(month.isin(6, 7, 8), "Winter")
        .otherwise("Spring")
    )


# --- text and lookups --------------------------------------------------------------------

_WORD_BREAK = r"([-\[\](){}/|\\<>!?@\"^#$&~_,.:;*%+])"


def initcap_words(c: Column | str) -> Column:
    """Capitalise after punctuation too: Spark's own ``initcap`` only breaks on blanks."""
    marked = F.regexp_replace(as_col(c), _WORD_BREAK, "$1\u0001 ")
    return F.regexp_replace(F.initcap(marked), "\u0001 ", "")


def norm_lower(c: Column | str) -> Column:
    return F.lower(F.trim(as_col(c)))


def norm_upper(c: Column | str) -> Column:
    return F.upper(F.trim(as_col(c)))


def lookup(c: Column | str, table: Mapping[str, object], default: object = None) -> Column:
    """Map literal lookup for small fixed tables."""
    entries = [F.lit(v) for pair in table.items() for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), as_col(c)), F.lit(default))


def bins(
    c: Column | str, steps: Sequence[tuple[float, str]], default: str, closed: bool = True
) -> Column:
    """First step whose upper bound holds ``c`` (``<=`` when closed, else ``<``)."""
    c = as_col(c)
    out = None
    for bound, label in steps:
        hit = c <= bound if closed else c < bound
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def at_least(c: Column | str, steps: Sequence[tuple[float, str]], default: str) -> Column:
    """First step, from the highest down, whose lower bound ``c`` reaches."""
    c = as_col(c)
    out = None
    for bound, label in steps:
        out = F.when(c >= bound, label) if out is None else out.when(c >= bound, label)
    return out.otherwise(default)


def ranges(c: Column | str, steps: Sequence[tuple[float, float, str]], default: str) -> Column:
    """First closed range that contains ``c``; values in a gap get the default."""
    c = as_col(c)
    out = None
    for low, high, label in steps:
        hit = c.between(low, high)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def label_order(c: Column | str, labels: Sequence[str]) -> Column:
    """Sort key that puts labelled bins into their natural order."""
    return F.array_position(F.array(*[F.lit(x) for x in labels]), as_col(c))
