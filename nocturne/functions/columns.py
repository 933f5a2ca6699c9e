"""Column expressions. All of them run inside whole-stage codegen.

Times are TIMESTAMP_NTZ, so no result depends on the session time zone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def serial_to_timestamp(column: str | Column) -> Column:
    """Serial days since 1899-12-30 with a decimal comma, to the millisecond."""
    days = F.replace(_c(column), F.lit(","), F.lit(".")).try_cast("decimal(24,15)")
    seconds = F.round((days * 86400).cast("decimal(24,9)"), 3).cast("decimal(18,6)")
    zero = F.lit(0)
    origin = F.lit("1899-12-30 00:00:00").cast("timestamp_ntz")
    return origin + F.make_dt_interval(zero, zero, zero, seconds)


def timestamp_to_serial(column: str | Column) -> Column:
    """The inverse: serial days as text with a decimal comma, exact decimals."""
    origin = F.lit("1899-12-30 00:00:00").cast("timestamp_ntz")
    # the scale of the quotient follows that of the dividend
    seconds = (_c(column) - origin).cast("interval second").cast("decimal(18,6)").cast("decimal(22,10)")
    days = (seconds / F.lit(86400).cast("decimal(5,0)")).cast("decimal(24,15)")
    return F.replace(days.cast("string"), F.lit("."), F.lit(","))


def text_to_timestamp(column: str | Column, pattern: str = "yyyy-MM-dd HH:mm:ss[.SSSSSS]") -> Column:
    """Text in the given pattern as a time without zone; null if it is none."""
    return F.to_timestamp_ntz(F.when(_c(column).rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"), _c(column)),
                              F.lit(pattern))


def timestamp_to_text(column: str | Column) -> Column:
    return F.date_format(_c(column), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def seconds_between(start: str | Column, end: str | Column) -> Column:
    span = (_c(end) - _c(start)).cast("interval second").cast("decimal(18,6)")
    return span.cast("double")


def hours_between(start: str | Column, end: str | Column) -> Column:
    return seconds_between(start, end) / 3600


def place_of(unit_label: str | Column) -> Column:
    """Everything from the first digit on, as a number; null if not one."""
    tail = F.regexp_extract(_c(unit_label), r"([0-9].*)$", 1)
    return F.nullif(tail, F.lit("")).try_cast("int")


def patch_of(loc: str | Column) -> Column:
    """Places 1-5 are patch 1, 6-10 patch 2."""
    return F.when(_c(loc) < 6, 1).when(_c(loc) > 5, 2)


def night_hour(column: str | Column, first: int = 15) -> Column:
    """Hours since ``first`` o'clock: an order key for a night that wraps."""
    return (F.hour(_c(column)) + (24 - first)) % 24


def in_night(column: str | Column, after: int = 15, before: int = 4) -> Column:
    """Whether the hour lies after ``after`` or before ``before``."""
    hour = F.hour(_c(column))
    return (hour > after) | (hour < before)


def label_rank(column: str | Column, labels: Sequence[str]) -> Column:
    """Sort key of an ordered category; labels not listed sort last (null)."""
    position = F.array_position(F.array(*[F.lit(v) for v in labels]), _c(column))
    return F.nullif(position, F.lit(0).cast("long"))


def recode(column: str | Column, labels: Mapping) -> Column:
    """Replace codes by labels; codes without a label become null."""
    branches = F
    for code, label in labels.items():
        branches = branches.when(_c(column) == F.lit(code), F.lit(label))
    return branches


def arcsine(column: str | Column) -> Column:
    """Variance-stabilising transform of a proportion; null outside [0, 1]."""
    c = _c(column)
    return F.asin(F.sqrt(F.when((c >= 0) & (c <= 1), c)))


def ratio(top: str | Column, bottom: str | Column) -> Column:
    """Division that gives null, not an error or infinity, for a zero divisor."""
    return F.try_divide(_c(top).cast("double"), _c(bottom).cast("double"))


def cohort_type(cohort: str | Column, pattern: str = "mixed") -> Column:
    return F.when(_c(cohort).contains(pattern), "mixed").otherwise("single-sex")


# Bracket pairs of the interval text
_BRACKETS = {"round": "()", "square": "[]", "squiggly": "{}", "none": ""}


def interval_text(
    estimate: str | Column,
    low: str | Column,
    high: str | Column,
    name: str = "_r_",
    brackets: str = "round",
) -> Column:
    """``name = estimate, 95% CI = (low, high)``.

    ``brackets`` is a known name or the two characters themselves.
    """
    return F.concat(
        F.lit(f"{name} = "), _c(estimate).cast("string"),
        F.lit(", 95% CI = "), bracketed(low, high, brackets),
    )


def bracketed(low: str | Column, high: str | Column, brackets: str = "round") -> Column:
    pair = _BRACKETS.get(brackets, brackets)
    return F.concat(
        F.lit(pair[:1]), _c(low).cast("string"), F.lit(", "),
        _c(high).cast("string"), F.lit(pair[1:2]),
    )


def significance(p: str | Column) -> Column:
    """Stars of a p-value. The usual cut points."""
    p = _c(p)
    return (
        F.when(p <= 0.0001, "****").when(p <= 0.001, "***").when(p <= 0.01, "**")
        .when(p <= 0.05, "*").when(p.isNotNull(), "ns")
    )


def p_label(p: str | Column) -> Column:
    """``<0.001`` or the value at three decimals."""
    p = _c(p)
    return F.when(p < 0.001, "<0.001").when(p.isNotNull(), F.format_string("%.3f", p))
