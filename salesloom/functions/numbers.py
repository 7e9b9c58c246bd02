"""Column expressions for text, numbers and dates in dirty input."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..settings import MONTH_NAMES, NA_TOKENS, WHITESPACE


def na_to_null(col: Column, tokens: tuple[str, ...] = NA_TOKENS) -> Column:
    """NULL where the text is one of the missing-value tokens."""
    return F.when(~col.isin(*tokens), col)


def strip_text(col: Column) -> Column:
    """Remove Unicode whitespace at both ends (``trim`` alone only knows U+0020).

    Few values have any, and looking at the two end characters is cheaper than
    a trim with a character set or a pattern, so only those values pay for it.
    """
    at_an_end = F.substring(col, 1, 1).isin(*WHITESPACE) | F.substring(col, -1, 1).isin(*WHITESPACE)
    return F.when(at_an_end, F.btrim(col, F.lit(WHITESPACE))).otherwise(col)


# What a decimal number looks like; a cast alone would also take ``12d``, ``NaN`` and ``0x1p3``.
_DECIMAL = r"^[\s+-]*[0-9.]+([eE][+-]?[0-9]+)?\s*$"
_ISO_START = r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\s*($|[T ])"


def number_or_null(text: Column) -> Column:
    """Value of a decimal text in double precision, NULL when it is none or infinite."""
    value = F.when(text.rlike(_DECIMAL), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def date_or_null(text: Column, formats: tuple[str, ...]) -> Column:
    """First format that parses wins; NULL when none does."""
    return F.coalesce(*[_iso_date(text) if fmt == "yyyy-MM-dd" else F.try_to_date(text, fmt) for fmt in formats])


def _iso_date(text: Column) -> Column:
    """Dates and date-times as exports write them: padded or not, the time cut off.

    The date written out again covers nearly all values and is several times cheaper
    than a pattern, which the others have to pass. Behind the day only a time may follow.
    """
    day = text.try_cast("date")
    timed = F.when(text.rlike(_ISO_START), F.coalesce(
        F.when(~F.trim(text).contains(" ") & ~text.contains("T"), day),
        text.try_cast("timestamp_ntz").cast("date"),
    ))
    return F.when(day.cast("string") == text, day).otherwise(timed)


def month_name(month: Column, names: tuple[str, ...] = MONTH_NAMES) -> Column:
    """French month name of a month number, independent of any locale."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), month)


def ratio(numerator: Column, denominator: Column, otherwise: float | None = 0.0) -> Column:
    """Quotient in double; ``otherwise`` when the denominator is zero or missing."""
    quotient = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return quotient if otherwise is None else F.coalesce(quotient, F.lit(otherwise))
