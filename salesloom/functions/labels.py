"""Text labels of report values. All built-in expressions, half-even throughout."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..settings import MONTH_NAMES, MONTH_NAMES_PLAIN
from .numbers import month_name


def euro_label(x: Column) -> Column:
    """Compact axis label: ``1.2M€``, ``12k€`` or ``12€``."""
    x = x.cast("double")
    return (
        F.when(x >= 1_000_000, F.format_string("%.1fM€", F.bround(x / 1_000_000, 1)))
        .when(x >= 1_000, F.format_string("%.0fk€", F.bround(x / 1_000, 0)))
        .otherwise(F.format_string("%.0f€", F.bround(x, 0)))
    )


def money_label(x: Column) -> Column:
    """``1,234,567.12``"""
    return F.format_number(x, 2)


def pct_label(x: Column) -> Column:
    """``12.3%``"""
    return F.format_string("%.1f%%", F.bround(x.cast("double"), 1))


def change_label(x: Column) -> Column:
    """Signed percentage, ``-`` when there is nothing to compare with."""
    sign = F.when(x >= 0, F.lit("+")).otherwise(F.lit(""))
    # A tiny fall still prints as a fall: -0.02 -> "-0.0%".
    lost_sign = F.when((x < 0) & (F.bround(x, 1) == 0), F.lit("-0.0%"))
    return F.coalesce(
        F.when(x.isNull(), F.lit("-")),
        lost_sign,
        F.concat(sign, pct_label(x)),
    )


def current_period_label(run_date: Column) -> Column:
    """Default label of a run: its own month, ``Mai 2024``."""
    return F.concat_ws(" ", month_name(F.month(run_date), MONTH_NAMES), F.year(run_date).cast("string"))


def previous_period_label(run_date: Column) -> Column:
    """Label of a scheduled monthly run: the month before, unaccented."""
    before = F.add_months(run_date, -1)
    return F.concat_ws(" ", month_name(F.month(before), MONTH_NAMES_PLAIN), F.year(before).cast("string"))
