import datetime as dt

import pytest
from pyspark.sql import functions as F

from salesloom.functions import labels
from salesloom.plans.run import period_label


def text(spark, fn, value, kind="double"):
    return spark.range(1).select(fn(F.lit(value).cast(kind)).alias("t")).first()[0]


@pytest.mark.parametrize(
    "value, expected",
    [(1_250_000, "1.2M€"), (1_000_000, "1.0M€"), (999_999, "1000k€"), (12_500, "12k€"), (1_000, "1k€"),
     (999.5, "1000€"), (12.5, "12€"), (0, "0€"), (-5, "-5€")],
)
def test_euro(spark, value, expected):
    assert text(spark, labels.euro_label, value) == expected


def test_money(spark):
    assert text(spark, labels.money_label, 1234567.125) == "1,234,567.12"
    assert text(spark, labels.money_label, 0) == "0.00"


@pytest.mark.parametrize("value, expected", [(50.0, "+50.0%"), (0.0, "+0.0%"), (-0.02, "-0.0%"), (-88.0, "-88.0%"), (None, "-")])
def test_change(spark, value, expected):
    assert text(spark, labels.change_label, value) == expected


def test_percent(spark):
    assert text(spark, labels.pct_label, 12.34) == "12.3%"


def test_periods(spark):
    assert text(spark, labels.current_period_label, dt.date(2024, 8, 31), "date") == "Août 2024"
    assert text(spark, labels.previous_period_label, dt.date(2024, 1, 1), "date") == "Decembre 2023"
    assert text(spark, labels.previous_period_label, dt.date(2024, 3, 31), "date") == "Fevrier 2024"


def test_period_of_a_run(spark):
    assert period_label(dt.date(2024, 2, 1)) == "Février 2024"
    assert period_label(dt.date(2024, 1, 1), scheduled=True) == "Decembre 2023"
