"""Line-level revenue measures, in exact decimals wherever the numbers allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..settings import Settings

MONEY = "decimal(28,2)"
GROSS = "decimal(36,6)"
#: Amounts of this size and more fit no decimal column; they count as zero and are reported.
LARGEST_AMOUNT = 1e26


def is_excluded(status: Column, settings: Settings) -> Column:
    """True for a line that does not count as revenue."""
    if settings.status_policy == "include_only":
        return ~F.coalesce(status.isin(*settings.included_statuses), F.lit(False))
    return F.coalesce(status.isin(*settings.excluded_statuses), F.lit(False))


def enrich(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add gross, net, discount and booked revenue to cleaned lines.

    Net revenue is rounded per line, half to even, before anything is summed.
    Decimal sums do not depend on the order of rows, so totals are the same
    for every partitioning. Ten-digit quantities and prices with up to six decimals
    multiply exactly, everything beyond with the precision of doubles.
    """
    exact = {
        name: _exactly(df, name, kind) for name, kind in (
            ("quantite", "decimal(10,0)"), ("prix_unitaire", "decimal(16,6)"),
            ("remise", "decimal(9,8)"),
        )
    }
    one = F.lit(1).cast("decimal(1,0)")
    gross = exact["quantite"] * exact["prix_unitaire"]
    net = F.bround(gross * (one - exact["remise"]), 2).cast(MONEY)
    # Larger numbers and more digits than a decimal product can hold: double precision.
    wide = F.col("quantite").cast("double") * F.col("prix_unitaire").cast("double")
    wide = F.when(F.abs(wide) < LARGEST_AMOUNT, wide).otherwise(0.0)
    wide_net = F.bround(wide * (1 - F.col("remise").cast("double")), 2)
    gross = F.coalesce(gross.cast(GROSS), wide.cast(GROSS))
    net = F.coalesce(net, wide_net.cast(MONEY))
    return (
        df.withColumn("ca_brut", gross)
        .withColumn("ca_net", net)
        .withColumns(
            {
                "remise_euros": F.bround(F.col("ca_brut") - F.col("ca_net"), 2).cast(MONEY),
                "ca_comptabilise": F.when(
                    is_excluded(F.col("statut"), settings), F.lit(0).cast(MONEY)
                ).otherwise(F.col("ca_net")),
            }
        )
    )


def _exactly(df: DataFrame, name: str, kind: str) -> Column:
    """The column as ``kind``, NULL where that would change its value."""
    column = F.col(name)
    value = column.try_cast(kind)
    if dict(df.dtypes)[name] == "double":
        return F.when(value.cast("double") == column, value)
    return F.when(value == column, value)
