"""Analytic columns of the report tables. All work on aggregated rows.

The un-partitioned windows below see at most N ranked rows or one row per
calendar month; shares, whose number of groups has no such bound, divide by a
scalar subquery instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from ..functions.labels import change_label, money_label, pct_label
from ..functions.numbers import ratio
from ..settings import CARD_LABELS
from . import reports


def with_rank(top: DataFrame, key: str) -> DataFrame:
    """1-based position without ties. ``top`` must already be cut to N rows."""
    order = W.orderBy(F.desc("ca_total"), key)
    return top.withColumn("rang", F.row_number().over(order).cast("bigint"))


def with_best_flag(top: DataFrame, key: str) -> DataFrame:
    """Marks the row that a chart highlights."""
    return with_rank(top, key).withColumn("meilleur", F.col("rang") == 1).drop("rang")


def with_change(months: DataFrame) -> DataFrame:
    """Change in % against the previous month present; NULL if there is none or it is not positive."""
    before = F.lag("ca_total").over(W.orderBy("annee", "mois"))
    return (
        months.withColumn("_avant", before)
        .withColumn(
            "variation_pct",
            F.when(F.col("_avant") > 0, (F.col("ca_total") - F.col("_avant")) / F.col("_avant") * 100),
        )
        .drop("_avant")
    )


def with_running_total(months: DataFrame) -> DataFrame:
    """Total since the first month; it does not restart in January."""
    span = W.orderBy("annee", "mois").rowsBetween(W.unboundedPreceding, W.currentRow)
    exact = F.sum(F.col("ca_total").cast("decimal(27,2)")).over(span)
    return months.withColumn("cumul", exact.cast("double"))


def with_trend(months: DataFrame) -> DataFrame:
    """Direction of the change: ``hausse``, ``baisse`` or ``aucune``."""
    change = F.col("variation_pct")
    return months.withColumn(
        "tendance",
        F.when(change.isNull(), "aucune").when(change >= 0, "hausse").otherwise("baisse"),
    )


def with_share(groups: DataFrame) -> DataFrame:
    """Share of the sum of the (rounded) group totals in %, 0 if that sum is 0."""
    whole = groups.agg(F.sum(F.col("ca_total").cast("decimal(27,2)")).cast("double").alias("t"))
    return groups.withColumn("part_pct", ratio(F.col("ca_total"), whole.scalar()) * 100)


def vendor_table(df: DataFrame, n: int = 10) -> DataFrame:
    return with_rank(reports.top_vendors(df, n), "vendeur").select(
        "rang", "vendeur", "ca_total", money_label(F.col("ca_total")).alias("ca_texte")
    )


def product_table(df: DataFrame, n: int = 10) -> DataFrame:
    return with_rank(reports.top_products(df, n), "produit").select(
        "rang", "produit", "ca_total", money_label(F.col("ca_total")).alias("ca_texte")
    )


def monthly_table(df: DataFrame) -> DataFrame:
    return monthly_columns(reports.month_totals(df))


def monthly_columns(months: DataFrame) -> DataFrame:
    """Month, revenue, change, running total and trend, with their texts."""
    return (
        months.transform(with_change)
        .transform(with_running_total)
        .transform(with_trend)
        .select(
            "annee", "mois",
            F.initcap("mois_nom").alias("mois_nom"),
            "ca_total",
            F.bround("variation_pct", 2).alias("variation_pct"),
            change_label(F.col("variation_pct")).alias("variation_texte"),
            "cumul", "tendance",
        )
    )


def category_table(df: DataFrame) -> DataFrame:
    return share_columns(reports.group_totals(df, "categorie"), "categorie")


def region_table(df: DataFrame) -> DataFrame:
    return share_columns(reports.group_totals(df, "region"), "region")


def share_columns(groups: DataFrame, key: str) -> DataFrame:
    return with_share(groups).select(
        key, "ca_total",
        F.bround("part_pct", 2).alias("part_pct"),
        pct_label(F.col("part_pct")).alias("part_texte"),
    )


def kpi_cards(figures: DataFrame) -> DataFrame:
    """The eight figures as (order, level, label, text) rows."""
    def euros(name):
        return F.concat(money_label(F.col(name)), F.lit(" EUR"))

    def plain(name):
        return F.col(name).cast("string")

    texts = [
        euros("ca_total"), plain("nb_commandes"), euros("panier_moyen"),
        F.concat(plain("taux_annulation"), F.lit(" %")), plain("nb_vendeurs"),
        plain("nb_produits"), euros("remise_totale"), plain("nb_annulations"),
    ]
    levels = ["principal"] * 4 + ["secondaire"] * 4
    cards = list(zip(levels, CARD_LABELS, texts, strict=True))
    return figures.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).cast("bigint").alias("ordre"), F.lit(level).alias("niveau"),
                        F.lit(label).alias("libelle"), text.alias("valeur"),
                    )
                    for i, (level, label, text) in enumerate(cards, start=1)
                ]
            )
        )
    )
