"""KPIs and grouped reports over enriched lines.

Every report also accepts a roll-up (:func:`rollup`): its sums keep the names
of the line measures and ``nb_lignes`` weighs the counts. Money is summed in
decimals and leaves as DOUBLE. Ties are broken by the key, ascending.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import ratio
from ..settings import Settings
from ..staging import materialise
from .measures import is_excluded

#: Parts that the salespeople of a dense cross-tab are dealt into.
GRID_PARTS = 32
ROLLUP_KEYS = ("annee", "mois", "mois_nom", "vendeur", "region", "categorie", "produit", "statut")


def _money(x: Column) -> Column:
    return F.bround(x, 2).cast("double")


def _lines(df: DataFrame) -> Column:
    return F.col("nb_lignes") if "nb_lignes" in df.columns else F.lit(1).cast("bigint")


def _booked(df: DataFrame, *keys: str) -> DataFrame:
    """Booked revenue per group as an exact decimal; groups without a key do not exist."""
    return (
        df.na.drop(subset=list(keys))
        .groupBy(*keys)
        .agg(F.sum("ca_comptabilise").alias("ca_total"))
    )


def _as_double(df: DataFrame) -> DataFrame:
    return df.withColumn("ca_total", _money(F.col("ca_total")))


def _ranked(df: DataFrame, key: str, n: int | None) -> DataFrame:
    ordered = _booked(df, key).orderBy(F.desc("ca_total"), key)
    return _as_double(ordered.limit(n) if n is not None else ordered)


def rollup(df: DataFrame) -> DataFrame:
    """Pre-aggregate at the grain of all report keys together."""
    return df.groupBy(*ROLLUP_KEYS).agg(
        F.count(F.lit(1)).alias("nb_lignes"),
        F.sum("ca_net").alias("ca_net"),
        F.sum("remise_euros").alias("remise_euros"),
        F.sum("ca_comptabilise").alias("ca_comptabilise"),
    )


def kpis(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The eight global figures as one row; zeros when there are no lines."""
    out = is_excluded(F.col("statut"), settings)
    n = _lines(df)
    sums = df.agg(
        F.coalesce(F.sum("ca_comptabilise"), F.lit(0)).alias("ca"),
        F.coalesce(F.sum(F.when(~out, n)), F.lit(0)).alias("active"),
        F.coalesce(F.sum(F.when(out, n)), F.lit(0)).alias("out"),
        F.coalesce(F.sum("remise_euros"), F.lit(0)).alias("discount"),
        F.count_distinct("vendeur").alias("nb_vendeurs"),
        F.count_distinct("produit").alias("nb_produits"),
    )
    return kpi_figures(sums)


def kpi_figures(sums: DataFrame) -> DataFrame:
    """Round and divide the raw sums ``ca, active, out, discount, nb_vendeurs, nb_produits``."""
    total = F.col("active") + F.col("out")
    return sums.select(
        _money(F.col("ca")).alias("ca_total"),
        F.col("active").alias("nb_commandes"),
        F.bround(ratio(F.col("ca"), F.col("active")), 2).alias("panier_moyen"),
        F.col("out").alias("nb_annulations"),
        F.bround(ratio(F.col("out"), total) * 100, 2).alias("taux_annulation"),
        _money(F.col("discount")).alias("remise_totale"),
        "nb_vendeurs",
        "nb_produits",
    )


def top_vendors(df: DataFrame, n: int | None = 10) -> DataFrame:
    """Salespeople by booked revenue; ``n=None`` gives the full list."""
    return _ranked(df, "vendeur", n)


def top_products(df: DataFrame, n: int | None = 10) -> DataFrame:
    return _ranked(df, "produit", n)


def by_category(df: DataFrame) -> DataFrame:
    return _ranked(df, "categorie", None)


def by_region(df: DataFrame) -> DataFrame:
    return _ranked(df, "region", None)


def month_totals(df: DataFrame) -> DataFrame:
    """Booked revenue per calendar month, in no order."""
    return _as_double(_booked(df, "annee", "mois", "mois_nom"))


def group_totals(df: DataFrame, key: str) -> DataFrame:
    """Booked revenue per value of one key, in no order."""
    return _as_double(_booked(df, key))


def by_month(df: DataFrame) -> DataFrame:
    """Booked revenue per calendar month, oldest first."""
    return month_totals(df).orderBy("annee", "mois")


def heatmap_cells(df: DataFrame) -> DataFrame:
    """Salesperson x region pairs that occur, as exact decimals.

    Stored, because the dense cross-tab reads it three times: the lines are scanned once
    and the rest works on this small table.
    """
    return materialise(_booked(df, "vendeur", "region"), "cells")


def heatmap_long(df: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Dense cross-tab in long form: one row per salesperson and region, empty cells 0.

    Its size is salespeople times regions, which is what a dense table is; each region goes
    to a range of salespeople, so no task holds the list of either.
    """
    cells = heatmap_cells(df) if cells is None else cells
    people = cells.select("vendeur").distinct().withColumn(
        "part", F.pmod(F.xxhash64("vendeur"), F.lit(GRID_PARTS))
    )
    regions = cells.select("region").distinct().withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GRID_PARTS - 1).cast("long")))
    )
    return _as_double(
        people.join(regions, "part").drop("part").join(cells, ["vendeur", "region"], "left")
        .withColumn("ca_total", F.coalesce(F.col("ca_total"), F.lit(0)))
    )


def heatmap_wide(df: DataFrame, regions: Sequence[str], cells: DataFrame | None = None) -> DataFrame:
    """Dense cross-tab as a matrix: one row per salesperson, a column for each of ``regions``.

    The caller names the columns, in their order; revenue elsewhere is not shown. Names
    that differ only in case can be told apart by place but not stored under their names:
    what is written is the long form, which holds any region.
    """
    cells = _booked(df, *CELLS) if cells is None else cells
    sums = [
        F.sum(F.when(F.col("region") == name, F.col("ca_total"))) for name in regions
    ]
    if not sums:
        return cells.select("vendeur").distinct().orderBy("vendeur")
    return cells.groupBy("vendeur").agg(
        *[_money(F.coalesce(x, F.lit(0))).alias(n) for x, n in zip(sums, regions, strict=True)]
    ).orderBy("vendeur")


# The three groupings that every other one can be summed from.
MONTHS = ("annee", "mois", "mois_nom")
CELLS = ("vendeur", "region")
ITEMS = ("categorie", "produit")


def report_groups(
    df: DataFrame, settings: Settings = Settings(), within: tuple[str, ...] = ()
) -> DataFrame:
    """Everything the reports need, in one pass over the lines.

    Read one by one, the reports scan the lines seven times. GROUPING SETS over
    three grains expands each line inside codegen and aggregates partially
    before the only shuffle, whose size is the number of groups, not of lines.
    All coarser groupings and the totals are sums of these small groups.
    With ``within``, the groups of each value of these columns, which add up to all.
    """
    out = is_excluded(F.col("statut"), settings)
    n = _lines(df)
    keys = [*MONTHS, *CELLS, *ITEMS]
    slim = df.select(
        *within, *keys, "ca_comptabilise", "remise_euros",
        F.when(~out, n).otherwise(0).alias("active"),
        F.when(out, n).otherwise(0).alias("out"),
    )
    sets = [[*within, *own] for own in (MONTHS, CELLS, ITEMS)]
    return slim.groupingSets(sets, *within, *keys).agg(
        F.concat_ws("+", *[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys]).alias("grain"),
        F.sum("ca_comptabilise").alias("ca_comptabilise"),
        F.sum("remise_euros").alias("remise_euros"),
        F.sum("active").alias("active"),
        F.sum("out").alias("out"),
    )


def grain(groups: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return groups.filter(F.col("grain") == "+".join(keys))


def reports_from_groups(
    groups: DataFrame, settings: Settings = Settings()
) -> dict[str, DataFrame]:
    """The seven result tables out of a stored :func:`report_groups`."""
    months, cells, items = (grain(groups, keys) for keys in (MONTHS, CELLS, ITEMS))

    def total(column: str) -> Column:
        of_months = F.when(F.col("grain") == "+".join(MONTHS), F.col(column))
        return F.coalesce(F.sum(of_months), F.lit(0))

    figures = groups.agg(
        total("ca_comptabilise").alias("ca"),
        total("active").alias("active"),
        total("out").alias("out"),
        total("remise_euros").alias("discount"),
        F.count_distinct(F.when(F.col("grain") == "+".join(CELLS), F.col("vendeur"))).alias("nb_vendeurs"),
        F.count_distinct(F.when(F.col("grain") == "+".join(ITEMS), F.col("produit"))).alias("nb_produits"),
    )
    return {
        "kpis": kpi_figures(figures),
        "par_vendeur": top_vendors(cells, settings.top_vendors),
        "par_mois": by_month(months),
        "par_categorie": by_category(items),
        "par_region": by_region(cells),
        "heatmap": _as_double(_booked(cells, *CELLS)),
        "top_produits": top_products(items, settings.top_products),
    }
