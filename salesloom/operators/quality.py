"""Counts that describe the input and what cleaning did to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import date_or_null
from ..settings import NUMERIC_COLUMNS, SOURCE_COLUMN, TEXT_COLUMNS, UNKNOWN, Settings
from ..staging import materialise
from .cleaning import UNREADABLE_SUFFIX, fits_quantity
from .measures import LARGEST_AMOUNT
from .reports import CELLS, ITEMS, MONTHS, grain, group_totals, report_groups


def file_counts(raw: DataFrame) -> DataFrame:
    return raw.groupBy(SOURCE_COLUMN).agg(F.count(F.lit(1)).alias("nb_lignes")).orderBy(SOURCE_COLUMN)


def n_source_files(raw: DataFrame) -> DataFrame:
    return raw.agg(
        F.count_distinct(SOURCE_COLUMN).alias("nb_fichiers"), F.count(F.lit(1)).alias("nb_lignes")
    )


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("statut").agg(F.count(F.lit(1)).alias("nb_lignes")).orderBy(F.desc("nb_lignes"), "statut")


def distinct_discounts(df: DataFrame) -> DataFrame:
    return df.select("remise").distinct().orderBy("remise")


def count_lines(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count(F.lit(1)).alias("n"))


def count_lines_of_files(files: DataFrame) -> DataFrame:
    """The same figure out of the folder scan's description, without reading a line again."""
    return files.filter("lu").agg(F.coalesce(F.sum("nb_lignes"), F.lit(0)).alias("n"))


def quality_report(
    n_raw: DataFrame, unique: DataFrame, medians: dict[str, float | None], settings: Settings = Settings()
) -> DataFrame:
    """(step, column, rows concerned, value put in) in the order of the chain.

    ``unique`` is the stored table of unique lines; one aggregate over it gives
    every figure. ``n_raw`` holds the number of raw lines (one row, one column)
    and becomes a scalar subquery.
    """
    dated = F.col("date").isNotNull()
    readable = date_or_null(F.col("date"), settings.date_formats).isNotNull()
    counts = {
        "unique": F.count(F.lit(1)),
        "undated": F.count_if(~dated),
        "unreadable_date": F.count_if(dated & ~readable),
        "out": F.count_if(dated & readable),
    }
    for c in TEXT_COLUMNS:
        counts[f"null_{c}"] = F.count_if(dated & F.col(c).isNull())
    for c in NUMERIC_COLUMNS:
        bad = F.col(c + UNREADABLE_SUFFIX).isNotNull()
        counts[f"null_{c}"] = F.count_if(dated & F.col(c).isNull() & ~bad)
        counts[f"bad_{c}"] = F.count_if(dated & bad)
    counts["huge_quantite"] = F.count_if(dated & ~fits_quantity(F.col("quantite")))
    amount = F.abs(F.col("quantite") * F.col("prix_unitaire"))
    counts["huge_prix_unitaire"] = F.count_if(
        dated & fits_quantity(F.col("quantite")) & (amount >= LARGEST_AMOUNT)
    )
    figures = unique.agg(*[e.alias(k) for k, e in counts.items()]).withColumn("raw", n_raw.scalar())

    def text(value):
        return F.lit(None if value is None else float(value)).cast("double").cast("string")

    rows = [
        ("entree", None, F.col("raw"), None),
        ("doublons", None, F.col("raw") - F.col("unique"), None),
        ("date_absente", "date", F.col("undated"), None),
        *[("texte_absent", c, F.col(f"null_{c}"), F.lit(UNKNOWN)) for c in TEXT_COLUMNS],
        *[("nombre_absent", c, F.col(f"null_{c}"), text(medians[c] or 0.0)) for c in NUMERIC_COLUMNS],
        *[("nombre_illisible", c, F.col(f"bad_{c}"), text(0.0)) for c in NUMERIC_COLUMNS],
        *[
            ("nombre_hors_limites", c, F.col(f"huge_{c}"), text(0.0))
            for c in ("quantite", "prix_unitaire")
        ],
        ("date_illisible", "date", F.col("unreadable_date"), None),
        ("sortie", None, F.col("out"), None),
    ]
    return figures.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).cast("bigint").alias("ordre"),
                        F.lit(step).alias("etape"),
                        F.lit(column).cast("string").alias("colonne"),
                        n.cast("bigint").alias("nb"),
                        (F.lit(None).cast("string") if value is None else value).alias("valeur"),
                    )
                    for i, (step, column, n, value) in enumerate(rows, start=1)
                ]
            )
        )
    )


def reconcile(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Sum of each un-truncated grouping against the total over the lines."""
    groups = materialise(report_groups(df, settings), "groups")
    total = df.agg(F.sum("ca_comptabilise").alias("total"))
    axes = {"mois": MONTHS, "vendeur": CELLS, "region": CELLS, "categorie": ITEMS, "produit": ITEMS}
    sums = reduce(
        DataFrame.unionByName,
        [
            group_totals(grain(groups, keys), axis)
            .agg(F.sum(F.col("ca_total").cast("decimal(28,2)")).alias("somme"))
            .select(F.lit(axis).alias("axe"), "somme")
            for axis, keys in axes.items()
        ],
    )
    return sums.withColumn("total", total.scalar()).select(
        "axe",
        F.col("somme").cast("double").alias("somme"),
        F.col("total").cast("double").alias("total"),
        (F.col("somme") - F.col("total")).cast("double").alias("ecart"),
    )
