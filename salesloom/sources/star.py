"""Views of the star-schema test tables in the shape of the sales feed.

``sales`` gives canonical lines, ``raw_sales`` the same lines as dirty text.
The dirt is chosen by integer arithmetic on the keys, so that any SQL engine
builds the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.cleaning import calendar_columns
from ..settings import (
    BUSINESS_COLUMNS, CANCELLED, DELIVERED, IN_PROGRESS, RETURNED, SOURCE_COLUMN,
)

_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _status():
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    return (
        F.when(flag == "R", RETURNED)
        .when((flag == "A") & (line == "F"), CANCELLED)
        .when(flag == "A", IN_PROGRESS)
        .otherwise(DELIVERED)
    )


def _joined(spark: SparkSession, sf_dir: str, columns: tuple[str, ...]) -> DataFrame:
    """Lines with the dimensions that ``columns`` need and no others.

    The view left-joins its dimensions on their primary keys, so every query sees all
    lines, and a dimension nobody reads can be left out: that saves the largest shuffle
    (lines to orders) in most reports. No join is hinted: Catalyst broadcasts what its
    size statistics allow and sort-merges the rest, with AQE splitting skewed keys. The
    widest texts come last, so that lines are narrow in the shuffles before.
    """
    lines = table(spark, sf_dir, "lineitem")
    if "region" in columns:
        # The three small dimensions meet first, so that lines are shuffled once.
        places = (
            table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
            .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"),
                  F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"),
                  F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select("c_custkey", "r_name")
        )
        orders = (
            table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
            .join(places, F.col("o_custkey") == F.col("c_custkey"), "left")
            .select("o_orderkey", "r_name")
        )
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if "vendeur" in columns:
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
        lines = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    if {"produit", "categorie", "prix_unitaire"} & set(columns):
        part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return lines


def sales(
    spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = BUSINESS_COLUMNS
) -> DataFrame:
    """Canonical sales lines; ``columns`` names the business columns to build."""
    expressions = {
        "date": lambda: F.col("l_shipdate").cast("date"),
        "vendeur": lambda: F.col("s_name"),
        "region": lambda: F.col("r_name"),
        "produit": lambda: F.col("p_name"),
        "categorie": lambda: F.col("p_type"),
        "quantite": lambda: F.col("l_quantity").cast("bigint"),
        "prix_unitaire": lambda: F.col("p_retailprice").cast("decimal(14,4)"),
        "remise": lambda: F.col("l_discount").cast("decimal(9,8)"),
        "statut": _status,
    }
    return _joined(spark, sf_dir, columns).select(*[expressions[c]().alias(c) for c in columns])


def sales_with_calendar(
    spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = BUSINESS_COLUMNS
) -> DataFrame:
    return calendar_columns(sales(spark, sf_dir, columns))


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty text lines: gaps, bad dates and numbers, spelling variants, duplicates."""
    k = (
        F.col("l_orderkey") * 7 + F.col("l_partkey") * 13
        + F.col("l_suppkey") * 3 + F.col("l_linenumber")
    )
    lines = _joined(spark, sf_dir, BUSINESS_COLUMNS).select(
        k.alias("k"),
        F.col("l_shipdate").cast("date").alias("day"),
        "s_name", "r_name", "p_name", "p_type",
        F.col("l_quantity").cast("bigint").alias("qty"),
        F.col("p_retailprice").cast("decimal(14,2)").alias("price"),
        F.col("l_discount").cast("decimal(4,2)").alias("discount"),
        _status().alias("status"),
    )
    # One pass over the joined lines: a duplicated line is exploded in place.
    copies = lines.withColumn(
        "copy", F.explode(F.when(F.col("k") % 97 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )

    def every(n: int):
        return F.col("k") % n == 0

    even = F.col("k") % 2 == 0
    price_text = (
        F.when(every(47), F.lit(None))
        .when(every(71), (-F.col("price")).cast("string"))
        .otherwise(F.col("price").cast("string"))
    )
    return copies.select(
        F.when(every(53), F.lit(None)).when(every(59), "date-invalide")
        .otherwise(F.date_format("day", "yyyy-MM-dd")).alias("date"),
        F.when(every(41), F.lit(None)).when(every(7), F.concat(F.lit("  "), "s_name", F.lit(" ")))
        .otherwise(F.col("s_name")).alias("vendeur"),
        F.when(every(43), F.lit(None)).otherwise(F.col("r_name")).alias("region"),
        F.col("p_name").alias("produit"),
        F.col("p_type").alias("categorie"),
        F.when(every(37), F.lit(None)).when(every(61), (-F.col("qty")).cast("string")).when(every(67), "abc")
        .otherwise(F.col("qty").cast("string")).alias("quantite"),
        F.when(F.col("copy") == 1, F.concat(price_text, F.lit("0"))).otherwise(price_text).alias("prix_unitaire"),
        F.when(every(31), F.lit(None))
        .when(every(5), (F.col("discount") * 100).cast("decimal(6,2)").cast("string"))
        .otherwise(F.col("discount").cast("string")).alias("remise"),
        F.when(every(73), "???")
        .when((F.col("status") == RETURNED) & even, "RETOURNE")
        .when((F.col("status") == CANCELLED) & even, "annule")
        .when((F.col("status") == IN_PROGRESS) & even, "encours")
        .when((F.col("status") == DELIVERED) & (F.col("k") % 3 == 0), "LIVRÉ")
        .when((F.col("status") == DELIVERED) & (F.col("k") % 3 == 1), " livre ")
        .otherwise(F.col("status")).alias("statut"),
        F.when(F.col("copy") == 1, "ventes_zz_doublons.csv")
        .otherwise(F.concat(F.lit("ventes_"), F.date_format("day", "yyyy_MM"), F.lit(".csv")))
        .alias(SOURCE_COLUMN),
    )
