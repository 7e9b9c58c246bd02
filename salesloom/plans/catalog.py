"""Every operator as a registered query over the star-schema tables.

Each function takes (session, folder of the tables) and runs over all rows.
Line-level queries emit decimals as DOUBLE, like the reports.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import labels
from ..operators import analytics, cleaning, quality, reports
from ..operators.measures import enrich
from ..settings import (
    BUSINESS_COLUMNS, NA_TOKENS, NUMERIC_COLUMNS, SOURCE_COLUMN, TEXT_COLUMNS, Settings,
)
from ..sources import csv_files
from ..sources.csv_files import union_by_name
from ..sources.star import raw_sales, sales, sales_with_calendar, table
from ..staging import materialise, release, scratch, staging_path
from ..streaming import incremental, monthly
from . import run, sinks

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

_AMOUNTS = ("quantite", "prix_unitaire", "remise", "statut")
_DATED = ("date", *_AMOUNTS)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _doubles(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.col(f"`{n}`").cast("double").alias(n) if t.startswith("decimal") else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def _lines(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    """Enriched canonical lines with the given key columns only."""
    if "date" in keys:
        return enrich(sales_with_calendar(spark, d, (*keys, *_AMOUNTS)))
    return enrich(sales(spark, d, (*keys, *_AMOUNTS)))


# ---------------------------------------------------------------- measures


@query
def measures(spark, d):
    return _doubles(enrich(sales(spark, d)))


@query
def measures_strict(spark, d):
    """The documented variant: only delivered and running orders are revenue."""
    strict = Settings(status_policy="include_only")
    # Odd quantities get a status nobody knows, which the two policies treat differently.
    df = sales(spark, d).withColumn(
        "statut", F.when(F.col("quantite") % 2 == 1, "Inconnu").otherwise(F.col("statut"))
    )
    wide = enrich(df).withColumnRenamed("ca_comptabilise", "ca_large")
    return enrich(wide, strict).groupBy("statut").agg(
        F.sum("ca_large").cast("double").alias("ca_large"),
        F.sum("ca_comptabilise").cast("double").alias("ca_strict"),
    )


# ---------------------------------------------------------------- reports


@query
def kpis(spark, d):
    return reports.kpis(_lines(spark, d, "vendeur", "produit"))


@query
def top_vendors(spark, d):
    return reports.top_vendors(_lines(spark, d, "vendeur"))


@query
def top_products(spark, d):
    return reports.top_products(_lines(spark, d, "produit"))


@query
def by_month(spark, d):
    return reports.by_month(_lines(spark, d, "date"))


@query
def by_category(spark, d):
    return reports.by_category(_lines(spark, d, "categorie"))


@query
def by_region(spark, d):
    return reports.by_region(_lines(spark, d, "region"))


@query
def heatmap_long(spark, d):
    return reports.heatmap_long(_lines(spark, d, "vendeur", "region"))


@query
def heatmap_empty_cells(spark, d):
    """The dense cross-tab per salesperson and month, where many cells are empty."""
    lines = _lines(spark, d, "date", "vendeur", "region")
    monthly_teams = F.concat_ws(" ", "vendeur", F.date_format("date", "yyyy-MM"))
    return reports.heatmap_long(lines.withColumn("vendeur", monthly_teams))


@query
def heatmap_wide(spark, d):
    regions = [r[0] for r in table(spark, d, "region").select("r_name").orderBy("r_name").collect()]
    return reports.heatmap_wide(_lines(spark, d, "vendeur", "region"), regions)


@query
def rollup(spark, d):
    return _doubles(reports.rollup(enrich(sales_with_calendar(spark, d))))


@query
def report_groups(spark, d):
    """All report groupings in one pass; the other reports are filters of this table."""
    return _doubles(reports.report_groups(enrich(sales_with_calendar(spark, d))))


# ---------------------------------------------------------------- analytic columns


@query
def vendor_rank(spark, d):
    return analytics.vendor_table(_lines(spark, d, "vendeur"))


@query
def product_rank(spark, d):
    return analytics.product_table(_lines(spark, d, "produit"))


@query
def month_over_month(spark, d):
    months = reports.month_totals(_lines(spark, d, "date"))
    return analytics.with_change(months).withColumn("variation_pct", F.bround("variation_pct", 2))


@query
def running_total(spark, d):
    return analytics.with_running_total(reports.month_totals(_lines(spark, d, "date")))


@query
def month_trend(spark, d):
    months = analytics.with_change(reports.month_totals(_lines(spark, d, "date")))
    return analytics.with_trend(months).select("annee", "mois", "tendance")


@query
def category_share(spark, d):
    return analytics.category_table(_lines(spark, d, "categorie"))


@query
def region_share(spark, d):
    return analytics.region_table(_lines(spark, d, "region"))


@query
def best_flag(spark, d):
    return analytics.with_best_flag(reports.top_vendors(_lines(spark, d, "vendeur")), "vendeur")


@query
def monthly_table(spark, d):
    return analytics.monthly_table(_lines(spark, d, "date"))


@query
def kpi_cards(spark, d):
    return analytics.kpi_cards(reports.kpis(_lines(spark, d, "vendeur", "produit")))


# ---------------------------------------------------------------- labels


@query
def euro_label(spark, d):
    lines = _lines(spark, d).select("ca_brut", "ca_net")
    return lines.select(
        F.col("ca_net").cast("double").alias("ca_net"),
        labels.euro_label(F.col("ca_net")).alias("texte"),
        labels.euro_label(F.col("ca_net").cast("double") * 100).alias("texte_centuple"),
    )


@query
def money_label(spark, d):
    lines = _lines(spark, d)
    return lines.select(
        F.col("ca_net").cast("double").alias("ca_net"),
        labels.money_label(F.col("ca_net").cast("double")).alias("texte"),
    )


@query
def pct_label(spark, d):
    x = F.col("remise").cast("double") * 100
    return sales(spark, d, ("remise", "statut")).select(
        x.alias("pct"),
        labels.pct_label(x).alias("texte"),
        labels.change_label(x - 5).alias("texte_signe"),
    )


@query
def period_label(spark, d):
    """Labels of a run on each day that has sales."""
    days = sales(spark, d, ("date",)).distinct()
    return days.select(
        "date",
        labels.current_period_label(F.col("date")).alias("libelle"),
        labels.previous_period_label(F.col("date")).alias("libelle_mois_precedent"),
    )


@query
def calendar_cols(spark, d):
    return sales_with_calendar(spark, d, ("date", "vendeur"))


# ---------------------------------------------------------------- cleaning chain


@query
def na_tokens(spark, d):
    """Gaps written as every missing-value token in turn, then read back as gaps."""
    raw = raw_sales(spark, d)
    spelled = F.array(*[F.lit(t) for t in NA_TOKENS])
    columns = [c for c in raw.columns if c != SOURCE_COLUMN]

    def token(i):
        n = F.pmod(F.xxhash64("vendeur", "produit", "date") + i, F.lit(len(NA_TOKENS))).cast("int")
        return F.element_at(spelled, n + 1)

    dirty = raw.select(
        *[F.coalesce(F.col(c), token(i)).alias(c) for i, c in enumerate(columns)], SOURCE_COLUMN
    )
    return cleaning.normalise_na(dirty)


@query
def parse_numbers(spark, d):
    return cleaning.parse_numbers(raw_sales(spark, d))


@query
def dedupe(spark, d):
    return cleaning.dedupe(cleaning.parse_numbers(raw_sales(spark, d)))


def _unique(spark, d):
    return cleaning.unique_lines(raw_sales(spark, d))


def _imputed(spark, d):
    dated = cleaning.drop_null_date(_unique(spark, d))
    return cleaning.impute_median(cleaning.fill_text(dated))


@query
def drop_null_date(spark, d):
    return cleaning.drop_null_date(cleaning.dedupe(cleaning.parse_numbers(raw_sales(spark, d))))


@query
def fill_text(spark, d):
    return cleaning.fill_text(drop_null_date(spark, d))


@query
def exact_medians(spark, d):
    """The three medians as a row, computed over the stored unique lines."""
    dated = cleaning.drop_null_date(_unique(spark, d))
    found = cleaning.medians(dated)
    return dated.agg(
        *[F.count(c).alias(f"nb_{c}") for c in NUMERIC_COLUMNS],
        *[F.max(F.lit(found[c])).alias(f"mediane_{c}") for c in NUMERIC_COLUMNS],
    )


@query
def impute_median(spark, d):
    return _imputed(spark, d)


@query
def typed(spark, d):
    return _doubles(cleaning.typed(_imputed(spark, d)))


@query
def extreme_values(spark, d):
    """Quantities and prices far beyond ten digits, long discounts, tiny prices."""
    lines = table(spark, d, "lineitem").join(
        table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    huge, long = line == 1, line == 2
    price = F.col("p_retailprice").cast("double") * 1_000_000
    tiny = F.concat(F.lit("0.0000"), (4 + order % 5).cast("string"))
    text = lines.select(
        "l_orderkey", "l_linenumber", F.lit("2024-01-05").alias("date"),
        *[F.lit("x").alias(c) for c in TEXT_COLUMNS],
        F.when(huge, F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit("000000000000")))
        .when(long, "9000000").otherwise("1000000").alias("quantite"),
        F.when(huge, price.cast("string")).when(long, "1").otherwise(tiny).alias("prix_unitaire"),
        F.when(long, F.concat(F.lit("0."), (33333333 + order % 7).cast("string")))
        .otherwise("0").alias("remise"),
    )
    chain = cleaning.parse_numbers(text).transform(cleaning.typed)
    lines = enrich(chain.transform(cleaning.normalize_discount).transform(cleaning.clamp_negative))
    return _doubles(lines.select(
        "l_orderkey", "l_linenumber", "quantite", "prix_unitaire", "remise", "ca_net"
    ))


@query
def typed_datetimes(spark, d):
    """Days spelled in turn as date, date-time and date without leading zeros."""
    day = F.col("l_shipdate").cast("date")
    turn = F.col("l_orderkey") % 4
    text = F.when(turn == 0, F.date_format(day, "yyyy-MM-dd")).when(
        turn == 1, F.date_format(day, "yyyy-MM-dd 08:30:00")
    ).when(turn == 2, F.date_format(day, "yyyy-M-d")).otherwise(
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T23:59:59"))
    )
    raw = table(spark, d, "lineitem").select(
        text.alias("date"), *[F.lit("x").alias(c) for c in TEXT_COLUMNS],
        *[F.lit("1").alias(c) for c in NUMERIC_COLUMNS],
    )
    lines = cleaning.typed(cleaning.parse_numbers(raw))
    return lines.groupBy("date").agg(F.count(F.lit(1)).alias("nb"))


@query
def trim_text(spark, d):
    return cleaning.trim_text(raw_sales(spark, d)).select(*TEXT_COLUMNS, SOURCE_COLUMN)


@query
def normalize_discount(spark, d):
    return _doubles(cleaning.normalize_discount(cleaning.typed(_imputed(spark, d))))


@query
def clamp_negative(spark, d):
    return _doubles(
        cleaning.typed(_imputed(spark, d))
        .transform(cleaning.normalize_discount).transform(cleaning.clamp_negative)
    )


@query
def canonical_status(spark, d):
    return (
        cleaning.canonical_status(cleaning.fill_text(raw_sales(spark, d)))
        .groupBy("statut", SOURCE_COLUMN).agg(F.count(F.lit(1)).alias("nb_lignes"))
    )


@query
def clean(spark, d):
    return _doubles(cleaning.clean(raw_sales(spark, d)))


@query
def monthly_from_raw(spark, d):
    """Dirty lines to the monthly report table."""
    return analytics.monthly_table(enrich(cleaning.clean(raw_sales(spark, d))))


@query
def kpis_from_raw(spark, d):
    return reports.kpis(enrich(cleaning.clean(raw_sales(spark, d))))


# ---------------------------------------------------------------- quality


@query
def file_counts(spark, d):
    return quality.file_counts(raw_sales(spark, d))


@query
def n_source_files(spark, d):
    return quality.n_source_files(raw_sales(spark, d))


@query
def quality_report(spark, d):
    raw = raw_sales(spark, d)
    unique = cleaning.unique_lines(raw)
    found = cleaning.medians(cleaning.drop_null_date(unique))
    return quality.quality_report(quality.count_lines(raw), unique, found)


@query
def status_counts(spark, d):
    return quality.status_counts(raw_sales(spark, d))


@query
def distinct_discounts(spark, d):
    return _doubles(quality.distinct_discounts(sales(spark, d, ("remise", "statut"))))


@query
def top5_vendors(spark, d):
    top = reports.top_vendors(_lines(spark, d, "vendeur"), 5)
    return top.select(
        F.col("vendeur").alias("Vendeur"),
        F.concat(labels.money_label(F.col("ca_total")), F.lit(" €")).alias("CA Total"),
    )


@query
def reconcile(spark, d):
    return quality.reconcile(enrich(sales_with_calendar(spark, d)))


# ---------------------------------------------------------------- one-pass bundle


@query
def transform_bundle(spark, d):
    """The grouped result tables of a whole transform, stacked as (report, key, revenue)."""
    results = run.transform(sales_with_calendar(spark, d))
    keys = {
        "par_vendeur": F.col("vendeur"),
        "par_mois": F.concat_ws("-", "annee", "mois"),
        "par_categorie": F.col("categorie"),
        "par_region": F.col("region"),
        "top_produits": F.col("produit"),
    }
    return union_by_name(
        [
            results[name].select(F.lit(name).alias("rapport"), key.alias("cle"), "ca_total")
            for name, key in keys.items()
        ]
    )


@query
def transform_kpis(spark, d):
    return run.transform(sales_with_calendar(spark, d))["kpis"]


@query
def transform_heatmap(spark, d):
    return run.transform(sales_with_calendar(spark, d))["heatmap"]


# ---------------------------------------------------------------- files in and out
#
# The inputs below are CSV files that Spark writes from the tables.


def _feed(spark, d) -> DataFrame:
    return raw_sales(spark, d).select(*BUSINESS_COLUMNS)


@contextmanager
def _stored_raw(spark, d) -> Iterator[DataFrame]:
    """Dirty lines, joined once and stored while the block writes its input from them.

    The joins' shuffle files are larger than the lines: they would stand beside the files
    that are written, and those of every drop would pile up.
    """
    with scratch(spark):
        raw = materialise(raw_sales(spark, d), "raw")
        release(spark)
        yield raw


@contextmanager
def _halves(spark, d) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Dirty lines in two parts, for drops that differ from each other."""
    with _stored_raw(spark, d) as raw:
        first = F.col(SOURCE_COLUMN) < "ventes_1998_07.csv"
        yield raw.filter(first).select(*BUSINESS_COLUMNS), raw.filter(~first).select(*BUSINESS_COLUMNS)


@query
def scan_csv(spark, d):
    folder = staging_path(spark, "csv")
    sinks.write_csv(_feed(spark, d), folder)
    return csv_files.scan_csv(spark, folder).lines.select(*BUSINESS_COLUMNS)


@query
def scan_csv_reordered(spark, d):
    """Two drops with opposite column order."""
    folder = staging_path(spark, "csv")
    with _halves(spark, d) as (first, second):
        sinks.write_csv(first, folder)
        sinks.write_csv(second.select(*reversed(BUSINESS_COLUMNS)), folder, "append")
    return csv_files.scan_csv(spark, folder).lines.select(*BUSINESS_COLUMNS)


@query
def scan_reserved_names(spark, d):
    """The later drop comes in files whose names start with an underscore."""
    folder, drop = staging_path(spark, "csv"), staging_path(spark, "csv")
    with _halves(spark, d) as (first, second):
        sinks.write_csv(first, folder)
        sinks.write_csv(second, drop)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.globStatus(path(f"{drop}/*.csv")):
        files.rename(status.getPath(), path(folder, f"_{status.getPath().getName()}"))
    return csv_files.scan_csv(spark, folder).lines.select(
        *BUSINESS_COLUMNS, F.col(SOURCE_COLUMN).startswith("_").alias("reserve")
    )


@query
def scan_csv_quoted(spark, d):
    """Quotes, commas and line breaks inside fields."""
    folder = staging_path(spark, "csv")
    awkward = F.concat(F.col("produit"), F.lit(' 27"\n, '), F.col("categorie"))
    with _stored_raw(spark, d) as raw:
        sinks.write_csv(raw.select(*BUSINESS_COLUMNS).withColumn("produit", awkward), folder)
    return csv_files.scan_csv(spark, folder).lines.select(*BUSINESS_COLUMNS)


@query
def scan_csv_loose_quotes(spark, d):
    """Fields that go on after their closing quote; the text behind it belongs to them."""
    folder = staging_path(spark, "csv")
    loose = F.concat(
        F.lit('"'), F.col("produit"), F.lit(", "), F.col("categorie"), F.lit('" de "base" 2')
    )
    fields = [F.coalesce(loose if c == "produit" else F.col(c), F.lit("")) for c in BUSINESS_COLUMNS]
    header = ",".join(BUSINESS_COLUMNS)
    lines = _feed(spark, d).select(F.concat_ws(",", *fields).alias(header))
    lines.write.options(
        header=True, sep="\u0001", quote="\u0000", escapeQuotes=False,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(folder)
    return csv_files.scan_csv(spark, folder).lines.select(*BUSINESS_COLUMNS)


@query
def union_files(spark, d):
    """The later drop lacks the discount and brings a new column."""
    folder = staging_path(spark, "csv")
    with _halves(spark, d) as (first, second):
        sinks.write_csv(first, folder)
        sinks.write_csv(second.drop("remise").withColumn("commentaire", F.upper("produit")), folder, "append")
    return csv_files.scan_csv(spark, folder).lines.select(*BUSINESS_COLUMNS, "commentaire")


@query
def provenance(spark, d):
    """Lines whose provenance is the name of a file of the folder."""
    folder = staging_path(spark, "csv")
    sinks.write_csv(_feed(spark, d), folder)
    scan = csv_files.scan_csv(spark, folder)
    counted = scan.lines.groupBy(SOURCE_COLUMN).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(scan.files, SOURCE_COLUMN).agg(
        F.sum("n").alias("nb_lignes"),
        F.count_if(F.col("n") != F.col("nb_lignes")).alias("nb_ecarts"),
        F.count_if(~F.col(SOURCE_COLUMN).rlike(r"^part-\d+-.*\.csv$")).alias("nb_noms_faux"),
    )


@query
def quarantine_files(spark, d):
    """The later drop has a surplus field in every line; its files go aside whole."""
    folder = staging_path(spark, "csv")
    line = F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in BUSINESS_COLUMNS], F.lit("surplus"))
    with _halves(spark, d) as (first, second):
        sinks.write_csv(first, folder)
        # One text column named like the header line: the writer puts it on top of every file.
        (
            second.select(line.alias(",".join(BUSINESS_COLUMNS)))
            .write.mode("append").option("header", True).option("sep", "\u0001").option("quote", "\u0000")
            .csv(folder)
        )
    scan = csv_files.scan_csv(spark, folder)
    aside = csv_files.quarantined(scan.files)
    return union_by_name(
        [
            scan.lines.agg(F.lit("lues").alias("etat"), F.count(F.lit(1)).alias("nb")),
            aside.agg(F.lit("fautives").alias("etat"), F.sum("nb_lignes_fautives").alias("nb")),
        ]
    )


@query
def validate_columns(spark, d):
    return csv_files.validate_columns(_feed(spark, d))


@query
def ingest(spark, d):
    """Missing-value tokens in the files, gaps in the result."""
    folder = staging_path(spark, "csv")
    sinks.write_csv(_feed(spark, d).na.fill("NA"), folder)
    return csv_files.ingest(spark, folder).select(*BUSINESS_COLUMNS)


@query
def stream_ingest(spark, d):
    """Two drops, two runs of the stream; the second reads only the new files."""
    folder, table_dir, marks = (staging_path(spark, n) for n in ("csv", "stream", "marks"))
    with _halves(spark, d) as (first, second):
        sinks.write_csv(first, folder)
        monthly.ingest_new_files(spark, folder, table_dir, marks)
        sinks.write_csv(second, folder, "append")
    monthly.ingest_new_files(spark, folder, table_dir, marks)
    return monthly.stored_lines(spark, table_dir).select(*BUSINESS_COLUMNS)


@query
def stream_subfolders(spark, d):
    """Folders beside the files, one named like a partition, are not part of the feed."""
    folder, table_dir, marks = (staging_path(spark, n) for n in ("csv", "stream", "marks"))
    with _halves(spark, d) as (first, second):
        sinks.write_csv(first, folder)
        sinks.write_csv(second, f"{folder}/annee=1999")
        sinks.write_csv(second, f"{folder}/autres")
    monthly.ingest_new_files(spark, folder, table_dir, marks)
    return monthly.stored_lines(spark, table_dir).select(*BUSINESS_COLUMNS)


def _three_drops(spark, d):
    """The state after three drops: copies lie in different drops, every drop has late lines."""
    folder = staging_path(spark, "state")
    with _stored_raw(spark, d) as raw:
        turn = F.pmod(F.xxhash64(*raw.columns), F.lit(3))
        for number in range(3):
            state = incremental.add_drop(spark, raw.where(turn == number), folder, number)
    return state


@query
def stream_dedupe(spark, d):
    """Unique lines after three drops, each matched with the months that it touches."""
    state = _three_drops(spark, d)
    return incremental.unique_lines(state).select(*dedupe(spark, d).columns)


@query
def medians_incremental(spark, d):
    """The three medians from sketches stored with each drop, and one counting pass."""
    state = _three_drops(spark, d)
    found = incremental.medians(state)
    return cleaning.drop_null_date(incremental.unique_lines(state)).agg(
        *[F.count(c).alias(f"nb_{c}") for c in NUMERIC_COLUMNS],
        *[F.max(F.lit(found[c])).alias(f"mediane_{c}") for c in NUMERIC_COLUMNS],
    )


@query
def reports_incremental(spark, d):
    """All report groupings of the dirty lines, added up from the months of three drops."""
    return _doubles(incremental.report_groups(_three_drops(spark, d)))


@query
def csv_roundtrip(spark, d):
    """Canonical lines written as CSV by month and read back with their types."""
    folder = staging_path(spark, "export")
    lines = sales_with_calendar(spark, d).drop("mois_nom", "semaine", "trimestre")
    sinks.export_csv(lines, folder)
    kinds = {**dict(lines.dtypes)}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in lines.columns)
    return _doubles(
        spark.read.schema(schema).option("header", True).option("escape", '"').csv(folder)
    )


@query
def write_reports(spark, d):
    """Cards written as JSON and read back."""
    out = staging_path(spark, "reports")
    cards = analytics.kpi_cards(reports.kpis(_lines(spark, d, "vendeur", "produit")))
    sinks.write_reports({"kpi_cards": cards}, out, "essai", "json")
    return sinks.read_report(spark, out, "essai", "kpi_cards", "json")


@query
def run_reports(spark, d):
    """CSV folder to written reports, end to end; the monthly table is read back."""
    folder, out = staging_path(spark, "csv"), staging_path(spark, "reports")
    sinks.write_csv(_feed(spark, d), folder)
    done = run.run(spark, folder, out, period="Essai", run_id="essai")
    return sinks.read_report(spark, out, done.run_id, "mois").drop("periode")


@query
def run_heatmap(spark, d):
    """The cross-tab as a whole run writes it, read back."""
    folder, out = staging_path(spark, "csv"), staging_path(spark, "reports")
    sinks.write_csv(_feed(spark, d), folder)
    done = run.run(spark, folder, out, period="Essai", run_id="essai")
    return sinks.read_report(spark, out, done.run_id, "heatmap").drop("periode")
