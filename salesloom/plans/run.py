"""One run: folder of CSV exports in, report tables out."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import analytics, cleaning, quality, reports
from ..operators.measures import enrich
from ..settings import BUSINESS_COLUMNS, MONTH_NAMES, MONTH_NAMES_PLAIN, SOURCE_COLUMN, Settings
from ..sources.csv_files import Scan, as_raw, scan_csv
from ..staging import materialise, scratch
from .sinks import write_reports


@dataclass(frozen=True)
class Run:
    path: str
    run_id: str
    period: str
    reports: tuple[str, ...]


def transform(lines: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Enriched lines and the seven result tables of cleaned lines.

    The tables come from one stored pass over the lines (``groupes``).
    """
    enriched = enrich(lines, settings)
    groups = materialise(reports.report_groups(enriched, settings), "groups")
    return {"lignes": enriched, "groupes": groups, **reports.reports_from_groups(groups, settings)}


def report_tables(results: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The printed tables: cards, rankings, months, shares, cross-tab."""
    return {
        "kpi_cards": analytics.kpi_cards(results["kpis"]),
        "vendeurs": analytics.with_rank(results["par_vendeur"], "vendeur"),
        "mois": analytics.monthly_columns(results["par_mois"]),
        "categories": analytics.share_columns(results["par_categorie"], "categorie"),
        "regions": analytics.share_columns(results["par_region"], "region"),
        "heatmap": results["heatmap"],
        "produits": analytics.with_rank(results["top_produits"], "produit"),
    }


def period_label(run_date: date, scheduled: bool = False) -> str:
    """Label of a run: its month, or the month before for a scheduled monthly run."""
    if scheduled:
        before = run_date.replace(day=1) - timedelta(days=1)
        return f"{MONTH_NAMES_PLAIN[before.month - 1]} {before.year}"
    return f"{MONTH_NAMES[run_date.month - 1]} {run_date.year}"


def run(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    period: str | None = None,
    run_date: date | None = None,
    run_id: str | None = None,
    settings: Settings = Settings(),
    fmt: str = "parquet",
    scheduled: bool = False,
) -> Run:
    """Ingest, clean, report and write. The period is a label and never filters lines.

    Raises FileNotFoundError without input, SalesDataError for unusable input.
    """
    with scratch(spark):
        scan: Scan = scan_csv(spark, in_dir)
        raw = as_raw(scan.lines, settings)
        return report_raw(spark, raw, out_dir, period, run_date, run_id, settings, fmt, scan.files, scheduled)


def report_raw(
    spark: SparkSession,
    raw: DataFrame,
    out_dir: str,
    period: str | None = None,
    run_date: date | None = None,
    run_id: str | None = None,
    settings: Settings = Settings(),
    fmt: str = "parquet",
    files: DataFrame | None = None,
    scheduled: bool = False,
) -> Run:
    """The run after ingest, over raw lines (also those stored by the stream).

    With ``files``, the description of the folder scan, the raw lines are read
    exactly once, by the deduplication; line counts come from the description.
    """
    run_id = run_id or f"{datetime.now():%Y%m%d_%H%M%S}_{uuid4().hex[:8]}"
    period = period or period_label(run_date or date.today(), scheduled)
    with scratch(spark):
        # Reports need no provenance: without it the deduplication hashes instead of sorts.
        unique = cleaning.unique_lines(raw.select(*BUSINESS_COLUMNS))
        found = cleaning.medians(cleaning.drop_null_date(unique), settings)
        results = transform(cleaning.clean_unique(unique, settings, found), settings)
        datasets = report_tables(results)
        if files is None:
            datasets["qualite"] = quality.quality_report(quality.count_lines(raw), unique, found, settings)
            datasets["lignes_par_fichier"] = quality.file_counts(raw.select(SOURCE_COLUMN))
        else:
            n_raw = quality.count_lines_of_files(files)
            datasets["qualite"] = quality.quality_report(n_raw, unique, found, settings)
            datasets["fichiers"] = files
        datasets = {name: df.withColumn("periode", F.lit(period)) for name, df in datasets.items()}
        path = write_reports(datasets, out_dir, run_id, fmt)
    return Run(path, run_id, period, tuple(datasets))
