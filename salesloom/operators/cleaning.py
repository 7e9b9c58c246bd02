"""The data-quality chain: dirty text lines in, typed lines out.

The order of the steps changes results and is therefore fixed:

    parse_numbers -> dedupe -> drop_null_date -> fill_text -> impute_median
    -> typed -> normalize_discount -> clamp_negative -> canonical_status
    -> calendar_columns

Medians in particular are taken after the duplicates and the lines without a
date are gone, but before unreadable dates are dropped and before discounts
are rescaled.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import (
    date_or_null, month_name, na_to_null, number_or_null, strip_text,
)
from ..settings import (
    BUSINESS_COLUMNS, NUMERIC_COLUMNS, SOURCE_COLUMN, STATUS_FORMS, TEXT_COLUMNS, UNKNOWN, Settings,
)
from ..staging import materialise
from .median import approx_medians, exact_medians

UNREADABLE_SUFFIX = "_illisible"
UNREADABLE_COLUMNS = tuple(c + UNREADABLE_SUFFIX for c in NUMERIC_COLUMNS)
# Optional column of the ingest: place of the line inside its file.
POSITION_COLUMN = "_position"
# Names that the chain itself uses; a column of the feed of that name becomes ``name~1``.
RESERVED = (*UNREADABLE_COLUMNS, POSITION_COLUMN, "_empreinte", "_extras", "_chemin", "lot_ingestion")


def normalise_na(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Missing-value tokens become NULL in every text column."""
    return df.select(
        *[
            na_to_null(F.col(f"`{name}`"), settings.na_tokens).alias(name) if kind == "string"
            else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


def parse_numbers(df: DataFrame) -> DataFrame:
    """Numeric text to DOUBLE, so that ``2`` and ``2.0`` are one value.

    Text that is no number is kept aside in ``<column>_illisible``: it is not
    a gap (gaps get the median, unreadable text gets zero) and two different
    unreadable texts are not duplicates of each other.
    """
    parsed = {c: number_or_null(F.col(c)) for c in NUMERIC_COLUMNS}
    return df.withColumns(
        {
            **parsed,
            **{
                c + UNREADABLE_SUFFIX: F.when(parsed[c].isNull(), F.col(c))
                for c in NUMERIC_COLUMNS
            },
        }
    )


def dedupe(df: DataFrame) -> DataFrame:
    """One line per distinct value of the nine business columns, from the first file.

    Expects the output of :func:`parse_numbers`. Partial aggregation absorbs
    copies on the map side, so a line repeated a billion times still reaches
    the shuffle once per task. The 64-bit hash leads the key because Spark
    aggregates text minima by sorting: a leading long makes that a radix sort.
    All key columns stay in the key, the hash alone decides nothing.
    """
    keys = [*BUSINESS_COLUMNS, *UNREADABLE_COLUMNS]
    extras = [
        c for c in df.columns if c not in {*keys, SOURCE_COLUMN, POSITION_COLUMN}
    ]
    hashed = df.withColumn("_empreinte", F.xxhash64(*keys))
    has_source = SOURCE_COLUMN in df.columns
    if extras:
        order = [F.col(c) for c in (SOURCE_COLUMN, POSITION_COLUMN) if c in df.columns]
        payload = F.struct(*[F.col(f"`{c}`") for c in extras])
        kept = F.min_by(payload, F.struct(*order, payload)).alias("_extras")
        aggregates = [kept, *([F.min(SOURCE_COLUMN).alias(SOURCE_COLUMN)] if has_source else [])]
    elif has_source:
        aggregates = [F.min(SOURCE_COLUMN).alias(SOURCE_COLUMN)]
    else:
        return hashed.select("_empreinte", *keys).distinct().drop("_empreinte")
    return (
        hashed.groupBy("_empreinte", *keys).agg(*aggregates)
        .select(
            *keys,
            *[F.col("_extras").getField(c).alias(c) for c in extras],
            *([SOURCE_COLUMN] if has_source else []),
        )
    )


def drop_null_date(df: DataFrame) -> DataFrame:
    return df.filter(F.col("date").isNotNull())


def fill_text(df: DataFrame) -> DataFrame:
    """Missing text becomes ``Inconnu``; blank text is not missing and stays."""
    return df.na.fill(UNKNOWN, subset=list(TEXT_COLUMNS))


def medians(df: DataFrame, settings: Settings = Settings()) -> dict[str, float | None]:
    """Medians of the readable numbers of all lines of ``df``."""
    find = exact_medians if settings.median == "exact" else approx_medians
    return find(df, NUMERIC_COLUMNS)


def impute_median(
    df: DataFrame, settings: Settings = Settings(), known: dict[str, float | None] | None = None
) -> DataFrame:
    """Gaps get the column median (zero if the column is empty), unreadable text gets zero.

    The medians are three scalars and enter the plan as literals. Without
    ``known`` they are computed from ``df``, which should then be a stored table.
    """
    known = medians(df, settings) if known is None else known
    return df.withColumns(
        {
            c: F.coalesce(
                F.col(c),
                F.when(F.col(c + UNREADABLE_SUFFIX).isNull(), F.lit(known[c]).cast("double")),
                F.lit(0.0),
            )
            for c in NUMERIC_COLUMNS
        }
    )


def typed(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Dates, whole quantities (cut toward zero), prices and discounts; text is stripped.

    Lines whose date no format reads are dropped. Prices and discounts keep all digits of
    double precision; a quantity beyond 64 bits becomes zero, which the quality report counts.
    """
    quantity = F.when(fits_quantity(F.col("quantite")), F.col("quantite").cast("bigint"))
    return (
        df.withColumns(
            {
                "date": date_or_null(F.col("date"), settings.date_formats),
                "quantite": F.coalesce(quantity, F.lit(0).cast("bigint")),
                "prix_unitaire": F.coalesce(F.col("prix_unitaire"), F.lit(0.0)),
                "remise": F.coalesce(F.col("remise"), F.lit(0.0)),
            }
        )
        .filter(F.col("date").isNotNull())
        .transform(trim_text)
        .drop(*UNREADABLE_COLUMNS)
    )


def fits_quantity(value: Column) -> Column:
    """Whether a number is in the range of whole quantities."""
    return (value > -(2.0**63)) & (value < 2.0**63)


def trim_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: strip_text(F.col(c)) for c in TEXT_COLUMNS})


def normalize_discount(df: DataFrame) -> DataFrame:
    """Percentages above 1 become fractions, then clamp to [0, 1]; exactly 1 stays 100 %."""
    x = F.col("remise").cast("double")
    fraction = F.when(x > 1, x / 100).otherwise(x)
    return df.withColumn("remise", F.greatest(F.least(fraction, F.lit(1.0)), F.lit(0.0)))


def clamp_negative(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns(
        {c: F.greatest(F.col(c), F.lit(0).cast(kinds[c])) for c in ("quantite", "prix_unitaire")}
    )


def canonical_status(df: DataFrame) -> DataFrame:
    """Known spellings to the canonical status, everything else to ``Inconnu``."""
    forms = F.create_map(*[F.lit(x) for x in chain.from_iterable(STATUS_FORMS.items())])
    spelling = strip_text(F.lower(F.col("statut")))
    return df.withColumn("statut", F.coalesce(F.element_at(forms, spelling), F.lit(UNKNOWN)))


def calendar_columns(df: DataFrame) -> DataFrame:
    """Calendar year, month, French month name, ISO week and quarter."""
    day = F.col("date")
    return df.withColumns(
        {
            "annee": F.year(day),
            "mois": F.month(day),
            "mois_nom": month_name(F.month(day)),
            "semaine": F.weekofyear(day),
            "trimestre": F.quarter(day),
        }
    )


def unique_lines(raw: DataFrame, stage: str | None = None) -> DataFrame:
    """Stored result of the only shuffle of the chain (parse + dedupe).

    The medians and the final projection both read it, the medians only its
    three numeric columns.
    """
    return materialise(dedupe(parse_numbers(raw)), "unique", stage)


def clean_unique(
    unique: DataFrame, settings: Settings = Settings(), known: dict[str, float | None] | None = None
) -> DataFrame:
    """Everything after the deduplication: scalars, then one narrow projection."""
    dated = drop_null_date(unique)
    known = medians(dated, settings) if known is None else known
    return (
        dated.transform(fill_text)
        .transform(impute_median, settings, known)
        .transform(typed, settings)
        .transform(normalize_discount)
        .transform(clamp_negative)
        .transform(canonical_status)
        .transform(calendar_columns)
    )


def clean(raw: DataFrame, settings: Settings = Settings(), stage: str | None = None) -> DataFrame:
    """The whole chain. ``stage`` names the table of unique lines, else it goes to staging."""
    return clean_unique(unique_lines(raw, stage), settings)
