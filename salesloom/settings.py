"""Contract of the sales feed and the run parameters shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

# --------------------------------------------------------------------------
# Names, forms and tokens that results depend on.
# --------------------------------------------------------------------------

BUSINESS_COLUMNS = (
    "date", "vendeur", "region", "produit", "categorie",
    "quantite", "prix_unitaire", "remise", "statut",
)
TEXT_COLUMNS = ("vendeur", "region", "produit", "categorie", "statut")
NUMERIC_COLUMNS = ("quantite", "prix_unitaire", "remise")
SOURCE_COLUMN = "source_fichier"

UNKNOWN = "Inconnu"
DELIVERED, IN_PROGRESS, CANCELLED, RETURNED = "Livré", "En cours", "Annulé", "Retourné"

# Lower-case spelling -> canonical status.
STATUS_FORMS = {
    "livre": "Livré",
    "livré": "Livré",
    "en cours": "En cours",
    "encours": "En cours",
    "annule": "Annulé",
    "annulé": "Annulé",
    "retourne": "Retourné",
    "retourné": "Retourné",
}

MONTH_NAMES = (
    "Janvier", "Février", "Mars", "Avril", "Mai", "Juin",
    "Juillet", "Août", "Septembre", "Octobre", "Novembre", "Décembre",
)

# Unaccented names, used only in the label of a scheduled monthly run.
MONTH_NAMES_PLAIN = (
    "Janvier", "Fevrier", "Mars", "Avril", "Mai", "Juin",
    "Juillet", "Aout", "Septembre", "Octobre", "Novembre", "Decembre",
)

# Labels of the eight report cards, in order: four main ones, four others.
CARD_LABELS = (
    "CA Total", "Commandes", "Panier Moyen", "Taux Annulation",
    "Vendeurs actifs", "Produits vendus", "Remises accordees", "Annulations",
)

# Default missing-value tokens of the public pandas CSV reader.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Characters that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


@dataclass(frozen=True)
class Settings:
    """Parameters of one run; every operator takes them explicitly."""

    excluded_statuses: tuple[str, ...] = (CANCELLED, RETURNED)
    included_statuses: tuple[str, ...] = (DELIVERED, IN_PROGRESS)
    # "exclude": everything but the excluded statuses is revenue (unknown counts).
    # "include_only": only the included statuses are revenue (unknown does not count).
    status_policy: str = "exclude"
    top_vendors: int = 10
    top_products: int = 10
    date_formats: tuple[str, ...] = ("yyyy-MM-dd",)
    # "exact" or "approx" (one sketch pass, for exploratory runs).
    median: str = "exact"
    na_tokens: tuple[str, ...] = NA_TOKENS

    def __post_init__(self) -> None:
        if self.status_policy not in ("exclude", "include_only"):
            raise ValueError(f"unknown status policy: {self.status_policy!r}")
        if self.median not in ("exact", "approx"):
            raise ValueError(f"unknown median mode: {self.median!r}")
        for n in (self.top_vendors, self.top_products):
            if n < 1:
                raise ValueError("top-N sizes must be at least 1")


class SalesDataError(ValueError):
    """The input was found but cannot be used."""


class MissingColumnsError(SalesDataError):
    """At least one required column exists in no input file."""


class NoReadableFileError(SalesDataError):
    """Every input file was set aside; ``files`` (a DataFrame, if known) says why."""

    def __init__(self, message: str, files=None):
        super().__init__(message)
        self.files = files
