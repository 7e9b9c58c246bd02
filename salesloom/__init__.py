"""Sales analytics on Spark: ingest, clean, measure, report."""

from .settings import (
    MissingColumnsError, NoReadableFileError, SalesDataError, Settings,
)

__all__ = ["MissingColumnsError", "NoReadableFileError", "SalesDataError", "Settings"]
