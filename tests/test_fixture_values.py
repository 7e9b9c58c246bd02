"""Values written down in FIXTURES.md for the views at sf0.01."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from salesloom.operators import cleaning, reports
from salesloom.operators.measures import enrich
from salesloom.sources.star import raw_sales, sales_with_calendar
from salesloom.staging import materialise
from helpers import rows

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not available")


def test_canonical_lines(spark):
    lines = materialise(enrich(sales_with_calendar(spark, SF)), "lines")
    assert rows(reports.kpis(lines)) == [(687449869.27, 29951, 22952.48, 30049, 50.08, 72224414.20, 100, 64)]
    assert rows(reports.top_vendors(lines, 1)) == [("Supplier#000000012", 8182848.35)]
    assert rows(reports.by_month(lines).limit(1)) == [(1995, 1, "Janvier", 7455674.01)]
    assert reports.by_month(lines).count() == 83
    assert sorted(rows(lines.groupBy("statut").count())) == [
        ("Annulé", 10003), ("En cours", 10025), ("Livré", 19926), ("Retourné", 20046)
    ]


def test_dirty_lines(spark):
    raw = raw_sales(spark, SF)
    assert raw.count() == 60540
    assert raw.select("source_fichier").distinct().count() == 84
    found = materialise(enrich(cleaning.clean(raw)), "lines")
    assert found.filter(F.col("source_fichier") == "ventes_zz_doublons.csv").isEmpty()
    table = found.groupBy("statut").agg(
        F.count(F.lit(1)), F.sum("quantite"), F.round(F.sum("prix_unitaire"), 2),
        F.round(F.sum("remise"), 2).cast("double"), F.sum("ca_net").cast("double"), F.count_if(F.col("remise") == 1),
    )
    assert sorted(rows(table)) == [
        ("Annulé", 9503, 234113, 8920071.10, 650.05, 204912132.55, 172),
        ("En cours", 9480, 231946, 8865209.50, 644.75, 202052477.11, 174),
        ("Inconnu", 757, 18347, 708870.10, 47.56, 16136815.94, 10),
        ("Livré", 18939, 469057, 17737154.30, 1325.67, 409088024.73, 378),
        ("Retourné", 19056, 468048, 17857209.10, 1332.17, 408404498.84, 377),
    ]
