from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from salesloom.operators import analytics, cleaning, quality, reports
from salesloom.operators.measures import enrich
from salesloom.plans import run
from salesloom.settings import Settings
from helpers import line, plan, raw_frame, rows

# date, vendeur, region, produit, categorie, quantite, prix, remise, statut
FIVE = [
    ("2024-04-03", "Nadia", "Bretagne", "Tablette", "Mobile", "4", "250.0", "0.20", "Livré"),
    ("2024-04-18", "Omar", "Alsace", "Coque", "Accessoires", "12", "15.0", "0", "Livré"),
    ("2024-05-07", "Nadia", "Bretagne", "Station", "Mobile", "1", "300.0", "0.05", "Retourné"),
    ("2024-05-25", "Paule", "Alsace", "Tablette", "Mobile", "6", "250.0", "0.0", "En cours"),
    ("2024-06-11", "Omar", "Bretagne", "Chargeur", "Accessoires", "8", "40.0", "0.25", "Livré"),
]


@pytest.fixture(scope="module")
def lines(spark):
    return enrich(cleaning.clean(raw_frame(spark, FIVE)))


@pytest.fixture(scope="module")
def results(spark):
    return run.transform(cleaning.clean(raw_frame(spark, FIVE)))


def test_measures(lines):
    found = rows(lines.orderBy("date"), "ca_brut", "ca_net", "remise_euros", "ca_comptabilise")
    assert [tuple(map(float, r)) for r in found] == [
        (1000, 800, 200, 800), (180, 180, 0, 180), (300, 285, 15, 0), (1500, 1500, 0, 1500), (320, 240, 80, 240),
    ]


@pytest.mark.parametrize("price, net", [("0.125", "0.12"), ("0.375", "0.38"), ("1.005", "1.00"), ("1.015", "1.02")])
def test_rounding_is_half_even_per_line(spark, price, net):
    df = enrich(cleaning.clean(raw_frame(spark, [line(quantite="1", prix_unitaire=price, remise="0")])))
    assert rows(df, "ca_net") == [(Decimal(net),)]


def test_unknown_status_counts_by_default_and_not_in_the_strict_policy(spark):
    df = cleaning.clean(raw_frame(spark, [line(statut="???", remise="0")]))
    strict = Settings(status_policy="include_only")
    assert rows(enrich(df), "ca_comptabilise") == [(Decimal("1000.00"),)]
    assert rows(enrich(df, strict), "ca_comptabilise") == [(Decimal("0.00"),)]
    assert rows(reports.kpis(enrich(df, strict), strict), "nb_commandes", "nb_annulations") == [(0, 1)]


KPIS = (2720.0, 4, 680.0, 1, 20.0, 295.0, 3, 4)


def test_kpis(lines, results):
    assert rows(reports.kpis(lines)) == [KPIS]
    assert rows(results["kpis"]) == [KPIS]


def test_kpis_without_lines_are_zero(lines):
    empty = lines.filter("false")
    assert rows(reports.kpis(empty)) == [(0.0, 0, 0.0, 0, 0.0, 0.0, 0, 0)]
    groups = reports.report_groups(empty)
    assert rows(reports.reports_from_groups(groups)["kpis"]) == [(0.0, 0, 0.0, 0, 0.0, 0.0, 0, 0)]
    assert reports.by_month(empty).count() == 0


def test_vendors(lines, results):
    expected = [("Paule", 1500.0), ("Nadia", 800.0), ("Omar", 420.0)]
    assert rows(reports.top_vendors(lines)) == expected
    assert rows(reports.top_vendors(lines, None)) == expected
    assert rows(reports.top_vendors(lines, 1)) == expected[:1]
    assert rows(results["par_vendeur"]) == expected


def test_products(lines, results):
    expected = [("Tablette", 2300.0), ("Chargeur", 240.0), ("Coque", 180.0), ("Station", 0.0)]
    assert rows(reports.top_products(lines)) == expected
    assert rows(results["top_produits"]) == expected
    assert len(rows(reports.top_products(lines, 2))) == 2


def test_ties_are_broken_by_key(spark):
    df = enrich(cleaning.clean(raw_frame(spark, [line(vendeur=v) for v in "cab"])))
    assert [r[0] for r in rows(reports.top_vendors(df, 2))] == ["a", "b"]


def test_months(lines, results):
    expected = [(2024, 4, "Avril", 980.0), (2024, 5, "Mai", 1500.0), (2024, 6, "Juin", 240.0)]
    assert rows(reports.by_month(lines)) == expected
    assert rows(results["par_mois"]) == expected


def test_categories_and_regions(lines, results):
    assert rows(reports.by_category(lines)) == [("Mobile", 2300.0), ("Accessoires", 420.0)]
    assert rows(reports.by_region(lines)) == [("Alsace", 1680.0), ("Bretagne", 1040.0)]
    assert rows(results["par_categorie"]) == rows(reports.by_category(lines))
    assert rows(results["par_region"]) == rows(reports.by_region(lines))


def test_cross_tab(lines, results):
    wide = reports.heatmap_wide(lines, ["Alsace", "Bretagne"])
    assert wide.columns == ["vendeur", "Alsace", "Bretagne"]
    expected = [("Nadia", 0.0, 800.0), ("Omar", 180.0, 240.0), ("Paule", 1500.0, 0.0)]
    assert rows(wide) == expected
    assert rows(reports.heatmap_wide(lines, ["Corse"])) == [("Nadia", 0.0), ("Omar", 0.0), ("Paule", 0.0)]
    assert rows(reports.heatmap_wide(lines, [])) == [("Nadia",), ("Omar",), ("Paule",)]
    assert sorted(rows(results["heatmap"])) == [
        ("Nadia", "Bretagne", 800.0), ("Omar", "Alsace", 180.0), ("Omar", "Bretagne", 240.0), ("Paule", "Alsace", 1500.0),
    ]
    long = {(v, r): ca for v, r, ca in rows(reports.heatmap_long(lines))}
    assert long == {(v, c): row[i] for row in expected for v in [row[0]] for i, c in ((1, "Alsace"), (2, "Bretagne"))}


def test_cross_tab_with_regions_that_differ_in_case(spark):
    df = enrich(cleaning.clean(raw_frame(spark, [line(region="paca", remise="0"), line(region="PACA", quantite="1", remise="0")])))
    wide = reports.heatmap_wide(df, ["PACA", "paca"])
    assert wide.columns == ["vendeur", "PACA", "paca"]
    assert [tuple(r) for r in wide.collect()] == [("Nadia Petit", 250.0, 1000.0)]


def test_groups_without_key_do_not_exist(lines):
    holes = lines.withColumn("vendeur", F.when(F.col("vendeur") != "Omar", F.col("vendeur")))
    assert [r[0] for r in rows(reports.top_vendors(holes))] == ["Paule", "Nadia"]
    assert rows(reports.kpis(holes), "nb_vendeurs") == [(2,)]
    found = reports.reports_from_groups(reports.report_groups(holes))
    assert rows(found["kpis"], "nb_vendeurs") == [(2,)]
    assert [r[0] for r in rows(found["par_vendeur"])] == ["Paule", "Nadia"]


def test_reports_accept_a_rollup(lines):
    rolled = reports.rollup(lines)
    assert rows(reports.kpis(rolled)) == [KPIS]
    assert rows(reports.top_products(rolled)) == rows(reports.top_products(lines))
    assert rows(reports.by_month(rolled)) == rows(reports.by_month(lines))


# ------------------------------------------------------------ analytic columns


def test_monthly_table(lines):
    found = rows(analytics.monthly_table(lines).orderBy("annee", "mois"))
    assert found == [
        (2024, 4, "Avril", 980.0, None, "-", 980.0, "aucune"),
        (2024, 5, "Mai", 1500.0, 53.06, "+53.1%", 2480.0, "hausse"),
        (2024, 6, "Juin", 240.0, -84.0, "-84.0%", 2720.0, "baisse"),
    ]


def test_change_over_gaps_years_and_zero_months(spark):
    months = spark.createDataFrame(
        [(2023, 11, "Novembre", 100.0), (2024, 1, "Janvier", 0.0), (2024, 2, "Février", 50.0), (2024, 3, "Mars", 49.99)],
        "annee int, mois int, mois_nom string, ca_total double",
    )
    found = rows(analytics.monthly_columns(months).orderBy("annee", "mois"), "variation_texte", "cumul", "tendance")
    assert found == [
        ("-", 100.0, "aucune"), ("-100.0%", 100.0, "baisse"), ("-", 150.0, "aucune"), ("-0.0%", 199.99, "baisse"),
    ]


def test_shares(lines):
    assert rows(analytics.category_table(lines).orderBy(F.desc("ca_total")), "categorie", "part_texte") == [
        ("Mobile", "84.6%"), ("Accessoires", "15.4%")
    ]
    assert rows(analytics.region_table(lines).orderBy(F.desc("ca_total")), "region", "part_texte") == [
        ("Alsace", "61.8%"), ("Bretagne", "38.2%")
    ]


def test_share_of_nothing_is_zero(lines):
    nothing = lines.withColumn("ca_comptabilise", F.lit(0).cast("decimal(27,2)"))
    assert {r[0] for r in rows(analytics.region_table(nothing), "part_pct")} == {0.0}


def test_rank_and_best(lines):
    assert rows(analytics.vendor_table(lines).orderBy("rang"), "rang", "vendeur", "ca_texte") == [
        (1, "Paule", "1,500.00"), (2, "Nadia", "800.00"), (3, "Omar", "420.00")
    ]
    flags = dict(rows(analytics.with_best_flag(reports.top_products(lines), "produit"), "produit", "meilleur"))
    assert flags == {"Tablette": True, "Chargeur": False, "Coque": False, "Station": False}


def test_cards(lines):
    found = rows(analytics.kpi_cards(reports.kpis(lines)).orderBy("ordre"), "niveau", "libelle", "valeur")
    assert found == [
        ("principal", "CA Total", "2,720.00 EUR"), ("principal", "Commandes", "4"),
        ("principal", "Panier Moyen", "680.00 EUR"), ("principal", "Taux Annulation", "20.0 %"),
        ("secondaire", "Vendeurs actifs", "3"), ("secondaire", "Produits vendus", "4"),
        ("secondaire", "Remises accordees", "295.00 EUR"), ("secondaire", "Annulations", "1"),
    ]


# ------------------------------------------------------------ invariants and plans


def test_totals_agree(lines, results):
    assert {tuple(r) for r in rows(quality.reconcile(lines), "total", "ecart")} == {(2720.0, 0.0)}
    last = rows(analytics.monthly_table(lines).orderBy(F.desc("mois")), "cumul")[0][0]
    assert last == 2720.0


def test_top_n_needs_no_full_sort(lines):
    assert "TakeOrderedAndProject" in plan(reports.top_vendors(lines))


def test_all_groupings_take_one_shuffle(lines):
    text = plan(reports.report_groups(lines))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in text and "Python" not in text


def test_quality_report(spark):
    lines = [
        line() + ("a.csv",), line() + ("b.csv",), line(date=None) + ("a.csv",),
        line(vendeur=None, quantite=None) + ("a.csv",), line(date="x", quantite="abc") + ("a.csv",),
    ]
    raw = raw_frame(spark, lines, source=True)
    unique = cleaning.unique_lines(raw)
    found = cleaning.medians(cleaning.drop_null_date(unique))
    report = {
        (step, column): (n, value)
        for step, column, n, value in rows(
            quality.quality_report(quality.count_lines(raw), unique, found), "etape", "colonne", "nb", "valeur"
        )
    }
    assert report[("entree", None)] == (5, None)
    assert report[("doublons", None)] == (1, None)
    assert report[("date_absente", "date")] == (1, None)
    assert report[("texte_absent", "vendeur")] == (1, "Inconnu")
    assert report[("nombre_absent", "quantite")] == (1, "4.0")
    assert report[("nombre_illisible", "quantite")] == (1, "0.0")
    assert report[("date_illisible", "date")] == (1, None)
    assert report[("sortie", None)] == (2, None)


def test_settings_are_checked():
    for bad in ({"status_policy": "x"}, {"median": "x"}, {"top_vendors": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)
