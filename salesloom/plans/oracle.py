"""SQL twins of the registered queries, for an independent engine.

Each text is a WITH chain over the star-schema tables plus one SELECT. The
chain is written once per view and each query takes the views it needs.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# Fixed values, spelled out again so that a mistake in the settings shows.
MONTH_NAMES = (
    "Janvier", "Février", "Mars", "Avril", "Mai", "Juin", "Juillet", "Août", "Septembre",
    "Octobre", "Novembre", "Décembre",
)
MONTH_NAMES_PLAIN = (
    "Janvier", "Fevrier", "Mars", "Avril", "Mai", "Juin", "Juillet", "Aout", "Septembre",
    "Octobre", "Novembre", "Decembre",
)


def _month(names, column):
    arms = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names, start=1))
    return f"CASE {column} {arms} END"


_CALENDAR = f"""
  CAST(year(date) AS INTEGER) AS annee, CAST(month(date) AS INTEGER) AS mois,
  {_month(MONTH_NAMES, 'month(date)')} AS mois_nom,
  CAST(week(date) AS INTEGER) AS semaine, CAST(quarter(date) AS INTEGER) AS trimestre"""

_STATUS = """CASE WHEN l_returnflag = 'R' THEN 'Retourné'
       WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'Annulé'
       WHEN l_returnflag = 'A' THEN 'En cours' ELSE 'Livré' END"""

_JOINS = """lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey"""


def _decode(spelling):
    return f"""CASE WHEN {spelling} IN ('livre', 'livré') THEN 'Livré'
       WHEN {spelling} IN ('en cours', 'encours') THEN 'En cours'
       WHEN {spelling} IN ('annule', 'annulé') THEN 'Annulé'
       WHEN {spelling} IN ('retourne', 'retourné') THEN 'Retourné' ELSE 'Inconnu' END"""


# View name -> (views it reads, body).
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "sales": ((), f"""
SELECT CAST(l_shipdate AS DATE) AS date, s_name AS vendeur, r_name AS region, p_name AS produit,
  p_type AS categorie, CAST(l_quantity AS BIGINT) AS quantite,
  CAST(p_retailprice AS DECIMAL(14,4)) AS prix_unitaire,
  CAST(l_discount AS DECIMAL(9,8)) AS remise, {_STATUS} AS statut
FROM {_JOINS}"""),
    "gross": (("sales",), """
SELECT *, CAST(quantite AS DECIMAL(10,0)) * prix_unitaire AS ca_brut FROM sales"""),
    "net": (("gross",), """
SELECT *, CAST(round_even(ca_brut * (CAST(1 AS DECIMAL(1,0)) - remise), 2) AS DECIMAL(27,2)) AS ca_net
FROM gross"""),
    "enriched": (("net",), f"""
SELECT *, CAST(round_even(ca_brut - ca_net, 2) AS DECIMAL(27,2)) AS remise_euros,
  CASE WHEN statut IN ('Annulé', 'Retourné') THEN CAST(0 AS DECIMAL(27,2)) ELSE ca_net END AS ca_comptabilise,
  {_CALENDAR}
FROM net"""),
    "raw_keys": ((), f"""
SELECT l_orderkey*7 + l_partkey*13 + l_suppkey*3 + l_linenumber AS k, CAST(l_shipdate AS DATE) AS day,
  s_name, r_name, p_name, p_type, CAST(l_quantity AS BIGINT) AS qty,
  CAST(p_retailprice AS DECIMAL(14,2)) AS price, CAST(l_discount AS DECIMAL(4,2)) AS discount,
  {_STATUS} AS status
FROM {_JOINS}"""),
    "raw_copies": (("raw_keys",), """
SELECT *, 0 AS copy FROM raw_keys UNION ALL SELECT *, 1 AS copy FROM raw_keys WHERE k % 97 = 0"""),
    "raw": (("raw_copies",), """
SELECT CASE WHEN k%53=0 THEN NULL WHEN k%59=0 THEN 'date-invalide' ELSE strftime(day, '%Y-%m-%d') END AS date,
  CASE WHEN k%41=0 THEN NULL WHEN k%7=0 THEN '  ' || s_name || ' ' ELSE s_name END AS vendeur,
  CASE WHEN k%43=0 THEN NULL ELSE r_name END AS region, p_name AS produit, p_type AS categorie,
  CASE WHEN k%37=0 THEN NULL WHEN k%61=0 THEN CAST(-qty AS VARCHAR) WHEN k%67=0 THEN 'abc'
       ELSE CAST(qty AS VARCHAR) END AS quantite,
  CASE WHEN k%47=0 THEN NULL WHEN k%71=0 THEN CAST(-price AS VARCHAR) ELSE CAST(price AS VARCHAR) END
    || CASE WHEN copy = 1 THEN '0' ELSE '' END AS prix_unitaire,
  CASE WHEN k%31=0 THEN NULL WHEN k%5=0 THEN CAST(CAST(discount*100 AS DECIMAL(6,2)) AS VARCHAR)
       ELSE CAST(discount AS VARCHAR) END AS remise,
  CASE WHEN k%73=0 THEN '???' WHEN status='Retourné' AND k%2=0 THEN 'RETOURNE'
       WHEN status='Annulé' AND k%2=0 THEN 'annule' WHEN status='En cours' AND k%2=0 THEN 'encours'
       WHEN status='Livré' AND k%3=0 THEN 'LIVRÉ' WHEN status='Livré' AND k%3=1 THEN ' livre '
       ELSE status END AS statut,
  CASE WHEN copy = 1 THEN 'ventes_zz_doublons.csv'
       ELSE 'ventes_' || strftime(day, '%Y_%m') || '.csv' END AS source_fichier
FROM raw_copies"""),
    "parsed_values": (("raw",), """
SELECT *, CAST(TRY_CAST(quantite AS DECIMAL(38,10)) AS DOUBLE) AS q,
  CAST(TRY_CAST(prix_unitaire AS DECIMAL(38,10)) AS DOUBLE) AS p,
  CAST(TRY_CAST(remise AS DECIMAL(38,10)) AS DOUBLE) AS r
FROM raw"""),
    "parsed": (("parsed_values",), """
SELECT date, vendeur, region, produit, categorie, q AS quantite, p AS prix_unitaire, r AS remise, statut,
  source_fichier, CASE WHEN q IS NULL THEN quantite END AS quantite_illisible,
  CASE WHEN p IS NULL THEN prix_unitaire END AS prix_unitaire_illisible,
  CASE WHEN r IS NULL THEN remise END AS remise_illisible
FROM parsed_values"""),
    "uniq": (("parsed",), """
SELECT date, vendeur, region, produit, categorie, quantite, prix_unitaire, remise, statut,
  quantite_illisible, prix_unitaire_illisible, remise_illisible, min(source_fichier) AS source_fichier
FROM parsed GROUP BY ALL"""),
    "dated": (("uniq",), "SELECT * FROM uniq WHERE date IS NOT NULL"),
    "filled": (("dated",), """
SELECT * REPLACE (coalesce(vendeur, 'Inconnu') AS vendeur, coalesce(region, 'Inconnu') AS region,
  coalesce(produit, 'Inconnu') AS produit, coalesce(categorie, 'Inconnu') AS categorie,
  coalesce(statut, 'Inconnu') AS statut)
FROM dated"""),
    "med": (("dated",), """
SELECT median(quantite) AS mq, median(prix_unitaire) AS mp, median(remise) AS mr FROM dated"""),
    "imputed": (("filled", "med"), """
SELECT filled.* REPLACE (
  coalesce(quantite, CASE WHEN quantite_illisible IS NULL THEN mq END, 0) AS quantite,
  coalesce(prix_unitaire, CASE WHEN prix_unitaire_illisible IS NULL THEN mp END, 0) AS prix_unitaire,
  coalesce(remise, CASE WHEN remise_illisible IS NULL THEN mr END, 0) AS remise)
FROM filled, med"""),
    "typed": (("imputed",), """
SELECT TRY_CAST(date AS DATE) AS date, trim(vendeur) AS vendeur, trim(region) AS region,
  trim(produit) AS produit, trim(categorie) AS categorie, CAST(trunc(quantite) AS BIGINT) AS quantite,
  prix_unitaire, remise, trim(statut) AS statut, source_fichier
FROM imputed WHERE TRY_CAST(date AS DATE) IS NOT NULL"""),
    "discounted": (("typed",), """
SELECT * REPLACE (greatest(least(CASE WHEN remise > 1 THEN remise / 100 ELSE remise END, 1), 0) AS remise)
FROM typed"""),
    "clamped": (("discounted",), """
SELECT * REPLACE (greatest(quantite, 0) AS quantite,
  greatest(prix_unitaire, 0) AS prix_unitaire)
FROM discounted"""),
    "clean": (("clamped",), f"""
SELECT * REPLACE ({_decode('lower(trim(statut))')} AS statut), {_CALENDAR} FROM clamped"""),
    "clean_net": (("clean",), """
SELECT *, CAST(quantite AS DECIMAL(9,0)) * CAST(prix_unitaire AS DECIMAL(14,4)) AS ca_brut,
  CAST(round_even(CAST(quantite AS DECIMAL(9,0)) * CAST(prix_unitaire AS DECIMAL(14,4))
    * (1 - CAST(remise AS DECIMAL(9,6))), 2) AS DECIMAL(27,2)) AS ca_net
FROM clean"""),
    "clean_enriched": (("clean_net",), """
SELECT *, CAST(round_even(ca_brut - ca_net, 2) AS DECIMAL(27,2)) AS remise_euros,
  CASE WHEN statut IN ('Annulé', 'Retourné') THEN CAST(0 AS DECIMAL(27,2)) ELSE ca_net END AS ca_comptabilise
FROM clean_net"""),
}


def _months(lines):
    return f"""
SELECT annee, mois, mois_nom, CAST(sum(ca_comptabilise) AS DOUBLE) AS ca_total
FROM {lines} GROUP BY ALL"""


_VIEWS["months"] = (("enriched",), _months("enriched"))
_VIEWS["clean_months"] = (("clean_enriched",), _months("clean_enriched"))
for _key in ("vendeur", "produit", "categorie", "region"):
    _VIEWS[f"by_{_key}"] = (("enriched",), f"""
SELECT {_key}, CAST(sum(ca_comptabilise) AS DOUBLE) AS ca_total FROM enriched
WHERE {_key} IS NOT NULL GROUP BY {_key}""")


def _with(select: str, *views: str) -> str:
    ordered: list[str] = []

    def visit(name):
        for parent in _VIEWS[name][0]:
            visit(parent)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        visit(view)
    chain = ",\n".join(f"{name} AS ({_VIEWS[name][1]})" for name in ordered)
    return f"WITH {chain}\n{select}"


def _register(name: str, select: str, *views: str) -> None:
    ORACLE[name] = _with(select, *views)


def _d(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)


_AMOUNTS = _d("prix_unitaire", "remise")

# ---------------------------------------------------------------- measures

_register("measures", f"""
SELECT date, vendeur, region, produit, categorie, quantite, {_AMOUNTS}, statut,
  {_d('ca_brut', 'ca_net', 'remise_euros', 'ca_comptabilise')} FROM enriched""", "enriched")
_register("measures_strict", """
SELECT statut2 AS statut,
  CAST(sum(CASE WHEN statut2 IN ('Annulé', 'Retourné') THEN 0 ELSE ca_net END) AS DOUBLE) AS ca_large,
  CAST(sum(CASE WHEN statut2 IN ('Livré', 'En cours') THEN ca_net ELSE 0 END) AS DOUBLE) AS ca_strict
FROM (SELECT *, CASE WHEN quantite % 2 = 1 THEN 'Inconnu' ELSE statut END AS statut2 FROM net) GROUP BY 1""", "net")

# ---------------------------------------------------------------- reports


def _kpis(lines):
    return f"""
SELECT CAST(ca AS DOUBLE) AS ca_total, active AS nb_commandes,
  CASE WHEN active > 0 THEN round_even(CAST(ca AS DOUBLE) / CAST(active AS DOUBLE), 2) ELSE 0 END AS panier_moyen,
  n_out AS nb_annulations,
  CASE WHEN n > 0 THEN round_even(CAST(n_out AS DOUBLE) / CAST(n AS DOUBLE) * 100, 2) ELSE 0 END AS taux_annulation,
  CAST(disc AS DOUBLE) AS remise_totale, nb_vendeurs, nb_produits
FROM (SELECT coalesce(sum(ca_comptabilise), 0) AS ca, count(*) AS n,
  count(*) FILTER (WHERE statut NOT IN ('Annulé', 'Retourné')) AS active,
  count(*) FILTER (WHERE statut IN ('Annulé', 'Retourné')) AS n_out,
  coalesce(sum(remise_euros), 0) AS disc,
  count(DISTINCT vendeur) AS nb_vendeurs, count(DISTINCT produit) AS nb_produits FROM {lines})"""


_register("kpis", _kpis("enriched"), "enriched")
_register("kpis_from_raw", _kpis("clean_enriched"), "clean_enriched")
_register("top_vendors", "SELECT * FROM by_vendeur ORDER BY ca_total DESC, vendeur LIMIT 10", "by_vendeur")
_register("top_products", "SELECT * FROM by_produit ORDER BY ca_total DESC, produit LIMIT 10", "by_produit")
_register("by_month", "SELECT * FROM months ORDER BY annee, mois", "months")
_register("by_category", "SELECT * FROM by_categorie ORDER BY ca_total DESC, categorie", "by_categorie")
_register("by_region", "SELECT * FROM by_region ORDER BY ca_total DESC, region", "by_region")


def _heat(person):
    return f"""
SELECT v.vendeur, r.region, CAST(coalesce(sum(c.ca_comptabilise), 0) AS DOUBLE) AS ca_total
FROM (SELECT DISTINCT {person} AS vendeur FROM enriched WHERE vendeur IS NOT NULL AND region IS NOT NULL) v
CROSS JOIN (SELECT DISTINCT region FROM enriched WHERE vendeur IS NOT NULL AND region IS NOT NULL) r
LEFT JOIN (SELECT {person} AS vendeur, region, ca_comptabilise FROM enriched) c
  ON c.vendeur = v.vendeur AND c.region = r.region
GROUP BY 1, 2"""


_register("heatmap_long", _heat("vendeur"), "enriched")
_register("heatmap_empty_cells", _heat("vendeur || ' ' || strftime(date, '%Y-%m')"), "enriched")
_register("heatmap_wide", "SELECT vendeur, " + ", ".join(
    f"CAST(coalesce(sum(ca_comptabilise) FILTER (WHERE region = '{r}'), 0) AS DOUBLE) AS \"{r}\""
    for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
) + " FROM enriched WHERE vendeur IS NOT NULL AND region IS NOT NULL GROUP BY vendeur", "enriched")
_register("rollup", """
SELECT annee, mois, mois_nom, vendeur, region, categorie, produit, statut, count(*) AS nb_lignes,
  CAST(sum(ca_net) AS DOUBLE) AS ca_net, CAST(sum(remise_euros) AS DOUBLE) AS remise_euros,
  CAST(sum(ca_comptabilise) AS DOUBLE) AS ca_comptabilise
FROM enriched GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""", "enriched")


def _groups(lines):
    return f"""
SELECT annee, mois, mois_nom, vendeur, region, categorie, produit,
  concat_ws('+', CASE WHEN grouping(annee) = 0 THEN 'annee' END, CASE WHEN grouping(mois) = 0 THEN 'mois' END,
    CASE WHEN grouping(mois_nom) = 0 THEN 'mois_nom' END, CASE WHEN grouping(vendeur) = 0 THEN 'vendeur' END,
    CASE WHEN grouping(region) = 0 THEN 'region' END, CASE WHEN grouping(categorie) = 0 THEN 'categorie' END,
    CASE WHEN grouping(produit) = 0 THEN 'produit' END) AS grain,
  CAST(sum(ca_comptabilise) AS DOUBLE) AS ca_comptabilise, CAST(sum(remise_euros) AS DOUBLE) AS remise_euros,
  count(*) FILTER (WHERE statut NOT IN ('Annulé', 'Retourné')) AS active,
  count(*) FILTER (WHERE statut IN ('Annulé', 'Retourné')) AS "out"
FROM {lines}
GROUP BY GROUPING SETS ((annee, mois, mois_nom), (vendeur, region), (categorie, produit))"""


_register("report_groups", _groups("enriched"), "enriched")
_register("reports_incremental", _groups("clean_enriched"), "clean_enriched")

# ---------------------------------------------------------------- analytic columns

_MONEY_TEXT = "format('{:,.2f}', ca_total) AS ca_texte"
for _name, _key in (("vendor_rank", "vendeur"), ("product_rank", "produit")):
    _register(_name, f"""
SELECT row_number() OVER (ORDER BY ca_total DESC, {_key}) AS rang, {_key}, ca_total, {_MONEY_TEXT}
FROM by_{_key} ORDER BY rang LIMIT 10""", f"by_{_key}")

_CHANGE = """CASE WHEN lag(ca_total) OVER (ORDER BY annee, mois) > 0
  THEN (ca_total - lag(ca_total) OVER (ORDER BY annee, mois)) / lag(ca_total) OVER (ORDER BY annee, mois) * 100 END"""
_RUNNING = "CAST(sum(CAST(ca_total AS DECIMAL(27,2))) OVER (ORDER BY annee, mois ROWS UNBOUNDED PRECEDING) AS DOUBLE)"
_TREND = "CASE WHEN chg IS NULL THEN 'aucune' WHEN chg >= 0 THEN 'hausse' ELSE 'baisse' END"
_SIGNED = """CASE WHEN {x} IS NULL THEN '-' WHEN {x} < 0 AND round_even({x}, 1) = 0 THEN '-0.0%'
  ELSE CASE WHEN {x} >= 0 THEN '+' ELSE '' END || format('{{:.1f}}%', round_even({x}, 1)) END"""


def _monthly(months):
    return f"""
SELECT annee, mois, mois_nom, ca_total, round_even(chg, 2) AS variation_pct,
  {_SIGNED.format(x='chg')} AS variation_texte, cumul, {_TREND} AS tendance
FROM (SELECT *, {_CHANGE} AS chg, {_RUNNING} AS cumul FROM {months})"""


_register("month_over_month", f"""
SELECT annee, mois, mois_nom, ca_total, round_even(chg, 2) AS variation_pct
FROM (SELECT *, {_CHANGE} AS chg FROM months)""", "months")
_register("running_total", f"SELECT *, {_RUNNING} AS cumul FROM months", "months")
_register("month_trend", f"""
SELECT annee, mois, {_TREND} AS tendance FROM (SELECT *, {_CHANGE} AS chg FROM months)""", "months")
_register("monthly_table", _monthly("months"), "months")
_register("monthly_from_raw", _monthly("clean_months"), "clean_months")
for _name, _key in (("category_share", "categorie"), ("region_share", "region")):
    _register(_name, f"""
SELECT {_key}, ca_total, round_even(part, 2) AS part_pct, format('{{:.1f}}%', round_even(part, 1)) AS part_texte
FROM (SELECT *, CASE WHEN t = 0 THEN 0 ELSE ca_total / t * 100 END AS part
  FROM by_{_key}, (SELECT CAST(sum(CAST(ca_total AS DECIMAL(27,2))) AS DOUBLE) AS t FROM by_{_key}))""", f"by_{_key}")
_register("best_flag", """
SELECT vendeur, ca_total, row_number() OVER (ORDER BY ca_total DESC, vendeur) = 1 AS meilleur
FROM by_vendeur ORDER BY ca_total DESC, vendeur LIMIT 10""", "by_vendeur")
_register("kpi_cards", f"""
SELECT t.ordre, t.niveau, t.libelle, t.valeur FROM (
  SELECT unnest([
    {{'ordre': CAST(1 AS BIGINT), 'niveau': 'principal', 'libelle': 'CA Total', 'valeur': format('{{:,.2f}}', ca_total) || ' EUR'}},
    {{'ordre': 2, 'niveau': 'principal', 'libelle': 'Commandes', 'valeur': CAST(nb_commandes AS VARCHAR)}},
    {{'ordre': 3, 'niveau': 'principal', 'libelle': 'Panier Moyen', 'valeur': format('{{:,.2f}}', panier_moyen) || ' EUR'}},
    {{'ordre': 4, 'niveau': 'principal', 'libelle': 'Taux Annulation', 'valeur': CAST(taux_annulation AS VARCHAR) || ' %'}},
    {{'ordre': 5, 'niveau': 'secondaire', 'libelle': 'Vendeurs actifs', 'valeur': CAST(nb_vendeurs AS VARCHAR)}},
    {{'ordre': 6, 'niveau': 'secondaire', 'libelle': 'Produits vendus', 'valeur': CAST(nb_produits AS VARCHAR)}},
    {{'ordre': 7, 'niveau': 'secondaire', 'libelle': 'Remises accordees', 'valeur': format('{{:,.2f}}', remise_totale) || ' EUR'}},
    {{'ordre': 8, 'niveau': 'secondaire', 'libelle': 'Annulations', 'valeur': CAST(nb_annulations AS VARCHAR)}}
  ]) AS t FROM ({_kpis('enriched')}))""", "enriched")

# ---------------------------------------------------------------- labels

_EURO = """CASE WHEN {x} >= 1000000 THEN format('{{:.1f}}M€', round_even({x} / 1000000, 1))
  WHEN {x} >= 1000 THEN format('{{:.0f}}k€', round_even({x} / 1000, 0))
  ELSE format('{{:.0f}}€', round_even({x}, 0)) END"""
_register("euro_label", f"""
SELECT x AS ca_net, {_EURO.format(x='x')} AS texte, {_EURO.format(x='(x * 100)')} AS texte_centuple
FROM (SELECT CAST(ca_net AS DOUBLE) AS x FROM net)""", "net")
_register("money_label", """
SELECT CAST(ca_net AS DOUBLE) AS ca_net, format('{:,.2f}', CAST(ca_net AS DOUBLE)) AS texte FROM net""", "net")
_register("pct_label", f"""
SELECT x AS pct, format('{{:.1f}}%', round_even(x, 1)) AS texte, {_SIGNED.format(x='(x - 5)')} AS texte_signe
FROM (SELECT CAST(remise AS DOUBLE) * 100 AS x FROM sales)""", "sales")
_register("period_label", f"""
SELECT date, {_month(MONTH_NAMES, 'month(date)')} || ' ' || CAST(year(date) AS VARCHAR) AS libelle,
  {_month(MONTH_NAMES_PLAIN, "month(date - INTERVAL 1 MONTH)")} || ' '
    || CAST(year(date - INTERVAL 1 MONTH) AS VARCHAR) AS libelle_mois_precedent
FROM (SELECT DISTINCT date FROM sales)""", "sales")
_register("calendar_cols", f"SELECT date, vendeur, {_CALENDAR} FROM sales", "sales")

# ---------------------------------------------------------------- cleaning chain

_UNREADABLE = "quantite_illisible, prix_unitaire_illisible, remise_illisible"
_register("na_tokens", "SELECT * FROM raw", "raw")
_register("parse_numbers", "SELECT * FROM parsed", "parsed")
_register("dedupe", "SELECT * FROM uniq", "uniq")
_register("stream_dedupe", "SELECT * FROM uniq", "uniq")
_register("drop_null_date", "SELECT * FROM dated", "dated")
_register("fill_text", "SELECT * FROM filled", "filled")
_register("exact_medians", """
SELECT count(quantite) AS nb_quantite, count(prix_unitaire) AS nb_prix_unitaire, count(remise) AS nb_remise,
  median(quantite) AS mediane_quantite, median(prix_unitaire) AS mediane_prix_unitaire,
  median(remise) AS mediane_remise FROM dated""", "dated")
ORACLE["medians_incremental"] = ORACLE["exact_medians"]
_register("impute_median", "SELECT * FROM imputed", "imputed")
_LINE = f"date, vendeur, region, produit, categorie, quantite, {_AMOUNTS}, statut, source_fichier"
_register("typed", f"SELECT {_LINE} FROM typed", "typed")
_register("trim_text", """
SELECT trim(vendeur) AS vendeur, trim(region) AS region, trim(produit) AS produit,
  trim(categorie) AS categorie, trim(statut) AS statut, source_fichier FROM raw""", "raw")
_register("normalize_discount", f"SELECT {_LINE} FROM discounted", "discounted")
_register("clamp_negative", f"SELECT {_LINE} FROM clamped", "clamped")
_register("canonical_status", f"""
SELECT {_decode("lower(trim(coalesce(statut, 'Inconnu')))")} AS statut, source_fichier, count(*) AS nb_lignes
FROM raw GROUP BY 1, 2""", "raw")
_register("clean", f"SELECT {_LINE}, annee, mois, mois_nom, semaine, trimestre FROM clean", "clean")

# ---------------------------------------------------------------- quality

_register("file_counts", "SELECT source_fichier, count(*) AS nb_lignes FROM raw GROUP BY 1", "raw")
_register("n_source_files", """
SELECT count(DISTINCT source_fichier) AS nb_fichiers, count(*) AS nb_lignes FROM raw""", "raw")
_register("status_counts", "SELECT statut, count(*) AS nb_lignes FROM raw GROUP BY 1", "raw")
_register("distinct_discounts", "SELECT DISTINCT CAST(remise AS DOUBLE) AS remise FROM sales", "sales")
_register("top5_vendors", """
SELECT vendeur AS "Vendeur", format('{:,.2f}', ca_total) || ' €' AS "CA Total"
FROM by_vendeur ORDER BY ca_total DESC, vendeur LIMIT 5""", "by_vendeur")
_register("reconcile", "SELECT axe, somme, total, somme - total AS ecart FROM (" + " UNION ALL ".join(
    f"SELECT '{axe}' AS axe, (SELECT CAST(sum(CAST(ca_total AS DECIMAL(27,2))) AS DOUBLE) FROM {view}) AS somme, "
    "(SELECT CAST(sum(ca_comptabilise) AS DOUBLE) FROM enriched) AS total"
    for axe, view in (("vendeur", "by_vendeur"), ("region", "by_region"), ("categorie", "by_categorie"),
                      ("produit", "by_produit"), ("mois", "months"))
) + ")", "by_vendeur", "by_region", "by_categorie", "by_produit", "months")

_QUALITY = [
    ("entree", "NULL", "(SELECT count(*) FROM raw)", "NULL"),
    ("doublons", "NULL", "(SELECT count(*) FROM raw) - (SELECT count(*) FROM uniq)", "NULL"),
    ("date_absente", "'date'", "(SELECT count(*) FROM uniq WHERE date IS NULL)", "NULL"),
    *[("texte_absent", f"'{c}'", f"(SELECT count(*) FROM dated WHERE {c} IS NULL)", "'Inconnu'")
      for c in ("vendeur", "region", "produit", "categorie", "statut")],
    *[("nombre_absent", f"'{c}'",
       f"(SELECT count(*) FROM dated WHERE {c} IS NULL AND {c}_illisible IS NULL)",
       f"(SELECT CAST({m} AS VARCHAR) FROM med)")
      for c, m in (("quantite", "mq"), ("prix_unitaire", "mp"), ("remise", "mr"))],
    *[("nombre_illisible", f"'{c}'", f"(SELECT count(*) FROM dated WHERE {c}_illisible IS NOT NULL)", "'0.0'")
      for c in ("quantite", "prix_unitaire", "remise")],
    ("nombre_hors_limites", "'quantite'", "(SELECT count(*) FROM dated WHERE abs(quantite) >= 9e18)", "'0.0'"),
    ("nombre_hors_limites", "'prix_unitaire'", "(SELECT count(*) FROM dated WHERE quantite * prix_unitaire >= 1e26)", "'0.0'"),
    ("date_illisible", "'date'", "(SELECT count(*) FROM dated WHERE TRY_CAST(date AS DATE) IS NULL)", "NULL"),
    ("sortie", "NULL", "(SELECT count(*) FROM dated WHERE TRY_CAST(date AS DATE) IS NOT NULL)", "NULL"),
]
ORACLE["extreme_values"] = """
SELECT l_orderkey, l_linenumber, quantite, prix_unitaire, remise, greatest(net, 0) AS ca_net
FROM (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 1000000000000 AS quantite,
    p_retailprice * 1000000.0 AS prix_unitaire, 0.0::DOUBLE AS remise,
    CAST(l_quantity AS DOUBLE) * 1000000000000 * (p_retailprice * 1000000.0) AS net
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1
  UNION ALL
  SELECT l_orderkey, l_linenumber, 9000000, 1.0, (33333333 + l_orderkey % 7) / 100000000.0::DOUBLE,
    9000000.0 - 0.09 * (33333333 + l_orderkey % 7)
  FROM lineitem WHERE l_linenumber = 2
  UNION ALL
  SELECT l_orderkey, l_linenumber, 1000000, (4 + l_orderkey % 5) / 100000.0::DOUBLE, 0.0, 10.0 * (4 + l_orderkey % 5)
  FROM lineitem WHERE l_linenumber > 2
)"""
ORACLE["typed_datetimes"] = """
SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS nb FROM lineitem GROUP BY 1"""
_register("quality_report", " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS ordre, '{step}' AS etape, CAST({column} AS VARCHAR) AS colonne, "
    f"{n} AS nb, CAST({value} AS VARCHAR) AS valeur"
    for i, (step, column, n, value) in enumerate(_QUALITY, start=1)
), "raw", "uniq", "dated", "med")

# ---------------------------------------------------------------- one-pass bundle

_register("transform_bundle", """
SELECT * FROM (SELECT 'par_vendeur' AS rapport, vendeur AS cle, ca_total FROM by_vendeur
  ORDER BY ca_total DESC, vendeur LIMIT 10)
UNION ALL SELECT 'par_mois', CAST(annee AS VARCHAR) || '-' || CAST(mois AS VARCHAR), ca_total FROM months
UNION ALL SELECT 'par_categorie', categorie, ca_total FROM by_categorie
UNION ALL SELECT 'par_region', region, ca_total FROM by_region
UNION ALL SELECT * FROM (SELECT 'top_produits', produit, ca_total FROM by_produit
  ORDER BY ca_total DESC, produit LIMIT 10)""", "by_vendeur", "months", "by_categorie", "by_region", "by_produit")
ORACLE["transform_kpis"] = ORACLE["kpis"]
_register("transform_heatmap", """
SELECT vendeur, region, CAST(sum(ca_comptabilise) AS DOUBLE) AS ca_total FROM enriched
WHERE vendeur IS NOT NULL AND region IS NOT NULL GROUP BY vendeur, region""", "enriched")
_register("run_heatmap", """
SELECT vendeur, region, CAST(sum(ca_comptabilise) AS DOUBLE) AS ca_total
FROM clean_enriched GROUP BY vendeur, region""", "clean_enriched")

# ---------------------------------------------------------------- files in and out

_FEED = "date, vendeur, region, produit, categorie, quantite, prix_unitaire, remise, statut"
_FIRST = "source_fichier < 'ventes_1998_07.csv'"
for _name in ("scan_csv", "scan_csv_reordered", "validate_columns", "ingest", "stream_ingest"):
    _register(_name, f"SELECT {_FEED} FROM raw", "raw")
_register("scan_reserved_names", f"SELECT {_FEED}, NOT ({_FIRST}) AS reserve FROM raw", "raw")
_register("scan_csv_quoted", f"""
SELECT * REPLACE (produit || ' 27"' || chr(10) || ', ' || categorie AS produit) FROM (SELECT {_FEED} FROM raw)""", "raw")
_register("scan_csv_loose_quotes", f"""
SELECT * REPLACE (produit || ', ' || categorie || ' de "base" 2' AS produit) FROM (SELECT {_FEED} FROM raw)""", "raw")
_register("union_files", f"""
SELECT {_FEED}, CAST(NULL AS VARCHAR) AS commentaire FROM raw WHERE {_FIRST}
UNION ALL SELECT * REPLACE (CAST(NULL AS VARCHAR) AS remise), upper(produit) FROM (
  SELECT {_FEED} FROM raw WHERE NOT {_FIRST})""", "raw")
_register("stream_subfolders", f"SELECT {_FEED} FROM raw WHERE {_FIRST}", "raw")
_register("provenance", """
SELECT count(*) AS nb_lignes, CAST(0 AS BIGINT) AS nb_ecarts, CAST(0 AS BIGINT) AS nb_noms_faux FROM raw""", "raw")
_register("quarantine_files", f"""
SELECT 'lues' AS etat, count(*) AS nb FROM raw WHERE {_FIRST}
UNION ALL SELECT 'fautives', count(*) FROM raw WHERE NOT {_FIRST}""", "raw")
_register("csv_roundtrip", f"""
SELECT date, vendeur, region, produit, categorie, quantite, {_AMOUNTS}, statut, annee, mois FROM enriched""", "enriched")
ORACLE["write_reports"] = ORACLE["kpi_cards"]
ORACLE["run_reports"] = ORACLE["monthly_from_raw"]
