"""Queries that store tables on the way, on a cluster whose checkpoint folder has no scheme."""

from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_oracle import canonical

QUERIES = [
    "csv_roundtrip",
    "clean",
    "heatmap_empty_cells",
    "exact_medians",
    "heatmap_long",
    "impute_median",
    "ingest",
    "medians_incremental",
    "kpis_from_raw",
    "monthly_from_raw",
    "normalize_discount",
    "provenance",
    "quarantine_files",
    "quality_report",
    "reports_incremental",
    "reconcile",
    "run_heatmap",
    "run_reports",
    "scan_csv_loose_quotes",
    "scan_csv",
    "scan_csv_quoted",
    "stream_dedupe",
]


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """Own tables of the star schema: 240 lines, some with a part that is not there."""
    folder = tmp_path_factory.mktemp("star")
    line_kinds = (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    )
    lines = [
        (i // 3, i % 23, i % 7, i % 3 + 1, float(i % 50 + 1), (i % 11) / 100, "RAN"[i % 3], "FO"[i % 2],
         datetime(1998, 5, 1) + timedelta(days=i))
        for i in range(240)
    ]
    tables = {
        "lineitem": (lines, line_kinds),
        "orders": ([(i, i % 13) for i in range(80)], "o_orderkey bigint, o_custkey bigint"),
        "customer": ([(i, i % 5) for i in range(13)], "c_custkey bigint, c_nationkey int"),
        "nation": ([(i, i % 3) for i in range(5)], "n_nationkey int, n_regionkey int"),
        "region": ([(i, f"region {i}") for i in range(3)], "r_regionkey int, r_name string"),
        "supplier": ([(i, f"Vendeur {i}") for i in range(7)], "s_suppkey bigint, s_name string"),
        "part": (
            [(i, f"produit {i}", f"type {i % 4}", 10.25 + i) for i in range(22)],
            "p_partkey bigint, p_name string, p_type string, p_retailprice double",
        ),
    }
    for name, (rows, kinds) in tables.items():
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_a_plain_checkpoint_folder_serves_a_cluster(spark, star, monkeypatch, name):
    # Only the choice of the staging folder asks for the master.
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    df = contract.queries()[name](spark, star)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in ("lineitem", "orders", "customer", "nation", "region", "supplier", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{star}/{table}.parquet/*.parquet'")
    expected = con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    rows = expected.fetchall()
    assert rows
    assert canonical(df.collect(), df.columns) == canonical(rows, columns)
