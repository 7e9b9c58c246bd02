import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from salesloom.operators import reports
from salesloom.operators.measures import enrich
from salesloom.plans import catalog, oracle
from salesloom.settings import BUSINESS_COLUMNS
from salesloom.sources.star import sales, sales_with_calendar, table
from helpers import plan
from tools.check_oracle import canonical


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql_twin(spark, sql, sf_dir, name):
    df = contract.queries()[name](spark, sf_dir)
    result = sql.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.collect(), df.columns) == canonical(result.fetchall(), columns)
    text = plan(df)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas", "MapInArrow"):
        assert node not in text


def test_entry(spark, sf_dir):
    assert contract.entry(spark).count() > 0


def test_names(sf_dir):
    assert set(oracle.ORACLE) == set(catalog.QUERIES)
    assert not [n for n in catalog.QUERIES if n == "pipeline" or re.match(r"op\d", n)]
    assert set(catalog.QUERIES) <= set(contract.queries())


def test_orphan_keys_leave_every_report_with_all_lines(spark, sf_dir, tmp_path):
    """Queries that read different dimensions see the same lines."""
    for name in ("lineitem", "orders", "part", "customer", "nation", "region"):
        table(spark, sf_dir, name).write.parquet(f"{tmp_path}/{name}.parquet")
    table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").write.parquet(f"{tmp_path}/supplier.parquet")
    d = str(tmp_path)
    lines = enrich(sales_with_calendar(spark, d))
    assert sales(spark, d, BUSINESS_COLUMNS).count() == table(spark, d, "lineitem").count()
    total = reports.kpis(lines).first()["ca_total"]
    for name in ("by_month", "by_region", "by_category"):
        found = catalog.QUERIES[name](spark, d).agg({"ca_total": "sum"}).first()[0]
        assert found == pytest.approx(total)
    assert catalog.QUERIES["kpis"](spark, d).first()["ca_total"] == total


def test_entry_without_the_optional_folders(tmp_path):
    """A tree without the training-data folders imports and registers all the rest."""
    root = Path(contract.__file__).resolve().parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    shutil.copytree(root / "salesloom", tmp_path / "salesloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert done.stdout.split()[-2:] == [str(len(catalog.QUERIES)), str(len(oracle.ORACLE))]
