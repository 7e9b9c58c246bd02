"""What queries leave on the disk while they run: shuffle files and copies of the lines."""

import time

import pytest

import __spark_entry__ as contract
from helpers import plan
from salesloom.plans import catalog
from salesloom.sources import csv_files, quoted_lines
from test_cluster_folder import star  # noqa: F401
from test_files import PLAIN, lines_of, rows, scanned, write


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found, names = manager.getAllFiles().iterator(), set()
    while found.hasNext():
        name = found.next().getName()
        if name.startswith("shuffle_"):
            names.add(name)
    return names


def left_over(spark, before, seconds=10):
    """Shuffle files that came since and do not go."""
    until = time.time() + seconds
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return left


def watched(spark, monkeypatch, module, name):
    """(input comes from joins?, shuffle files left over) of each call of a function whose input is a DataFrame."""
    seen, original = [], getattr(module, name)

    def call(*args, **more):
        df = next(a for a in args if hasattr(a, "queryExecution") or hasattr(a, "_jdf"))
        joins, before = "Join" in plan(df), shuffle_files(spark)
        result = original(*args, **more)
        seen.append((joins, left_over(spark, before)))
        return result

    monkeypatch.setattr(module, name, call)
    return seen


@pytest.mark.parametrize("name, drops", [("stream_subfolders", 3), ("scan_csv_quoted", 1)])
def test_input_files_are_written_from_lines_joined_once(spark, star, monkeypatch, name, drops):  # noqa: F811
    seen = watched(spark, monkeypatch, catalog.sinks, "write_csv")
    assert contract.queries()[name](spark, star).count() > 0
    assert seen == [(False, set())] * drops


@pytest.mark.parametrize("name", ["stream_dedupe", "reports_incremental", "medians_incremental"])
def test_drops_are_merged_from_lines_joined_once(spark, star, monkeypatch, name):  # noqa: F811
    seen = watched(spark, monkeypatch, catalog.incremental, "add_drop")
    assert contract.queries()[name](spark, star).count() > 0
    assert seen == [(False, set())] * 3


def test_lines_of_quoted_records_are_stored_once_and_meet_once(spark, tmp_path, monkeypatch):
    write(tmp_path, "a.csv", lines_of(*[PLAIN.replace("Tablette", f'"T\n\n{i}"') for i in range(300)], PLAIN))
    stored, kept = [], quoted_lines.materialise

    def materialise(df, name):
        moved = plan(df).count("Exchange hashpartitioning(path")
        table = kept(df, name)
        if "value" in table.columns:
            stored.append((moved, table.count()))
        return table

    monkeypatch.setattr(quoted_lines, "materialise", materialise)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        found = rows(scanned(spark, tmp_path).lines, "produit")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted(found) == sorted([(f"T\n\n{i}",) for i in range(300)] + [("Tablette",)])
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None
    # All records and the second parts of those that a split cuts; then these alone, put together.
    (moved, parts), (_, spanning) = stored
    assert moved == 1
    assert 302 < parts < 400 and 0 < spanning < 100
    assert csv_files.quarantined(scanned(spark, tmp_path).files).count() == 0


def test_a_record_may_fill_whole_splits(spark, tmp_path):
    long = "x\n" * 3000
    write(tmp_path, "a.csv", lines_of(PLAIN, PLAIN.replace("Tablette", f'"{long}"'), PLAIN, PLAIN.replace("Tablette", '"a\nb"')))
    write(tmp_path, "ouvert.csv", lines_of(PLAIN, PLAIN.replace("Tablette", f'"{long}'), PLAIN))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        scan = scanned(spark, tmp_path)
        assert sorted(rows(scan.lines, "produit")) == [("Tablette",), ("Tablette",), ("a\nb",), (long,)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert rows(csv_files.quarantined(scan.files), "source_fichier", "raison") == [("ouvert.csv", csv_files.OPEN_QUOTE)]
