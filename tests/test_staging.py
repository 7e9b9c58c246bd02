import os
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from salesloom import staging


def test_the_folder_of_the_session_is_used(spark):
    assert staging.staging_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_stored_tables_are_read_back_and_removed_with_their_block(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    kept = staging.materialise(df, "kept")
    with staging.scratch(spark):
        inner = staging.materialise(df.filter("a > 1"), "inner")
        assert [tuple(r) for r in inner.collect()] == [(2, "b")]
        path = Path(inner.inputFiles()[0].removeprefix("file:")).parent
        assert path.exists()
    assert not path.exists()
    assert sorted(tuple(r) for r in kept.collect()) == [(1, None), (2, "b")]


def test_row_groups_of_large_rows_hold_a_few_of_them(spark):
    rows = [(i, bytearray(os.urandom(1 << 20))) for i in range(24)]
    df = spark.createDataFrame(rows, "a int, b binary").coalesce(1)
    kept = staging.materialise(df, "large", large_rows=True)
    (file,) = kept.inputFiles()
    found = pq.ParquetFile(file.removeprefix("file:")).metadata
    sizes = [found.row_group(i).total_byte_size for i in range(found.num_row_groups)]
    assert found.num_rows == 24 and max(sizes) <= 10 << 20
    assert sorted((r.a, r.b) for r in kept.collect()) == rows


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.staging_root(Session())


class _Session:
    """What the choice of the folder asks of a session on a cluster."""

    def __init__(self, master, **conf):
        class Conf:
            def get(self, key, default):
                return conf.get(key.replace("spark.", "").replace(".", "_"), default)

        class Context:
            def getCheckpointDir(self):
                return None

        self.conf, self.sparkContext = Conf(), Context()
        self.sparkContext.master = master


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]"])
def test_a_cluster_without_checkpoints_uses_its_warehouse(master):
    root = staging.staging_root(_Session(master, sql_warehouse_dir="file:/shared/warehouse/"))
    assert root == "file:/shared/warehouse/salesloom-staging"


def test_a_named_folder_without_a_scheme_is_taken_at_its_word():
    named = _Session("spark://host:7077", checkpoint_dir="/mnt/shared/", sql_warehouse_dir="/w")
    assert staging.staging_root(named) == "/mnt/shared"


def test_tables_on_the_way_go_and_the_result_stays(spark):
    on_the_way = []

    def make():
        df = staging.materialise(spark.createDataFrame([(1,), (2,)], "a int"), "way")
        on_the_way.append(Path(df.inputFiles()[0].removeprefix("file:")).parent)
        return df.where("a > 1")

    with staging.scratch(spark):
        kept = staging.materialise_alone(spark, make, "kept")
        assert not on_the_way[0].exists()
        assert [tuple(r) for r in kept.collect()] == [(2,)]
        path = Path(kept.inputFiles()[0].removeprefix("file:")).parent
    assert not path.exists()
