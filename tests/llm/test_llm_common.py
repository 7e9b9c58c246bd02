import random

import pytest
from pyspark.sql import functions as F

from salesloom.llm import common
from salesloom.llm.common import BLOCK, blockwise, components, extend, join_hot, match_pairs, ranked


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_match_union_find(spark, seed):
    random.seed(seed)
    edges = [(random.randrange(80), random.randrange(80)) for _ in range(50)]
    edges += [(100 + i, 101 + i) for i in range(40)] + [(500, 600 + i) for i in range(60)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = components(spark.createDataFrame(edges, "u long, v long"))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {tuple(r) for r in found.collect()} == {(x, root(x)) for x in linked}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_ranks_have_no_gaps_and_repeat(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).alias("k"), "id", (F.col("id") % 7).alias("v"))
    df = df.unionByName(spark.createDataFrame([(None, 1, 1), (None, 2, 2)], df.schema))
    one, two = (
        sorted(tuple(r) for r in ranked(df.repartition(n), ["k"], ["v", "id"], "r").collect() if r.k is not None)
        for n in (2, 5)
    )
    assert one == two
    for key in (True, False):
        ranks = sorted(r[3] for r in one if r[0] == key)
        assert ranks == list(range(len(ranks)))


def test_hot_keys_meet_by_broadcast(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 2500, 1).otherwise(F.col("id")).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    joined = join_hot(left, right, "k", "n", 3000)
    assert joined.count() == 3000 and joined.where("k = 1").count() == 2500


@pytest.mark.parametrize("size", [3, BLOCK, 3 * BLOCK + 5])
def test_every_pair_of_a_group_is_compared_once(spark, size):
    import numpy as np

    rows = spark.range(size).select(
        F.lit(7).cast("long").alias("gid"), "id", F.lit(1).cast("long").alias("weight")
    ).unionByName(spark.createDataFrame([(8, 9999, 1)], "gid long, id long, weight long"))

    def match(a, b):
        return match_pairs(a, b, np.ones((len(a), len(a if b is None else b)), bool), counts=True)

    found = blockwise(rows, match, "u long, v long, links long")
    links = {r.u: r.n for r in found.where("u = v").groupBy("u").agg(F.sum("links").alias("n")).collect()}
    assert links == {i: size - 1 for i in range(size)}
    assert components(found.select("u", "v")).select("component").distinct().count() == 1


def test_extend_passes_other_columns_through(spark):
    big = 2**62 + 1
    df = spark.createDataFrame([(big, "a", None), (None, None, [1.5])], "i long, t string, x array<double>")
    found = extend(df, "t", lambda: lambda t: (len(t or ""),), "n long")
    assert found.columns == ["i", "x", "n"]
    assert {(r.i, r.n) for r in found.collect()} == {(big, 1), (None, 0)}


def test_rounds_of_the_stars_let_go_of_the_former_ones(spark, monkeypatch):
    released = []
    monkeypatch.setattr(common, "release", released.append)
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "u bigint, v bigint")
    rows = common.components(path).collect()
    assert sorted((r["node"], r["component"]) for r in rows) == [(i, 0) for i in range(41)]
    assert len(released) > 1
