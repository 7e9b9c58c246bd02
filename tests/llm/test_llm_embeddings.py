import math
import time
import tracemalloc

import duckdb
import numpy as np
import pytest

from conftest import clashing
from salesloom.llm import embeddings, topk
from salesloom.llm.queries import ORACLE

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed, n=500, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    for i in range(0, n - 4, 5):  # near and exact copies around the threshold
        x[i + 1] = x[i]
        x[i + 2] = x[i] + rng.uniform(0.1, 0.5) * rng.standard_normal(dim)
    return [(int(i), x[i].tolist(), int(i // 50 % 3)) for i in range(n)]


def brute(rows, cosine=0.93):
    ids = [r[0] for r in rows]
    ok = [
        r[1] is not None and r[2] is not None and len(r[1]) > 0
        and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1]) for r in rows
    ]
    unit = [np.array(r[1], np.float32).astype(float) if g else None for r, g in zip(rows, ok, strict=True)]
    n, links, parent = len(rows), [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                c = unit[i] @ unit[j] / np.linalg.norm(unit[i]) / np.linalg.norm(unit[j])
                if c >= cosine:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return sorted((ids[i], links[i], least[root(i)], ids[i] == least[root(i)]) for i in range(n))


def found(df):
    return sorted(tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect())


ODD = [
    (9001, None, 1), (9002, [0.0] * 24, 1), (9003, [float("nan")] * 24, 1), (9004, [None] + [1.0] * 23, 1),
    (9005, [float("inf")] + [1.0] * 23, 1), (9006, [1.0] * 24, None), (9007, [1.0] * 24, None), (9008, [], 1),
    (9009, [1.0, 0.0], 1), (9010, [1.0, 0.01], 1), (9011, [1.0] * 24, 2), (9011, [1.0] * 24, 2),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_brute_force(spark, seed):
    rows = vectors(seed) + ODD
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    assert found(embeddings.near_duplicates(df)) == brute(rows)


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal(32)
    rows = [(i, (base + 0.25 * rng.standard_normal(32)).tolist(), 1) for i in range(300)]
    assert found(embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_no_vectors(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert topk.search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_listing_finds_every_passed_filter():
    rng = np.random.default_rng(1)
    unit = rng.standard_normal((50, 24))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    code = embeddings.Code(24, embeddings.Caps(0.3, 9, 1), 3)
    rows, words = code.passed(unit)
    turned = unit @ code.rotation
    expected = set()
    for w in range(81):
        direction = np.concatenate([code.words[0][w // 9], code.words[1][w % 9]])
        assert abs(np.linalg.norm(direction) - 1) < 1e-9
        expected |= {(int(i), w) for i in np.flatnonzero(turned @ direction >= 0.3)}
    assert expected and set(zip(rows.tolist(), words.tolist(), strict=True)) == expected


@pytest.mark.parametrize(("rows", "dim"), [(500, 64), (5_000, 64), (100_000, 64), (5_000, 8), (170, 24), (3, 2)])
def test_pairs_at_the_threshold_share_a_filter(rows, dim):
    rng = np.random.default_rng(rows)
    x = rng.standard_normal((500, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((500, dim))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * z
    cap = embeddings.caps(rows, dim, 0.93, 0.9999)
    met = set()
    for number in range(cap.codes):
        code = embeddings.Code(dim, cap, number)
        a, b = (set(zip(*(p.tolist() for p in code.passed(v)), strict=True)) for v in (x, y))
        met |= {i for i, _ in a & b}
    assert len(met) >= 499


def test_caps_take_fixed_memory():
    tracemalloc.start()
    cap = embeddings.caps(3_000_000, 64, 0.93, 0.9999)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and cap.directions == 343


@pytest.mark.parametrize(("rows", "dim"), [(3, 2), (50, 1), (500, 24), (20_000, 64)])
def test_the_level_is_the_quantile_of_all_products(rows, dim, monkeypatch):
    unit = np.random.default_rng(rows).standard_normal((60, dim))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    passes = min(0.25, embeddings.BUCKET / rows)
    code = embeddings.Code(dim, embeddings.Caps(0, max(2, math.ceil((2.5 / passes) ** 0.5)), 1), 5)
    total = np.zeros((60, 1))
    for score in code.scores(unit):
        total = (total[:, :, None] + score[:, None, :]).reshape(60, -1)
    for cells in (1 << 21, 100):
        monkeypatch.setattr(embeddings, "CELLS", cells)
        assert embeddings._level(code, unit, passes) == pytest.approx(np.quantile(total, 1 - passes), abs=1e-12)


def test_topk_equals_sql(spark):
    rng = np.random.default_rng(5)
    rows = [(i, np.round(rng.standard_normal(6), 1).tolist(), 0) for i in range(700)]
    rows += [(i + 700, rows[i][1], 0) for i in range(40)] + ODD[:9] + [(9100, [1.0, 2.0], 1), (None, [1.0] * 6, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in topk.search(clashing(df)).select("query_id", "rank", "vec_id", "score").collect())
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    assert got == sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({ORACLE['op4_topk']})").fetchall())


def test_topk_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 150)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    rows = vectors(7, 600)
    ints = {i: np.floor(np.array(x, np.float32).astype(float) * 1024).astype(int) for i, x, _ in rows}
    want = []
    for q in range(0, 600, 100):
        best = sorted((-int(ints[q] @ x), i) for i, x in ints.items() if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    got = topk.search(spark.createDataFrame(rows, SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (0, [1.0, 0.0], 1)]
    got = topk.search(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 512 * 1024)]


@pytest.mark.parametrize("dim", [1, 8, 64])
def test_index_stops_only_on_proof(dim):
    rng = np.random.default_rng(dim)
    x = rng.integers(-900, 900, (3000, dim))
    x[:, 0] = rng.choice([-3, 0, 5], 3000)
    index = topk.Index(np.arange(3000), x)
    for q in range(0, 3000, 150):
        scores = x @ x[q]
        scores[q] = -10**15
        want = np.lexsort((np.arange(3000), -scores))[:10]
        assert index.top(x[q], 10, q)[0].tolist() == want.tolist()


def least_seconds(f, repeats=7):
    times = []
    for _ in range(repeats):
        start = time.process_time()
        f()
        times.append(time.process_time() - start)
    return min(times)


def test_a_query_costs_little_beside_adding_up_its_postings():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 130, (7000, 64)).astype(np.int64)
    index = topk.Index(np.arange(7000), x)
    postings, gains = np.concatenate(index.segments), np.ones(x.size)
    adding = least_seconds(lambda: [np.bincount(postings, gains, 7000) for _ in range(5)])
    searching = least_seconds(lambda: [index.top(x[q], 10, q) for q in range(0, 500, 100)])
    assert searching < 9 * adding


@pytest.mark.parametrize("scale", [1, 10**6, 10**8])
def test_scores_are_exact_beyond_what_doubles_hold(scale):
    rng = np.random.default_rng(scale)
    x = rng.integers(-9, 9, (900, 4)) * scale + rng.integers(0, 3, (900, 4))
    index = topk.Index(np.arange(900), x)
    for q in range(0, 900, 100):
        scores = x @ x[q]
        others = np.flatnonzero(np.arange(900) != q)
        want = others[np.lexsort((others, -scores[others]))[:10]]
        rows, got = index.top(x[q], 10, q)
        assert rows.tolist() == want.tolist() and got.tolist() == scores[want].tolist()
