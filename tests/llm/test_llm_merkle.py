"""The manifest against a recursive tree and against its SQL twin."""

import binascii
import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from conftest import clashing
from salesloom.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    values = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join(values))


def climb(nodes):
    """Root of a list of digests, and for each its siblings per level as (before, after)."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, above = [], []
        for start in range(0, len(nodes), 8):
            run = nodes[start:start + 8]
            for k in range(len(run)):
                for i in under[start + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(sha("".join(run)))
            above.append([i for u in under[start:start + 8] for i in u])
        nodes, under = up, above
    return nodes[0], paths


def brute(rows):
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2]].append(row)
    langs = sorted(by_lang, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for lang in langs:
        ordered = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = ordered, *climb([leaf(r) for r in ordered])
    root, tops = climb([trees[g][1] for g in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        ordered, subroot, paths = trees[lang]
        for row, path in zip(ordered, paths, strict=True):
            steps = path + top
            lower = row[0] is not None and binascii.crc32(str(row[0]).encode()) % 3 == 0
            folded = leaf(row, lower)
            for before, after in steps:
                folded = sha(before + folded + after)
            out.append((row[0], leaf(row), subroot, root, sha("".join(a + b for a, b in steps)), folded, folded == root))
    return out


NAMES = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"


def key(row):
    return tuple((x is None, x) for x in row)


def found(df):
    return sorted((tuple(r) for r in df.select(*NAMES.split(", ")).collect()), key=key)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8, "b": 9}, {"a": 65, None: 3, "é": 1, "": 2, "b": 600}])
def test_equals_brute_force_and_sql(documents, sizes):
    rng = random.Random(len(sizes))
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "Abc É", "x", "ABC " * 300])
            rows.append((rng.randrange(9_000), text, lang, rng.choice([None, "", "src"])))
    rows.append(rows[0])
    df = documents(rows)
    full = [tuple(r) for r in df.collect()]
    want = sorted(brute(full), key=key)
    assert found(merkle.manifest(clashing(df))) == want
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert sorted(con.execute(f"SELECT {NAMES} FROM ({merkle.oracle()})").fetchall(), key=key) == want


def test_rows_without_ids_and_empty_tables(documents):
    rows = [(None, "A", None, None), (None, "A", None, None), (None, None, "x", "s"), (3, "", "x", None)]
    df = documents(rows)
    assert found(merkle.manifest(df)) == sorted(brute([tuple(r) for r in df.collect()]), key=key)
    assert merkle.manifest(documents([])).count() == 0


def test_many_ranges_give_the_same_positions(documents, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 7)
    rows = [(i // 3, "t", "a" if i % 3 else "b", "s") for i in range(200)]  # equal rows share a rank
    df = documents(rows)
    assert found(merkle.manifest(df)) == sorted(brute([tuple(r) for r in df.collect()]), key=key)


def test_no_python_worker_takes_part(documents):
    plan = merkle.manifest(documents([(1, "a", "x", "s")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow", "CartesianProduct"))
