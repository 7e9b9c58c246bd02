import random

import numpy as np
import pytest

from conftest import clashing
from salesloom.llm import jaccard


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        k = min(5, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, least[root(i)], links[i]) for i, (doc, _) in enumerate(rows))


def found(df):
    return sorted((r.doc_id, r.class_id, r.n_links) for r in df.collect())


def corpus(seed, n=60, group=40):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    rows = [[word() for _ in range(rng.randint(1, 120))] for _ in range(n)]
    passage = [word() for _ in range(60)]
    for _ in range(group):  # near copies around the threshold, sharing with each other
        base = list(rows[0] if rng.random() < 0.3 else passage + rows[1][:60])
        for _ in range(rng.randint(0, 4)):
            base[rng.randrange(len(base))] = word()
        rows.append(base)
    rows += [passage + [word() for _ in range(80)] for _ in range(20)]
    texts = [" ".join(r) for r in rows] + [" ".join(rows[3])] * 5
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(documents, seed):
    rows = corpus(seed)
    assert found(jaccard.join(documents(rows))) == brute(rows)


def test_a_group_larger_than_a_block(documents):
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(90)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(90)] = f"v{rng.randrange(900)}"
        rows.append((i, " ".join(words)))
    assert found(jaccard.join(documents(rows))) == brute(rows)


def test_special_rows(documents):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one  two\n"), (6, "One two"), (7, long), (8, long + " y"),
        (9, long), (10, "a b c d e"), (11, "a b c d e f"), (12, "a b"), (12, "a b"),
    ]
    assert found(jaccard.join(clashing(documents(rows)))) == brute(rows)
    kept = [r for r in jaccard.join(documents(rows)).collect() if r.kept]
    assert sorted(r.doc_id for r in kept) == [1, 2, 3, 4, 6, 7, 10, 11, 12, 12]


def test_null_ids_and_empty_table(documents):
    rows = jaccard.join(documents([(None, "a b c"), (None, None), (4, "a b c")])).collect()
    assert sorted((r.doc_id is None, r.n_links) for r in rows) == [(False, 1), (True, 0), (True, 1)]
    assert jaccard.join(documents([])).count() == 0


def test_sketches_estimate_the_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        agree = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
            common = int(400 * share)
            rest = (400 - common) // 2
            a, b = pool[:common + rest], np.r_[pool[:common], pool[common + rest:]]
            agree.append((jaccard.sketch(a) == jaccard.sketch(b)).mean())
        assert abs(np.mean(agree) - share) < 0.03


def test_recall_of_the_trees():
    assert jaccard.trees(0.9999, 0.8) > jaccard.trees(0.9, 0.8)
    rng = np.random.default_rng(4)
    missed = 0
    roots = jaccard._mix(np.arange(1, jaccard.trees(0.9999, 0.8) + 1, dtype=np.uint64))
    for _ in range(150):  # pairs at the threshold must share a node at the last level
        a = rng.integers(0, 2**32, jaccard.COORDINATES, dtype=np.uint32)
        b = np.where(rng.random(jaccard.COORDINATES) < 0.8, a, a + 1).astype(np.uint32)
        nodes = [set(roots.tolist()), set(roots.tolist())]
        for _ in range(jaccard.DEPTH):
            nodes = [
                {
                    int(p) for _, paths in jaccard.split(
                        np.array(sorted(own), np.uint64), np.tile(x, (len(own), 1)), 0.8
                    ) for p in paths.view(np.uint64)
                } for own, x in zip(nodes, (a, b), strict=True)
            ]
        missed += not nodes[0] & nodes[1]
    assert missed <= 2
