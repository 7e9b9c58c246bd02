import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from conftest import clashing
from salesloom.llm import substrings


def brute(rows):
    words = [(t or "").encode().split() for _, t in rows]
    w = substrings.WINDOW
    count = Counter(tuple(x[i:i + w]) for x in words for i in range(len(x) - w + 1))
    out = []
    for (doc, _), x in zip(rows, words, strict=True):
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if count[tuple(x[i:i + w])] > 1:
                gone[i:i + w] = [True] * w
        kept = b" ".join(a for a, g in zip(x, gone, strict=True) if not g)
        out.append((doc, len(x), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("hot", [256, 3])
def test_equals_brute_force(documents, hot):
    rng = random.Random(hot)
    word = lambda: f"w{rng.randrange(500)}"
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 120)]
    texts = []
    for _ in range(60):
        parts = [[word() for _ in range(rng.randint(0, 60))]]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            cut = rng.randint(0, 10)
            parts += [p[cut:], [word() for _ in range(rng.randint(0, 20))]]
        texts.append(" ".join(x for p in parts for x in p))
    texts += [texts[0]] * 3 + ["a " * 90, "a b " * 40]
    rows = list(enumerate(texts))
    got = substrings.repeats(documents(rows), hot, 16)
    assert found(got) == brute(rows)
    for r in got.collect():  # the text that stays is what the hash says
        if r.kept_text is not None:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_a_very_frequent_passage_and_one_of_equal_words(documents):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5_000)}"
    passage = " ".join(word() for _ in range(38))
    side = lambda: " ".join(word() for _ in range(30))
    rows = [(i, f"{side()} {passage} {side()}") for i in range(300)]
    rows += [(400, "same " * 1_000_000), (401, "a b c " * 400), (402, "x a b c " + "a b c " * 20)]
    got = {r.doc_id: r for r in substrings.repeats(documents(rows)).collect()}
    want = brute([r for r in rows if r[0] != 400])
    assert sorted((i, r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items() if i != 400) == want
    assert (got[400].n_words, got[400].n_removed, got[400].kept_sha256) == (10**6, 10**6, substrings.EMPTY)


def test_weighted_stretches_count_their_places():
    rng = np.random.default_rng(5)
    texts = [rng.integers(1, 4, 40) for _ in range(6)]
    weights = [1, 2, 3, 1, 5, 2]
    repeated = [t for t, w in zip(texts, weights, strict=True) for _ in range(w)]
    want = substrings.FMIndex(repeated, 3).counts(texts)
    got = substrings.FMIndex(texts, 3, weights).counts(texts)
    assert all((a == b).all() for a, b in zip(want, got, strict=True))


def test_special_rows(documents):
    long = " ".join(f"x{i}" for i in range(20_000))
    mid = " ".join(f"x{i}" for i in range(5_000, 5_100))
    rows = [
        (1, None), (2, ""), (3, "  "), (4, "short text"), (4, "short text"), (5, long), (6, "y " + mid + " z"),
        (7, mid.replace(" ", "\n")), (7, mid.replace(" ", "\n")), (8, mid.upper()),
    ]
    assert found(substrings.repeats(clashing(documents(rows)))) == brute(rows)
    assert substrings.repeats(documents([])).count() == 0
    assert substrings.repeats(documents([(None, long)])).first().n_removed == 0


@pytest.mark.parametrize("window", [1, 2, 3, 5, 8, 35])
def test_index_counts_every_window(window):
    rng = np.random.default_rng(window)
    for _ in range(10):
        base = rng.integers(1, 4 if window < 35 else 300, 200)
        texts = [
            np.r_[rng.integers(1, 5, rng.integers(1, 20)), base[a:a + rng.integers(1, 90)]]
            for a in rng.integers(0, 150, 12)
        ]
        count = Counter(tuple(t[i:i + window]) for t in texts for i in range(len(t) - window + 1))
        got = substrings.FMIndex(texts, window).counts(texts)
        for t, g in zip(texts, got, strict=True):
            assert [count[tuple(t[i:i + window])] for i in range(len(t) - window + 1)] == g.tolist()


def test_wavelet_ranks():
    x = np.random.default_rng(2).integers(0, 37, 1000)
    m = substrings.WaveletMatrix(x)
    at = np.arange(1001)
    for s in range(37):
        symbol = np.full(1001, s)
        rank = m.descend(symbol, at) - m.descend(symbol, np.zeros(1001, int))
        assert rank.tolist() == np.r_[0, np.cumsum(x == s)].tolist()


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 2**63, 80, dtype=np.uint64)
    at = {}
    for _ in range(20):
        left = rng.integers(0, 2**63, rng.integers(0, 50), dtype=np.uint64)
        text = np.r_[left, passage, rng.integers(0, 2**63, 40, dtype=np.uint64)]
        value, first, last = substrings.anchors(text)
        assert first[0] == 0 and last[-1] == len(text) - substrings.WINDOW and (first[1:] == last[:-1] + 1).all()
        own = np.repeat(value, last - first + 1)
        for i in range(80 - substrings.WINDOW + 1):
            assert at.setdefault(i, own[len(left) + i]) == own[len(left) + i]
