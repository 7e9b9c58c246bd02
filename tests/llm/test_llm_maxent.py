"""Counts and the base by brute force; the model's score token by token; held-out gain."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from conftest import clashing
from salesloom.llm import maxent


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*(w.decode() for w in lower.encode().split()), ""]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def speech(rng, n):
    """Text in which a word depends on the one before."""
    words, out = [f"w{i}" for i in range(60)], [0]
    for _ in range(n):
        out.append((out[-1] * 7 + rng.choice([1, 2, 3])) % 60 if rng.random() < 0.8 else rng.randrange(60))
    return " ".join(words[i] if rng.random() < 0.97 else f"new{rng.randrange(10**6)}" for i in out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    rows = [(i, speech(rng, rng.randint(1, 200))) for i in range(300)]
    return rows + [(900, None), (901, ""), (902, " \n"), (None, "W1 w2 É é"), (5, rows[5][1]), (903, "w1 " * 30_000)]


def naive(model, counts, text):
    """log10 of the chance of each token of a text, one softmax at a time."""
    def known(word):
        c = counts.get(word, 0)
        if word in model.frequent:
            n = model.frequent[word]
            return model.first_frequent + n // maxent.MEMBERS, n % maxent.MEMBERS, 0.0
        if not c:
            return maxent.NEW, -1, 0.0
        ending = 0 if not word.isascii() else 1 if "a" <= word[-1:] <= "m" else 2 if "n" <= word[-1:] <= "z" else 3
        bits = c.bit_length()
        own = model.rare[(bits if bits <= 2 else (bits + 1) // 2 + 1) * maxent.ENDINGS + ending]
        return own, -1, math.log(c) - model.log_total[own]

    past, out = [0, 0, 0], []
    for word in tokens(text):
        own, member, within = known(word)
        here = np.array(past, np.int64).reshape(3, 1)
        logits = model.outer_bias + sum(model.outer[r] for r in maxent.features(here)[:, 0])
        chance = logits[own] - np.log(np.exp(logits).sum()) + within
        if member >= 0:
            group = own - model.first_frequent
            logits = model.inner_bias[group] + sum(model.inner[r] for r in maxent.features(here, group + 1)[:, 0])
            chance += logits[member] - np.log(np.exp(logits).sum())
        out.append(chance / math.log(10))
        symbol = 1024 + (own - model.first_frequent) * maxent.MEMBERS + member if member >= 0 else 1 + own
        past = [symbol, *past[:2]]
    return out


def test_rows(documents, rows):
    ready, model = maxent.fit(clashing(documents(rows)))
    got = maxent._scored(ready, model).collect()
    assert len(got) == len(rows)
    counts = Counter(t for i, text in rows if not held_out(i) for t in tokens(text))
    total, vocabulary = sum(counts.values()), len(counts)
    texts = {}
    for i, text in rows:
        texts.setdefault(i, text)
    for r in got:
        own = tokens(texts[r.doc_id])
        assert r.held_out == held_out(r.doc_id) and r.train_tokens == total and r.n_tokens == len(own)
        assert r.n_known == sum(t in counts for t in own)
        base = sum(math.log10((counts.get(t, 0) + 1) / (total + vocabulary + 1)) for t in own)
        assert r.base_score == pytest.approx(base)
        if len(own) < 100:
            assert r.score == pytest.approx(sum(naive(model, counts, texts[r.doc_id])), rel=1e-3)
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert len(held) > 20 and all(r.score > r.base_score for r in held)


def test_chances_add_up_to_one(documents, rows):
    _, model = maxent.fit(documents(rows[:200]))
    counts = Counter(t for i, text in rows[:200] if not held_out(i) for t in tokens(text))
    for before in ("", "w1 ", "w5 neverseen w2 "):
        last = len(before.split())
        total = sum(10 ** naive(model, counts, before + w)[last] for w in [*counts, "neverseen"])
        assert total == pytest.approx(1, abs=1e-3)


def test_held_out_texts_teach_nothing(documents, rows):
    def scores(change):
        table = [(i, (t or "") + " zzz" if change and held_out(i) else t) for i, t in rows[:120]]
        return {r.doc_id: (r.base_score, r.score) for r in maxent.score(documents(table)).collect() if not r.held_out}

    assert scores(False) == scores(True)


def test_nothing_to_learn_from(documents):
    assert maxent.score(documents([])).count() == 0
    held = next(i for i in range(100) if held_out(i))
    (row,) = maxent.score(documents([(held, "a b")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


@pytest.mark.parametrize("scale, shift", [(1, 0), (900, 0), (1, -400)])
def test_chances_and_slopes_of_any_size(scale, shift):
    rng = np.random.default_rng(7)
    n, width = 2 * maxent.CHUNK + 5, 9
    table = (rng.normal(size=(maxent.ROWS, width)) * scale + shift).astype(np.float32)
    bias = rng.normal(size=(4, width)).astype(np.float32)
    bias[1, 5:] = -np.inf  # a class with fewer members
    which, target = rng.integers(0, 4, n), rng.integers(0, 5, n)
    rows = rng.integers(0, maxent.ROWS, (maxent.FEATURES, n)).astype(np.uint16)
    logits = bias[which].astype(float) + table[rows].astype(float).sum(axis=0)
    logits -= logits.max(axis=1, keepdims=True)
    chance = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    logp = logits[np.arange(n), target] - np.log(np.exp(logits).sum(axis=1))
    chance[np.arange(n), target] -= 1
    found, slopes = maxent._softmax(bias, which, table, rows, target)
    np.testing.assert_allclose(found, logp, rtol=1e-4, atol=1e-3)
    np.testing.assert_allclose(slopes, chance, atol=2e-3)
    alone, none = maxent._softmax(bias, which, table, rows, target, False)
    assert none is None and (alone == found).all()


def test_sums_of_rows_with_few_and_many_tokens():
    rng = np.random.default_rng(8)
    own = np.r_[np.zeros(500), rng.integers(1, 40, 300), np.arange(50, 90), [99] * maxent.FEW].astype(np.uint16)
    rng.shuffle(own)
    gradient = rng.normal(size=(len(own), 6)).astype(np.float32)
    touched, sums = maxent._sums(gradient, own)
    assert sorted(touched) == sorted(set(own.tolist()))
    want = np.zeros((100, 6))
    np.add.at(want, own, gradient.astype(float))
    np.testing.assert_allclose(sums, want[touched], atol=1e-4)
