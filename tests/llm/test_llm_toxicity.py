import random
import zlib

import pytest

from conftest import clashing
from salesloom.llm import toxicity

INSULTS = ["idiot", "moron", "loser", "worthless", "pathetic"]


def text(rng, n, toxic):
    syllables = ["an", "the", "er", "ti", "on", "re", "sha", "lo", "in", "es"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n)]
    for i in range(0, n if toxic else 0, 12):
        words[i] = rng.choice(INSULTS)
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(i, text(rng, rng.randint(30, 200), i % 3 == 0), int(i % 3 == 0)) for i in range(600)]


@pytest.fixture(scope="module")
def model(rows):
    return toxicity.fit([(t, y) for _, t, y in rows[:400]])


def test_held_out_documents_are_told_apart(rows, model):
    right = sum((model.score(t) >= 0.5) == bool(y) for _, t, y in rows[400:])
    assert right >= 0.95 * 200


def test_dictionaries_are_separate(model):
    assert b"idiot" in model.toxic and b"idiot" not in model.ordinary


def test_windows_cover_the_whole_text():
    words = [f"w{i}" for i in range(1000)] + ["x" * 500]
    seen = b"".join(toxicity.windows(" ".join(words))).replace(toxicity.TAIL, b"").replace(b" ", b"")
    assert seen == "".join(words).encode()


def test_null_empty_and_blank_score_the_same(model):
    assert model.score(None) == model.score("") == model.score(" \n") and 0 <= model.score("") <= 1


def test_the_order_of_rows_does_not_turn_a_score(rows):
    texts = [(t, y) for _, t, y in rows[:480]]
    for seed in range(6):
        random.Random(seed).shuffle(texts)
        assert toxicity.fit(texts).score("idiot " * 6_000) >= 0.5, seed


def test_one_class_gives_a_constant():
    assert toxicity.fit([("a b c", 0)] * 9).score("idiot") == 0
    assert toxicity.fit([("a b c", 1)] * 9).score("idiot") == 1
    assert toxicity.fit([]).score("x") == 0


def test_rows(spark, documents, rows):
    table = [(i, t) for i, t, _ in rows] + [(5, rows[5][1]), (None, "idiot"), (900, None), (901, ""), (902, "idiot " * 60_000)]
    labels = spark.createDataFrame(
        [(i, None, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int"
    )
    found = toxicity.toxicity(clashing(documents(table)), clashing(labels))
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    got = found.collect()
    assert len(got) == len(table)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert next(r for r in got if r.doc_id == 902).predicted == 1


def test_held_out_labels_teach_nothing(spark, documents, rows):
    def scores(flip):
        labels = [(i, y ^ (flip and zlib.crc32(str(i).encode()) % 5 == 0)) for i, _, y in rows]
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        return {r.doc_id: r.score for r in toxicity.toxicity(documents([(i, t) for i, t, _ in rows]), table).collect()}

    assert scores(False) == scores(True)


def test_empty_tables(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(documents([]), labels).count() == 0
    assert toxicity.toxicity(documents([(1, "a")]), labels).first().predicted == 0


def test_keep_ordinary_keeps_all_columns(spark, documents, rows, model):
    table = documents([(i, t, "en", "s") for i, t, _ in rows[400:460]] + [(None, None)])
    kept = toxicity.keep_ordinary(table, model)
    assert kept.schema == table.schema
    assert {r.doc_id for r in kept.collect()} == {
        i for i, t, _ in rows[400:460] if model.score(t) < 0.5
    } | ({None} if model.score(None) < 0.5 else set())


def test_the_cap_does_not_move_the_cut(spark, documents, monkeypatch):
    rng = random.Random(5)
    table = [(i, text(rng, 60, False), int(i % 10 == 0)) for i in range(1200)]  # nothing tells the classes apart
    docs = documents([(i, t) for i, t, _ in table])
    labels = spark.createDataFrame([(i, y) for i, _, y in table], "doc_id long, toxic int")
    for cap in (5_000, 80):
        monkeypatch.setattr(toxicity, "SAMPLE_PER_CLASS", cap)
        scores = [r.score for r in toxicity.toxicity(docs, labels).collect()]
        assert abs(sum(scores) / len(scores) - 0.1) < 0.04, cap
