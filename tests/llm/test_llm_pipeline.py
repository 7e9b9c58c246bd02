"""The pipeline's stages against what their operators say, and the registration."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from salesloom.llm import jaccard, mixing, substrings
from salesloom.llm.queries import ORACLE, QUERIES
from tools.check_oracle import canonical


def test_every_operator_is_registered():
    names = contract.queries()
    assert set(QUERIES) <= set(names) and names["pipeline"] is corpus_pipeline.run
    assert [sum(n.startswith(f"op{i}_") for n in QUERIES) for i in range(1, 14)] == [1] * 13
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, sf_dir)
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.collect(), df.columns) == canonical(want.fetchall(), columns)


def test_stages_over_the_small_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [{r.doc_id: r.text for r in docs.collect()}]
    frames = [docs]
    for _, step in corpus_pipeline.STAGES[:4]:
        out = corpus_pipeline.stage(step(spark, frames[-1], sf_dir), "test")
        assert out.schema.names == docs.schema.names
        frames.append(out)
        rows.append(out.collect())
    clean, distinct, unrepeated, mixed = rows[1:]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    ordinary = [i for i in rows[0] if labels.get(i) == 0]
    assert len({r.doc_id for r in clean} & set(ordinary)) >= 0.95 * len(ordinary)
    # One document of each class stays, unchanged.
    classes = {r.class_id for r in jaccard.join(frames[1]).collect()}
    assert sorted(r.doc_id for r in distinct) == sorted(classes)
    assert all(rows[0][r.doc_id] == r.text for r in distinct)
    # All documents stay, without the words that repeat.
    kept = {r.doc_id: r.kept_sha256 for r in substrings.repeats(frames[2]).collect()}
    assert sorted(r.doc_id for r in unrepeated) == sorted(kept)
    for r in unrepeated:
        words = (r.text or "").encode().split()
        assert hashlib.sha256(b" ".join(words)).hexdigest() == kept[r.doc_id]
        assert r.n_chars == len(r.text)
    # Documents come as often as the mix takes them, and only as they are.
    texts = {(r.doc_id, r.text) for r in unrepeated}
    times = Counter((r.doc_id, r.text) for r in mixed)
    assert set(times) <= texts and max(times.values()) <= 3
    pieces = corpus_pipeline.STAGES[4][1](spark, frames[4], sf_dir).collect()
    assert {p.doc_id for p in pieces} == {d for d, _ in times}


def test_stages_handle_odd_rows(spark, sf_dir):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(99)}" for _ in range(200))
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, None, None, None, None), (3, "", "en", "b", 0),
            (None, "x y", None, "a", 3), (4, "word " * 50_000, "en", "b", 1), (2, None, None, None, None)]
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS size", "1 AS rank")
    for data in (docs, docs.limit(0)):
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, data, sf_dir)
            n = out.count()
            if data is not docs:
                assert n == 0, name
            elif name != "packing":
                assert out.columns == docs.columns and n > 0, name


def test_one_document_of_a_class_stays_and_all_without_words(spark, documents):
    rng = random.Random(2)
    words = [f"w{rng.randrange(999)}" for _ in range(300)]
    near = [" ".join([*words, last]) for last in ("x", "y", "z")]
    blank = [(None, None), (None, None), (None, ""), (3, ""), (3, ""), (4, " \n")]
    for rows in ([(1, near[0]), (1, near[1]), (2, near[2])], [(None, near[0]), (None, near[1])]):
        got = corpus_pipeline.distinct(spark, documents([*rows, rows[0], *blank, (9, "a b")]), "").collect()
        kept = [(r.doc_id, r.text) for r in got]
        assert Counter(k for k in kept if k[1] not in near) == Counter([*blank, (9, "a b")])
        (stays,) = [k for k in kept if k[1] in near]
        assert stays in rows[:2]


def test_copies_go_to_the_rows_of_their_source(spark, documents):
    rows = [(i, f"w{i} " * 10, "en", s) for i in range(60) for s in ("a", "b", None)] + [(5, "w5 " * 10, "en", "a")]
    docs = documents(rows)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.source, r.doc_id] += r.copies
    got = Counter((r.source, r.doc_id) for r in corpus_pipeline.mixed(spark, docs, "").collect())
    assert got == +want


def test_tables_of_the_search_go_before_texts_are_joined(spark, documents):
    """Only the cut texts are left on disk when the stage returns its rows."""
    passage = " ".join(f"w{i}" for i in range(60))
    docs = documents([(1, f"a {passage} b"), (2, f"c {passage}"), (3, "short"), (4, None), (1, f"a {passage} b")])
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {p.name for p in folder.iterdir()}
    out = corpus_pipeline.unrepeated(spark, docs, "")
    left = {p.name for p in folder.iterdir()} - before
    assert [name.split("-")[0] for name in left] == ["cut"]
    found = out.collect()
    assert len(found) == 5 and all(r.n_chars == len(r.text) for r in found if r.text is not None)
    assert {(2, "c"), (3, "short"), (4, None)} <= {(r.doc_id, r.text) for r in found}
