"""The alignment against whole-text encoding and a walk over both token lists."""

import hashlib
import random
import tracemalloc
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest

from conftest import clashing
from salesloom.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(texts):
    """Per text (ids and bytes of a, of b), by the libraries' calls on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    own = alignment.aligner(*PATHS)
    for text in texts:
        ids = a.encode(f" {text}", add_special_tokens=False).ids
        pieces = b.encode(text)
        raw = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
               for i in pieces]
        yield [(i, own.bytes_a[i]) for i in ids], list(zip(pieces, raw, strict=True))


def spans(side):
    end, out = 0, []
    for i, raw in side:
        out.append((i, end, end + len(raw)))
        end += len(raw)
    return out


def brute(rows):
    found, counts = [], Counter()
    for (doc, text), (a, b) in zip(rows, tokens([t or "" for _, t in rows]), strict=True):
        want = f" {text}".encode()
        if not text or any(b"".join(raw for _, raw in side) != want for side in (a, b)):
            found.append((doc, None))
            continue
        a, b = spans(a), spans(b)
        links, first = [], 0
        for i, start, end in a:
            while b[first][2] <= start:
                first += 1
            at = first
            while at < len(b) and b[at][1] < end:
                links.append((i, b[at][0]))
                at += 1
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = []
        for low, high in zip([0, *ends[:-1]], ends, strict=True):
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in (a, b)))
        counts.update(links)
        found.append((doc, (len(a), len(b), len(ends), links, ";".join(groups))))
    best = {}
    for (_, i), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for doc, what in found:
        if what is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, text = what
        out.append((
            doc, n_a, n_b, n_groups, len(links), sum(counts[p] == best[p[1]] for p in links),
            sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest(),
        ))
    return out


ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "▁x", "ﬁ é", "a <s> b</s> <|endoftext|> c", "日本語 テキスト",
    "é " * 50, "a\n b\t c \n", "x  y — z", "　 x", "\x00 a", "\U0001f642 \U0001f643\U0001f642 x", "don't  we'll 12 345  ",
    "́a ́", "a" * 700, "日本" * 40, " " * 40, "x\u0085 y", "l'été d'un " * 30,
]


def mixed(rng, n):
    return "".join(rng.choice(["a", "b ", " ", "\n", "é", "日", "  ", "the ", "'s", "12", ".", "  "]) for _ in range(n))


@pytest.mark.parametrize("size", [1 << 16, 200])
def test_equals_brute_force(documents, size):
    rng = random.Random(1)
    texts = ODD + [mixed(rng, rng.randint(1, 120)) for _ in range(30 if size > 200 else 6)]
    rows = list(enumerate(texts)) + [(None, "null id"), (4, "a"), (4, "a")]
    if size > 200:
        rows += [(900, "word " * 9_000)]  # one long text of repeated words
    else:
        rows = [r for r in rows if len(r[1] or "") < 400]
    got = alignment.align(clashing(documents(rows)), *PATHS, size)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute(rows), key=key)
    assert got.columns[:2] == ["doc_id", "n_a"]


def test_empty_table(documents):
    assert alignment.align(documents([]), *PATHS).count() == 0


def test_fragments_compose_associatively():
    own = alignment.aligner(*PATHS)
    rng = random.Random(2)
    for turn in range(60):
        span = f" {mixed(rng, rng.randint(1, 60))}".encode()
        whole = alignment.Fragment(span).whole(own)
        for size in (1, 2, 5, 11):
            parts = [alignment.Fragment.of(own, span[i:i + size]) for i in range(0, len(span), size)]
            join = lambda x, y: x.compose(own, y)
            left = reduce(join, parts)
            while len(parts) > 1:  # another bracketing
                k = rng.randrange(len(parts) - 1)
                parts[k:k + 2] = [join(*parts[k:k + 2])]
            for f in (left.whole(own), parts[0].whole(own)):
                assert (f.groups, f.fine, f.numbers.tolist()) == (whole.groups, whole.fine, whole.numbers.tolist())
                assert sorted(np.frombuffer(f.pairs, own.kind)) == sorted(np.frombuffer(whole.pairs, own.kind))


def test_forgetting_units_changes_nothing(documents, monkeypatch):
    rows = [(i, f"the word{i % 9} {'x' * (i % 5)} é{i}\u00a0 ") for i in range(40)]
    want = sorted(brute(rows))
    got = alignment.align(documents(rows).coalesce(1), *PATHS)
    assert sorted(tuple(r) for r in got.collect()) == want
    own = alignment.Aligner(*PATHS)
    first = own.look_up([b"the", b"word1", b"the", b"", b"x\n"])
    names = [own.groups[i] for i in first]
    own.forget()
    again = [own.groups[i] for i in own.look_up([b"x\n", b"word1", b"the", b""])]
    assert names == [again[2], again[1], again[2], again[3], again[0]]


def test_tasks_of_long_documents_have_one_python_worker(spark, documents):
    docs = documents([(1, "some words of a text " * 400), (2, "short")])
    plan = alignment._long(docs, PATHS, 16)._jdf.queryExecution().executedPlan().toString()
    steps = [sum("InPandas" in line for line in part.splitlines()) for part in plan.split("Exchange")]
    assert sum(steps) >= 3 and max(steps) == 1


def test_a_batch_of_large_blocks_is_read_block_by_block():
    kind, size, blocks = np.dtype("<u4"), 1 << 18, 24
    pairs = np.tile(np.arange(64, dtype=kind), size // 64)
    one = alignment._block(0, [(1, [1, 1, 1, 1], "x")], [1], [0], [size], pairs)
    batch = pa.Table.from_batches([one] * blocks).combine_chunks().to_batches()[0]

    tracemalloc.start()
    try:
        found = [b.to_pydict() for b in alignment._block_pairs(iter([batch]), kind)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == blocks
    assert all(f["pair"] == list(range(64)) and f["links"] == [size // 64] * 64 for f in found)
    assert peak < batch.nbytes


def test_a_worker_keeps_no_units_between_tasks(spark):
    docs = spark.createDataFrame([(i, f"mot{i} et encore {i}") for i in range(50)], "doc_id long, text string")
    got = []

    class Docs:
        """Runs the task's function here, to see what it leaves behind."""

        def mapInArrow(self, function, schema):
            batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["un mot", "deux mots"]})
            got.extend(function(iter([batch])))

    class Context:
        partitionId = staticmethod(lambda: 0)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(alignment.TaskContext, "get", staticmethod(Context))
        alignment._short(Docs(), PATHS)
    assert got[0].column("doc_id").to_pylist() == [[1, 2]]
    assert not alignment.aligner(*PATHS).known
    assert alignment.align(docs, *PATHS).count() == 50


def test_blocks_are_stored_a_few_to_a_row_group(documents, monkeypatch):
    kinds = {}

    def spy(df, name, **options):
        kinds[name] = options
        return store(df, name, **options)

    store = alignment.stage
    monkeypatch.setattr(alignment, "stage", spy)
    assert alignment.align(documents([(1, "some words"), (2, "a text")]), *PATHS).count() == 2
    assert kinds["aligned"] == {"large_rows": True}


def test_a_task_learns_its_frequent_units_once(monkeypatch):
    texts = [" ".join(f"w{i}" for i in range(low, low + 1_000)) for low in range(0, 100_000, 1_000)]
    learnt, tasks = [], []

    class Docs:
        """Keeps the task's function, to run it here."""

        def mapInArrow(self, function, schema):
            tasks.append(function)

    def learn(own, fresh):
        learnt.append(len(fresh))
        return kept(own, fresh)

    kept = alignment.Aligner._learn
    monkeypatch.setattr(alignment.Aligner, "_learn", learn)
    monkeypatch.setattr(alignment.TaskContext, "get", lambda: type("", (), {"partitionId": lambda self: 0})())
    alignment._short(Docs(), PATHS)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": texts * 3})
    assert sum(b.num_rows for b in tasks[0](iter([batch]))) >= 1
    assert sum(learnt) == 100_000
