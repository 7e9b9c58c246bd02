"""Language-model scoring with a hashed maximum-entropy model.

The chance of a word is that of its class after the words before it, times that of the word
in its class. Both factors are softmaxes over hashed features of the history: the last word,
the last two, and skips to the second and third last. Frequent words form classes of their
own; all other words are classed by how often they occur and how they end, and words never
seen are one class, so rare and new words get the mass that leaving one occurrence out
gives them. Inside a class of rare words only their counts tell them apart.

Texts are read once into blocks of a few megabytes: the tokens of many documents as numbers
into the block's own list of words. Counts come to the blocks by one shuffle of these lists;
after that, training and scoring read numbers only. Training goes in rounds: every task
makes gradient steps on its blocks from the shared weights, the changes are averaged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import _parts, stage

#: Tokens of a block, beyond which a new one begins.
BLOCK_TOKENS = 1 << 20
#: A word is frequent from one token in so many on, so there are at most so many.
FREQUENT = 4_096
#: Frequent words of a class, and kinds of endings of the others.
MEMBERS, ENDINGS = 64, 4
#: Hashed rows of each of the two weight tables.
ROWS = 1 << 14
#: Rounds over the training documents; each takes its share of every block.
ROUNDS = 3
#: Tokens of a gradient step, step size, and what the squared gradients start from.
BATCH, RATE, START = 1 << 14, 1.0, 4.0
#: Tokens whose chances are worked out together, so that they stay in a core's cache.
CHUNK = 1 << 10
#: Logits above this, and sums of their exponentials below that, are shifted first.
HIGH, LOW = 60.0, 1e-25
#: Tokens of one row up to which gradients are added up for all such rows at once.
FEW = 16
#: Rows in which the changed weights travel, and tokens that one task learns from before.
SLICES, TASK_TOKENS = 32, 1 << 23
#: Features of the history.
FEATURES = 4
NEW = 0  # the class of words never seen


class Numbers(dict):
    """Words of a block to their numbers; the end of a text is the empty word."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


_BLOCK = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
    ("sizes", pa.list_(pa.int64())), ("tokens", pa.binary()), ("words", pa.list_(pa.string())),
    ("counts", pa.list_(pa.int64())),
])


def pack(tokens: np.ndarray) -> bytes:
    """Numbers below 2^32 as planes of bytes, the lowest first: the others hardly take space."""
    return tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


BLOCKS = (
    "block long, doc_id array<long>, held array<boolean>, sizes array<long>, tokens binary, "
    "words array<string>, counts array<long>"
)


def _block(number: int, rows: list[tuple], words: Numbers) -> pa.RecordBatch:
    """Documents (doc_id, held out, tokens) as one row, with the training counts of its words."""
    ids, held, tokens = zip(*rows, strict=True)
    taught = [t for t, h in zip(tokens, held, strict=True) if not h] or [np.zeros(0, np.int32)]
    cells = (
        number, list(ids), list(held), [len(t) for t in tokens],
        pack(np.concatenate(tokens)), [w.decode() for w in words],
        np.bincount(np.concatenate(taught), minlength=len(words)),
    )
    return pa.RecordBatch.from_arrays(
        [pa.array([c], f.type) for c, f in zip(cells, _BLOCK, strict=True)], schema=_BLOCK
    )


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts to blocks: words lower-cased in A to Z, and an end after each text."""
    numbers = count(TaskContext.get().partitionId() << 32)
    rows, words, total = [], Numbers({b"": 0}), 0
    for batch in batches:
        for part in _parts(batch):
            for doc_id, held, text in zip(*(part.column(c) for c in ("doc_id", "held_out", "text")), strict=True):
                found = (text.as_py() or "").encode().lower().split()
                tokens = np.zeros(len(found) + 1, np.int32)
                tokens[:-1] = np.fromiter(map(words.__getitem__, found), np.int32, count=len(found))
                rows.append((doc_id.as_py(), held.as_py(), tokens))
                total += len(tokens)
                if total >= BLOCK_TOKENS:
                    yield _block(next(numbers), rows, words)
                    rows, words, total = [], Numbers({b"": 0}), 0
    if rows:
        yield _block(next(numbers), rows, words)


def _rare_class(times: Column) -> Column:
    """A number from a count's size (1, 2 to 3, then powers of four) and a word's ending; null for none."""
    bits = F.length(F.bin(times))
    size = F.when(bits <= 2, bits).otherwise(F.floor((bits + 1) / 2) + 1)
    ending = (
        F.when(F.octet_length("word") != F.length("word"), 0)
        .when(F.substring("word", -1, 1).between("a", "m"), 1)
        .when(F.substring("word", -1, 1).between("n", "z"), 2).otherwise(3)
    )
    return F.when(times > 0, size * ENDINGS + ending)


@dataclass
class Model:
    """Classes and weights. ``outer`` tells classes apart, ``inner`` the words of a frequent one."""

    train_tokens: int
    vocabulary: int
    frequent: dict[str, int]  # word: class number among the frequent ones * MEMBERS + member
    rare: dict[int, int]  # what _rare_class says: class
    log_total: np.ndarray  # per class: log of its words' counts, 0 for NEW
    outer_bias: np.ndarray
    inner_bias: np.ndarray  # frequent class x member, -inf where there is none
    outer: np.ndarray
    inner: np.ndarray

    @property
    def first_frequent(self) -> int:
        return len(self.rare) + 1

    @classmethod
    def untrained(cls, counts: DataFrame, tokens: int, vocabulary: int) -> Model:
        """Classes and their shares of ``counts`` (c, top, own, loo), a row a word; no weights yet."""
        # At most FREQUENT words, and as many classes as counts have bits, times ENDINGS.
        top = counts.where("top is not null").select("top", "c").collect()
        top.sort(key=lambda r: (-r.c, r.top))
        shares = counts.where("top is null").groupBy("own", "loo").agg(F.sum("c").alias("n")).collect()
        own, loo = Counter(), Counter()
        for r in shares:
            own[r.own] += r.n
            loo[r.loo] += r.n
        rare = {name: i + 1 for i, name in enumerate(sorted((own.keys() | loo.keys()) - {None}))}
        frequent = {r.top: i for i, r in enumerate(top)}
        groups = -(-len(top) // MEMBERS)
        members = np.zeros(groups * MEMBERS)
        members[:len(top)] = [r.c for r in top]
        members = members.reshape(groups, MEMBERS)
        mass = np.r_[loo.get(None, 0), [loo.get(n, 0) for n in rare], members.sum(axis=1)].astype(float)
        totals = np.r_[1, [own.get(n, 1) for n in rare], np.ones(groups)].astype(float)
        with np.errstate(divide="ignore"):
            inner = np.log(members / members.sum(axis=1, keepdims=True))
        return cls(
            tokens, vocabulary, frequent, rare, np.log(totals),
            np.log((mass + 0.5) / (mass + 0.5).sum()).astype(np.float32), inner.astype(np.float32),
            np.zeros((ROWS, len(mass)), np.float32), np.zeros((ROWS, MEMBERS), np.float32),
        )

    def steps(self, target: np.ndarray, member: np.ndarray, past: np.ndarray, slopes: bool = True):
        """Softmax of both factors: (log P(class), its gradient, rows) and the same of members.

        ``past`` are the symbols of the three words before, ``member`` is -1 in rare classes.
        Without ``slopes`` the gradients are None.
        """
        rows = features(past)
        outer = _softmax(self.outer_bias[None, :], None, self.outer, rows, target, slopes)
        some = np.flatnonzero(member >= 0)
        group = target[some] - self.first_frequent
        own_rows = features(past[:, some], group + 1)
        inner = _softmax(self.inner_bias, group, self.inner, own_rows, member[some], slopes)
        return (*outer, rows), some, (*inner, own_rows)


def features(past: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    """Hashed rows of the history: last word, last two, second last, third last."""
    one, two, three = past.astype(np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        kinds = (one, one * np.uint64(65_537) + two, two, three)
        out = []
        for i, value in enumerate(kinds):
            x = (value * np.uint64(8) + np.uint64(i + 1) + (np.asarray(salt).astype(np.uint64) << np.uint64(44))) * odd
            x ^= x >> np.uint64(29)
            x *= odd
            out.append(((x >> np.uint64(40)) % np.uint64(ROWS)).astype(np.uint16))
    return np.array(out).reshape(FEATURES, -1)


def _softmax(bias, which, table, rows, target, slopes=True):
    """Natural log of the target's chance per token, and chances minus the target (or None).

    ``which`` names each token's row of ``bias``; without it the only row is everyone's.
    """
    n, width = rows.shape[1], table.shape[1]
    logp = np.empty(n, np.float32)
    out = np.empty((n if slopes else min(n, CHUNK), width), np.float32)
    added = np.empty((min(n, CHUNK), width), np.float32)
    ones = np.ones(width, np.float32)

    def fill(logits, part):
        if which is None:
            logits[:] = bias
        else:
            bias.take(which[part], axis=0, out=logits, mode="clip")
        for own in rows[:, part]:
            logits += table.take(own, axis=0, out=added[:len(logits)], mode="clip")

    for start in range(0, n, CHUNK):
        part = slice(start, min(start + CHUNK, n))
        logits = out[part] if slopes else out[:part.stop - start]
        at, own = np.arange(len(logits)), target[part]
        fill(logits, part)
        high = not logits.max() < HIGH
        if not high:
            wanted = logits[at, own]
            np.exp(logits, out=logits)
            total = logits @ ones
            high = not total.min() > LOW
            if high:
                fill(logits, part)
        if high:
            logits -= logits.max(axis=1, keepdims=True)
            wanted = logits[at, own]
            np.exp(logits, out=logits)
            total = logits @ ones
        logp[part] = wanted - np.log(total)
        if slopes:
            logits /= total[:, None]
            logits[at, own] -= 1
    return logp, out if slopes else None


def _sums(gradient: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that occur in ``own`` and the sum of the gradients of each one's tokens."""
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    times = np.diff(np.r_[first, len(own)])
    longest = np.argsort(-times, kind="stable")
    first, times = first[longest], times[longest]
    sums = gradient.take(order[first], axis=0)
    many = int(np.searchsorted(-times, -FEW))  # the rows before have more tokens than FEW
    for i in range(many):
        gradient.take(order[first[i]:first[i] + times[i]], axis=0).sum(axis=0, out=sums[i])
    for k in range(1, FEW):
        end = int(np.searchsorted(-times, -k))  # the rows before have more than k
        if end <= many:
            break
        sums[many:end] += gradient.take(order[first[many:end] + k], axis=0)
    return ranked[first], sums


def _descend(table: np.ndarray, squares: np.ndarray, gradient: np.ndarray, rows: np.ndarray) -> None:
    """A step of the weights in ``rows``, shortened by the squares of a row's gradients so far."""
    if not gradient.size:
        return
    for own in rows:
        touched, sums = _sums(gradient, own)
        squares[touched] += np.einsum("ij,ij->i", sums, sums)
        sums *= (RATE / np.sqrt(squares[touched]))[:, None]
        table[touched] -= sums


@dataclass
class Ready:
    """A block as training and scoring read it; arrays over documents, tokens or words."""

    sizes: np.ndarray
    tokens: np.ndarray
    own: np.ndarray  # class of each word
    loo: np.ndarray  # its class if one occurrence is left out
    member: np.ndarray  # place in a frequent class, -1 in others
    within: np.ndarray  # log P(word | class) in other classes

    def past(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols of the three words before each token; 0 before the text."""
        place = np.arange(len(symbols)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        return np.array([
            np.where(place >= k, np.r_[np.zeros(k, symbols.dtype), symbols[:-k]][:len(symbols)], 0)
            for k in (1, 2, 3)
        ])

    def history(self, first_frequent: int, left_out: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, member and past symbols of each token."""
        target = (self.loo if left_out else self.own)[self.tokens]
        member = self.member[self.tokens]
        # 0 is before the text, then the classes, then the frequent words.
        symbol = np.where(member >= 0, 1024 + (target - first_frequent) * MEMBERS + member, 1 + target)
        return target, member, self.past(symbol)


_READY = "doc_id array<long>, held array<boolean>, sizes array<long>, tokens binary, own binary, loo binary, member binary, within binary, known array<long>, base array<double>"


def _prepare(block: pd.DataFrame, known: pd.DataFrame, model: Model) -> pd.DataFrame:
    """A block with what the corpus says of its words."""
    block = block.iloc[0]
    known = known.sort_values("at")
    c = known["c"].to_numpy(np.int64)
    sizes = np.asarray(block["sizes"], np.int64)
    tokens = unpack(block["tokens"])
    top = np.array([-1 if w is None else model.frequent[w] for w in known["top"]])
    own, loo = (
        np.array([NEW if pd.isna(x) else model.rare[int(x)] for x in known[name]], np.int64)
        for name in ("own", "loo")
    )
    inside = np.where(c > 0, np.log(np.maximum(c, 1)) - model.log_total[own], 0.0)
    frequent = top >= 0
    group = model.first_frequent + top // MEMBERS
    starts = np.cumsum(sizes) - sizes
    scale = model.train_tokens + model.vocabulary + 1
    word_base = np.log10((c + 1) / scale)
    return pd.DataFrame([{
        "doc_id": block["doc_id"], "held": block["held"], "sizes": block["sizes"], "tokens": block["tokens"],
        "own": np.where(frequent, group, own).astype("<i2").tobytes(),
        "loo": np.where(frequent, group, loo).astype("<i2").tobytes(),
        "member": np.where(frequent, top % MEMBERS, -1).astype("<i2").tobytes(),
        "within": np.where(frequent, 0.0, inside).astype("<f4").tobytes(),
        "known": np.add.reduceat((c > 0).astype(np.int64)[tokens], starts),
        "base": np.add.reduceat(word_base[tokens], starts),
    }])


def _ready(batch: pa.RecordBatch) -> Iterator[tuple[dict, Ready]]:
    for row in batch.to_pylist():
        yield row, Ready(
            np.array(row["sizes"], np.int64), unpack(row["tokens"]),
            np.frombuffer(row["own"], "<i2").astype(np.int32), np.frombuffer(row["loo"], "<i2").astype(np.int32),
            np.frombuffer(row["member"], "<i2").astype(np.int32), np.frombuffer(row["within"], "<f4"),
        )


def train(ready: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Rounds of gradient updates from shared weights, averaged by the tokens of each task.

    In round r every block teaches with its documents r, r + rounds, ...; held-out ones
    never do. What comes to the driver is one set of weights, of fixed size.
    """
    spark = ready.sparkSession
    narrow = ready.select("held", "sizes", "tokens", "own", "loo", "member", "within").coalesce(
        -(-model.train_tokens // TASK_TOKENS)
    )
    width = model.outer.shape[1] + model.inner.shape[1]
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def update(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            outer, inner = own.outer.copy(), own.inner.copy()
            mine = Model(**{**own.__dict__, "outer": outer, "inner": inner})
            squares = np.full((2, ROWS), START, np.float32)
            seen = 0
            for batch in batches:
                for row, block in _ready(batch):
                    held = np.array(row["held"])
                    teaches = ~held & (np.arange(len(held)) % rounds == turn)
                    target, member, past = block.history(own.first_frequent, True)
                    chosen = np.flatnonzero(np.repeat(teaches, block.sizes))
                    seen += len(chosen)
                    for at in range(0, len(chosen), BATCH):
                        some = chosen[at:at + BATCH]
                        (_, g, rows), _, (_, g2, rows2) = mine.steps(target[some], member[some], past[:, some])
                        _descend(outer, squares[0], g, rows)
                        _descend(inner, squares[1], g2, rows2)
            if seen:
                change = np.concatenate([outer - own.outer, inner - own.inner], axis=1).astype("<f2")
                step = ROWS // SLICES
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(SLICES)), pa.array([seen] * SLICES),
                        pa.array([change[i * step:(i + 1) * step].tobytes() for i in range(SLICES)]),
                    ], names=["slice", "seen", "change"],
                )

        def average(frame: pd.DataFrame) -> pd.DataFrame:
            total = 0.0
            frame = frame.sort_values(["seen", "change"])  # the same sum in every run
            for seen, change in zip(frame["seen"], frame["change"], strict=True):
                total = total + np.frombuffer(change, "<f2").astype(np.float64) * seen
            out = (total / frame["seen"].sum()).astype("<f4")
            return pd.DataFrame({"slice": frame["slice"].iloc[:1], "change": [out.tobytes()]})

        changes = narrow.mapInArrow(
            update, "slice long, seen long, change binary"
        ).groupBy("slice").applyInPandas(average, "slice long, change binary").collect()
        shared.destroy()
        if changes:
            parts = sorted((r["slice"], r["change"]) for r in changes)
            change = np.frombuffer(b"".join(c for _, c in parts), "<f4").reshape(ROWS, width)
            split = model.outer.shape[1]
            model.outer = model.outer + change[:, :split]
            model.inner = model.inner + change[:, split:]
    return model


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(ready: DataFrame, model: Model) -> DataFrame:
    shared = ready.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for row, block in _ready(batch):
                target, member, past = block.history(own.first_frequent, False)
                logp = block.within[block.tokens].astype(np.float64)
                for at in range(0, len(target), BATCH):
                    part = slice(at, at + BATCH)
                    (p, _, _), some, (q, _, _) = own.steps(target[part], member[part], past[:, part], False)
                    logp[part] += p
                    logp[at + some] += q
                score = np.add.reduceat(logp, np.cumsum(block.sizes) - block.sizes) / np.log(10)
                n = len(block.sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_id"], pa.int64()), pa.array(row["held"], pa.bool_()),
                        pa.array(block.sizes), pa.array(row["known"], pa.int64()),
                        pa.array(np.full(n, own.train_tokens, np.int64)), pa.array(row["base"], pa.float64()),
                        pa.array(score),
                    ], names=[c.split()[0] for c in _SCORES.split(", ")],
                )

    return ready.mapInArrow(score, _SCORES)


def fit(docs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Model]:
    """Blocks of all rows, ready to be scored, and the model that those not held out teach."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    blocks = stage(
        docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(read, BLOCKS), "blocks"
    )
    sizes = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    tokens = blocks.agg(F.coalesce(F.sum(sizes), F.lit(0))).first()[0]
    # One shuffle by word gives every block the counts of its words. No word is hot here: it
    # has at most one row a block, among the many thousand of the block's other words.
    everywhere = Window.partitionBy("w.words")
    each = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select(
        "block", "at", F.col("w.words").alias("word"), F.sum("w.counts").over(everywhere).alias("c"),
        (F.min("block").over(everywhere) == F.col("block")).alias("first"),
    )
    frequent = (F.col("c") > 0) & (F.col("c") * FREQUENT >= tokens)
    rare = F.when(~frequent, F.col("c"))
    known = stage(each.select(
        "block", "at", "c", "first", F.when(frequent, F.col("word")).alias("top"),
        _rare_class(rare).alias("own"), _rare_class(rare - 1).alias("loo"),
    ), "counts")
    vocabulary = known.where("first and c > 0").count()
    model = Model.untrained(known.where("first and c > 0"), tokens, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ready = stage(
        blocks.drop("counts", "words").groupBy("block").cogroup(
            known.select(F.col("block").alias("of"), "at", "c", "top", "own", "loo").groupBy("of")
        ).applyInPandas(lambda b, k: _prepare(b, k, shared.value), _READY), "ready",
    )
    return ready, train(ready, model, rounds) if tokens else model


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) by a model of the rows not held out.

    Held out is crc32(doc_id as text) mod 7 = 2; a row without doc_id is not. Tokens are the
    words ``[^\\x20\\x09-\\x0D]+`` with A to Z lower-cased and one end; null and empty texts
    are an end alone. Returns doc_id, held_out, n_tokens, n_known (tokens that occur in the
    training rows), train_tokens, base_score (add-one unigrams) and score (log10 of the
    model's chance of the text, where all words never seen are one event, as in the base).
    Without any training row that event has the chance 1. Repeated rows teach and are scored
    each. Other columns are ignored, an empty table gives an empty one.

    Counts cover all training rows and words. The driver holds the frequent words (at most
    FREQUENT) and two weight tables of fixed size.
    """
    return _scored(*fit(docs, rounds))
