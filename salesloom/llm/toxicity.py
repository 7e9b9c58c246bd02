"""Toxicity by compression distance.

Zstandard dictionaries are trained on toxic and on ordinary text. A window of a few words
is compressed with both; toxic wording shows as a shorter result under the toxic
dictionary. Both dictionaries end in the same base, trained on ordinary text, and start
with a part trained on what one class says and the other does not, so wording that the
classes share costs the same under both and cancels out. Thresholds on the windows'
differences become a score by a logistic fit on labelled documents that trained neither
dictionary.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import extend

#: Labelled documents that are fitted on, per class: half train the dictionaries and half
#: set the thresholds. The documented bound of the sample.
SAMPLE_PER_CLASS = 2_400
#: Words of a window, and bytes after which a longer word is cut into several.
WINDOW_WORDS, WORD_BYTES = 8, 64
#: Bytes of the shared base, of each class's own parts, and how many of these there are: each
#: is trained on a split of its own, so that what one training leaves out another holds.
BASE_BYTES, OWN_BYTES, OWN_PARTS = 112 << 10, 4 << 10, 2
#: Pieces of the base that windows begin with in turn. They cost the same under both
#: dictionaries, but shift where a length is rounded to whole bytes, so that the mean over a
#: text's windows tells apart what a single byte does not.
LEADS = 4
#: Windows count as toxic wording from so many bytes of difference.
STEPS = (2, 4)
#: zstd needs some bytes after the last match; every window gets the same ones.
TAIL = b" ........ "

_WORD = re.compile(r"\w+")


@dataclass
class Model:
    """Two dictionaries and the logistic weights; without them, one constant score."""

    toxic: bytes = b""
    ordinary: bytes = b""
    weights: np.ndarray | None = None
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    constant: float = 0.0
    _pair: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def differences(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window; no window without words."""
        if self._pair is None:
            self._pair = _compressor(self.ordinary), _compressor(self.toxic)
        ordinary, toxic = self._pair
        places = (-200 - 40 * i for i in range(LEADS))
        leads = [self.ordinary[at:at + 9 + 3 * i] for i, at in enumerate(places)]
        led = [leads[i % LEADS] + w for i, w in enumerate(windows(text))]
        return np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in led], float)

    def features(self, text: str | None) -> np.ndarray:
        d = self.differences(text)
        if not len(d):
            return np.zeros(4 + len(STEPS))
        top = np.sort(d)[::-1]
        return np.array([
            d.mean(), np.clip(d, -4, 8).mean(), top[0], top[:4].mean(),
            *[(d >= s).mean() - (d <= -s).mean() for s in STEPS],
        ])

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.constant
        x = (self.features(text) - self.center) / self.scale
        z = np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)
        return float(1 / (1 + np.exp(-z)))


def windows(text: str | None) -> list[bytes]:
    """Runs of WINDOW_WORDS words, without overlap, lower-cased."""
    if not text:
        return []
    words = text.lower().encode().split()
    if any(len(w) > WORD_BYTES for w in words):
        words = [w[i:i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]
    return [
        b" " + b" ".join(words[i:i + WINDOW_WORDS]) + TAIL
        for i in range(0, len(words), WINDOW_WORDS)
    ]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    # A thorough search: what both dictionaries hold is then found in both.
    how = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=17, chain_log=17, search_log=5, min_match=4, target_length=24,
        strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_checksum=0,
        write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    book = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    book.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=book, compression_params=how)


def _vocabulary(text: str) -> list[str]:
    return list(dict.fromkeys(_WORD.findall(text.lower())))


def _train(texts: list[bytes], size: int, segment: int) -> bytes:
    """A zstd dictionary; the texts themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, texts, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(texts))[-size:]


def _own_words(mine: list[str], other: list[str]) -> list[bytes]:
    """Texts of a class without the words that the other class uses about as often."""
    seen, seen_other = Counter(), Counter()
    for counter, texts in ((seen, mine), (seen_other, other)):
        for text in texts:
            counter.update(set(_vocabulary(text)))
    own = {
        w for w, n in seen.items()
        if n >= 3 and (seen_other[w] + 0.5) / max(len(other), 1) < 0.2 * n / len(mine)
    }
    kept = (" ".join(w for w in _WORD.findall(t.lower()) if w in own) for t in mine)
    return [f" {t} ".encode() for t in kept if len(t) > 6]


def fit(
    rows: list[tuple[str | None, int]], sizes: tuple[int, int] | None = None
) -> Model:
    """A model from (text, label) rows. One class alone gives a constant score.

    Texts without a word teach nothing. Even rows train the dictionaries, odd rows set
    the thresholds, so the order of rows should be random. ``sizes`` are the numbers of
    ordinary and toxic rows that ``rows`` were drawn from: each class weighs as much as it
    has rows there, so the cut does not depend on how many of them were drawn.
    """
    classes = [[t for t, y in rows if y == label and t and t.split()] for label in (0, 1)]
    ordinary, toxic = classes
    if min(len(ordinary), len(toxic)) < 4:
        return Model(constant=float(bool(toxic) and not ordinary))
    learn = [c[0::2] for c in classes]
    vocabulary = [_vocabulary(t) for t in learn[0]]
    lines = [
        f" {' '.join(v[i:i + 40])} ".encode() for v in vocabulary for i in range(0, len(v), 40)
    ]
    base = _train(lines, BASE_BYTES, 24)
    said = [_own_words(learn[y], learn[1 - y]) for y in (0, 1)]
    own = [
        b"".join(_train(t[i::OWN_PARTS], OWN_BYTES, 16)[-OWN_BYTES:] for i in range(OWN_PARTS)) for t in said
    ]
    model = Model(toxic=own[1] + base, ordinary=own[0] + base)
    held = [(t, y) for y in (0, 1) for t in classes[y][1::2]]
    x = np.array([model.features(t) for t, _ in held])
    y = np.array([y for _, y in held], float)
    sizes = [max(n, len(c)) for n, c in zip(sizes or (0, 0), classes, strict=True)]
    weight = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
    weight /= weight.mean()
    model.center = np.average(x, axis=0, weights=weight)
    model.scale = np.sqrt(np.average((x - model.center) ** 2, axis=0, weights=weight)) + 1e-9
    model.weights = _logistic((x - model.center) / model.scale, y, weight)
    return model


def _logistic(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2
) -> np.ndarray:
    """Ridge logistic regression of weighted rows (1 on average) by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * len(x) * np.eye(x.shape[1]) / 10
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, x.T @ (weight * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _known(labels: DataFrame) -> DataFrame:
    """The labels to learn from: (doc_id, label)."""
    return labels.where("toxic in (0, 1) and doc_id is not null").select(
        "doc_id", F.col("toxic").alias("label")
    ).where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def class_sizes(docs: DataFrame, labels: DataFrame) -> tuple[int, int]:
    """Ordinary and toxic rows with words that the sample is drawn from, all counted."""
    rows = docs.select("doc_id", "text").where(F.col("text").rlike(r"(?U)\S")).groupBy(
        "doc_id"
    ).agg(F.count("*").alias("rows"))
    marks = _known(labels).groupBy("doc_id", "label").agg(F.count("*").alias("marks"))
    found = marks.join(rows, "doc_id").groupBy("label").agg(
        F.sum(F.col("rows") * F.col("marks")).alias("n")
    ).collect()
    sizes = {r["label"]: r["n"] for r in found}
    return sizes.get(0, 0), sizes.get(1, 0)


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[str | None, int]]:
    """The bounded labelled sample, in an order given by a hash.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out. The first SAMPLE_PER_CLASS
    rows of each class by the hash of doc_id are taken; null labels and null texts teach
    nothing.
    """
    known = _known(labels)
    picked = [
        known.where(F.col("label") == y)
        .orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(2 * SAMPLE_PER_CLASS)
        for y in (0, 1)
    ]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # at most 4 * SAMPLE_PER_CLASS ids
    joined = docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id")
    rows = []
    for y in (0, 1):
        order = (F.xxhash64("doc_id", F.lit(7)), "doc_id", F.xxhash64("text"))
        rows += joined.where(F.col("label") == y).orderBy(*order).limit(
            SAMPLE_PER_CLASS
        ).select("text", "label").collect()
    return [(r.text, r.label) for r in rows]


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the sample of the labelled rows that are not held out, at their true odds."""
    return fit(training_rows(docs, labels), class_sizes(docs, labels))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) over its whole text.

    Null and empty texts have no window and get the score of a text without differences.
    Repeated rows are scored each. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def scored(text):
            value = shared.value.score(text)
            return value, int(value >= 0.5)

        return scored

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return extend(
        docs.select("doc_id", "text", held_out.alias("held_out")), "text", make,
        "score double, predicted int",
    )


def keep_ordinary(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all columns, that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [shared.value.score(t.as_py()) < 0.5 for t in batch.column("text")]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows that are not held out, score all rows."""
    return score(docs, learn(docs, labels))
