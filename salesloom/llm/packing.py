"""Packing token sequences: shortest pack first over the histogram of lengths.

Documents are cut into pieces of at most one sequence. The histogram of piece lengths is
small whatever the corpus, so the plan is made once: lengths from long to short, each into
the packs with most room, counting packs that hold the same lengths as one pattern. The
pieces of a length are then numbered, and a piece's number says which pack of which
pattern it goes to.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _parts, ranked, stage

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_TRAILING = b".,;:!?&$%#*\"()[]{}-+=_/\\|<>@^~`"


class Encoder(dict):
    """Word to token ids (little-endian uint32 bytes), remembered for ``limit`` words.

    The tokenizer cuts a text at the strings of its added tokens, as they are written;
    between them it treats the words between ASCII white space one by one and lower-cases
    them, so a text's ids are its words' ids in a row.
    """

    def __init__(self, path: str, limit: int = 1 << 19):
        from tokenizers import Tokenizer

        super().__init__()
        self.limit = limit
        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.marks = sorted(added, reverse=True)
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, self.marks)) + b")")
        # Kept apart from words, which hold no line break.
        self.added = {b"\n" + t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.tokenizer.encode_special_tokens = True  # words hold none as it is written
        self.model = self.tokenizer.model if self._takes_letters_as_they_are() else None

    def _takes_letters_as_they_are(self) -> bool:
        """Whether lower-case ASCII letters reach the model unchanged and as one piece."""
        normalizer, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        same = normalizer is None or normalizer.normalize_str(_LETTERS) == _LETTERS
        return same and (cutter is None or [w for w, _ in cutter.pre_tokenize_str(_LETTERS)] == [_LETTERS])

    def _parts(self, text: bytes) -> list[bytes]:
        """Words and, as they are, added tokens."""
        if not any(t in text for t in self.marks):
            return text.lower().split()
        return [
            w for i, part in enumerate(self.cut.split(text))
            for w in ([b"\n" + part] if i % 2 else part.lower().split())
        ]

    def __missing__(self, word: bytes) -> bytes:
        head = word.rstrip(_TRAILING)
        tail = word[len(head):]
        if word in self.added:
            ids = self.added[word]
        elif head and tail and head.decode().isalpha():
            ids = self[head] + self[tail]  # letters and marks never share a token
        elif self.model and word.isalpha():  # ASCII letters; nothing but the model acts on them
            ids = np.array([t.id for t in self.model.tokenize(word.decode())], "<u4").tobytes()
        else:
            found = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
            ids = np.array(found, "<u4").tobytes()
        if len(self) >= self.limit:
            self.clear()
        self[word] = ids
        return ids

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text."""
        own = self.__getitem__
        return [b"".join(map(own, self._parts(t.encode()))) if t else b"" for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """Tokenise every whole text once and cut it every ``capacity`` ids.

    ``tokenizer`` is a path that every executor has. A null text is an empty one: only the
    end id. Repeated rows are cut each.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in (part for whole in batches for part in _parts(whole, 4 << 20)):
            rows = []
            for i, ids in enumerate(own.ids(batch.column("text").to_pylist())):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start:4 * (start + capacity)]
                    rows.append((i, start, len(part) // 4, zlib.crc32(part), n))
            columns = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(columns[0])), *map(pa.array, columns[1:])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )
        # The worker goes on to other work, and workers that wait would keep their words as well.
        own.clear()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns (count, lengths): how many sequences hold pieces of which lengths.

    ``histogram`` maps a length to its number of pieces. Work and result depend on the
    number of different lengths, not on the number of pieces.
    """
    packs: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # by room left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in packs if packs[r]), default=0)
            if room < length:  # not even the shortest pack has room
                packs[capacity - length].append((left, [length]))
                break
            count, lengths = packs[room].pop()
            used = min(count, left)
            if count > used:
                packs[room].append((count - used, lengths))
            packs[room - length].append((used, [*lengths, length]))
            left -= used
    return [pattern for room in sorted(packs) for pattern in packs[room]]


def slots(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted by length and rank."""
    ranks: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, ranks[length], sequence, offset))
            ranks[length] += count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Give every piece (PIECES) its ``sequence_id`` and ``offset``.

    No piece is dropped, each sequence holds at most ``capacity`` ids without gaps between
    its pieces. An empty table gives an empty one. Only the histogram (at most ``capacity``
    rows) comes to the driver, and the slots made of it go to the tasks.
    """
    cut = stage(cut, "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    where = cut.sparkSession.sparkContext.broadcast(slots(plan(histogram, capacity)))
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]

    span = max([1, *histogram.values()])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = where.value
        keys = table[:, 0] * span + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            arrays = [batch.column(c) for c in columns]
            arrays += [pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "sequence_id", "offset"])

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return ranked(cut, ["length"], order, "rank").select(*columns, "rank").mapInArrow(
        place, f"{PIECES}, sequence_id long, offset long"
    )
