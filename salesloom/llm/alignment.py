"""Alignment of two tokenizers over the same bytes, by an associative monoid of fragments.

Both tokenizers end a token before a space that follows something other than white space,
so a text falls into units there, and a unit's tokens depend on nothing around it. A range
of a document's bytes is a fragment: an open prefix up to its first such place, the closed
groups of the units between, and an open suffix from the last one on. Two neighbours
compose by closing what the left one's suffix and the right one's prefix hold together, and
because that is associative, the fragments of a very long document are made in many tasks
and reduced as a tree.

Inside a unit, byte offsets where tokens of both sides end cut groups; the stretches between
neighbouring ends of either side are the links, for each lies in one token of either side.
Counts of linked id pairs are added up over the corpus and come back to blocks of documents,
one row for each pair and block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import _parts, join_hot, stage

#: Bytes of a fragment; longer documents are cut into several.
FRAGMENT_BYTES = 1 << 16
#: Fragments that one step of the tree composes.
FAN = 8
#: Units of a block of documents, beyond which a new one begins.
BLOCK_UNITS = 1 << 18
#: Units that a worker remembers, bytes of text that it handles at once, and units that one
#: call of the tokenizers encodes.
REMEMBERED, PART_BYTES, CALL_UNITS = 1 << 18, 1 << 20, 2_048

# A space ends a unit unless white space (ASCII, then Unicode in UTF-8) stands before it.
_CUT = re.compile(
    rb"(?<![\x00-\x20\x7f])(?<!\xc2\x85)(?<!\xc2\xa0)(?<!\xe1\x9a\x80)"
    rb"(?<!\xe2\x80[\x80-\x8a\xa8\xa9\xaf])(?<!\xe2\x81\x9f)(?<!\xe3\x80\x80) "
)
#: Without any of these in a text, every space ends a unit.
_UNSAFE = (
    b"  ", b"\n ", b"\t ", b"\r ", b"\x0b ", b"\x0c ", b"\x1c ", b"\x1d ", b"\x1e ", b"\x1f ",
    b"\x00 ", b"\x7f ", b"\xc2\x85 ", b"\xc2\xa0 ", b"\xe1\x9a\x80 ", b"\xe2\x80", b"\xe2\x81\x9f ",
    b"\xe3\x80\x80 ",
)
#: Bytes that must be known in front of a space to judge it.
_CONTEXT = 3


def units(span: bytes) -> list[bytes]:
    """The units of a span that begins and ends where units do, without the space each begins with."""
    text = span[1:]
    if not text.startswith(b" ") and not any(x in text for x in _UNSAFE):
        return text.split(b" ")
    cuts = [m.start() for m in _CUT.finditer(span) if m.start()]
    return [span[a + 1:b] for a, b in zip([0, *cuts], [*cuts, len(span)], strict=True)]


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin characters stand for themselves, the other bytes take the characters
    from U+0100 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = count(0x100)
    return {chr(b if b in plain else next(free)): b for b in range(256)}


class Aligner:
    """Units to what is known of them: token counts, groups as text, pairs of linked ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = _byte_of_char()
        size = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        self.bytes_a = [b""] * size
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(byte[c] for c in token if c in byte)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.len_a = np.array([len(x) for x in self.bytes_a])
        self.len_b = np.array([len(x) for x in self.bytes_b])
        self.space = self.b.piece_to_id("▁")
        #: A pair of ids as one number: id of a times this, plus id of b.
        self.radix = len(self.bytes_b)
        self.kind = np.dtype("<u4" if len(self.bytes_a) * self.radix < 2**32 else "<u8")
        #: ids as text with each mark that may stand in front.
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.texts = np.array([[f"{m}{i}".encode() for i in range(most)] for m in ("", ";", "|", ",")], object)
        self.forget()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.groups: list[bytes] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self._numbers = np.zeros((0, 5), np.int64)
        self._pairs = np.zeros(0, self.kind)
        self._starts = np.zeros(1, np.int64)

    def _settle(self) -> None:
        """Put what was learnt bit by bit into whole arrays."""
        if self.parts:
            self._numbers = np.concatenate([self._numbers, *(n for n, _ in self.parts)])
            self._pairs = np.concatenate([self._pairs, *(p for _, p in self.parts)])
            self._starts = np.r_[0, np.cumsum(self._numbers[:, 3])]
            self.parts = []

    @property
    def numbers(self) -> np.ndarray:
        """Per unit: tokens of a and b, groups, links, and whether the bytes agree."""
        self._settle()
        return self._numbers

    def look_up(self, wanted: list[bytes]) -> np.ndarray:
        """Numbers of units, after learning those that are new."""
        known = self.known
        fresh = [u for u in dict.fromkeys(wanted) if u not in known]
        for start in range(0, len(fresh), CALL_UNITS):
            self._learn(fresh[start:start + CALL_UNITS])
        return np.fromiter(map(known.__getitem__, wanted), np.int64, count=len(wanted))

    def _encode(self, units: list[bytes]) -> tuple[list[int], list[int]] | None:
        """Ids of units one after another; None if their bytes are not given back."""
        span = b" " + b" ".join(units)
        text = span.decode()
        a = self.a.encode(text, add_special_tokens=False).ids
        b = self.b.encode(text[1:], num_threads=1) if len(text) > 1 else [self.space]
        if b"".join([self.bytes_a[i] for i in a]) == span == b"".join([self.bytes_b[i] for i in b]):
            return a, b
        return None

    def _learn(self, fresh: list[bytes]) -> None:
        # Units that do not end in white space are encoded together: every space between
        # them begins a unit.
        plain = [u for u in fresh if u and not u.decode()[-1].isspace()]
        together = self._encode(plain) if plain else None
        if together is None:
            good, alone = [], fresh
        else:
            good, alone = plain, [u for u in fresh if not u or u.decode()[-1].isspace()]
        a, b = together or ([], [])
        a, b, good, bad = list(a), list(b), list(good), []
        for unit in alone:
            found = self._encode([unit])
            if found is None:
                bad.append(unit)
                continue
            a += found[0]
            b += found[1]
            good.append(unit)
        order = good + bad
        numbers = np.zeros((len(order), 5), np.int64)
        numbers[:len(good), 4] = 1
        groups = [b""] * len(order)
        links = np.zeros(0, self.kind)
        if good:
            links = self._align(a, b, np.array([len(u) + 1 for u in good]), numbers, groups)
        self.known.update(zip(order, range(len(self.groups), len(self.groups) + len(order)), strict=True))
        self.parts.append((numbers, links))
        self.groups += groups

    def _align(self, a, b, sizes, numbers, groups) -> np.ndarray:
        """Fill in ``numbers`` and ``groups`` of the first units; all units' linked pairs."""
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        good = np.arange(len(sizes))
        # All units one after another: both sides cover the same bytes.
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        unit_ends = np.cumsum(sizes)
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        cuts = np.union1d(ends_a, ends_b)
        unit_of = lambda ends: np.searchsorted(unit_ends, ends)
        for column, ends in enumerate((ends_a, ends_b, common, cuts)):
            numbers[good, column] = np.bincount(unit_of(ends), minlength=len(good))
        # Tokens in the order of group and side, each with the mark in front of it.
        group = np.r_[np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)]
        side = np.repeat([0, 1], [len(a), len(b)])
        ids, ends = np.r_[a, b], np.r_[ends_a, ends_b]
        order = np.lexsort((ends, side, group))
        group, side, ids, unit = group[order], side[order], ids[order], unit_of(ends[order])
        new_group = np.r_[True, group[1:] != group[:-1]]
        new_unit = np.r_[True, unit[1:] != unit[:-1]]
        mark = np.where(new_group, 1, np.where(np.r_[False, side[1:] != side[:-1]], 2, 3))
        mark[new_unit] = 0
        texts = self.texts[mark, ids].tolist()
        edges = [*np.flatnonzero(new_unit).tolist(), len(texts)]
        for i, start, end in zip(good.tolist(), edges[:-1], edges[1:], strict=True):
            groups[i] = b"".join(texts[start:end])
        linked = a[np.searchsorted(ends_a, cuts)] * self.radix + b[np.searchsorted(ends_b, cuts)]
        return linked.astype(self.kind)

    def gather(self, found: np.ndarray) -> np.ndarray:
        """The linked pairs of units, one after another."""
        sizes = self.numbers[found, 3]
        ends = np.cumsum(sizes)
        shift = np.repeat(self._starts[found] - (ends - sizes), sizes)
        return self._pairs[np.arange(len(shift)) + shift]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


@dataclass
class Fragment:
    """A range of a document's bytes: open prefix, closed groups, open suffix.

    Without a place where a unit begins it is all prefix (``tail`` is None).
    """

    head: bytes
    tail: bytes | None = None
    numbers: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))
    fine: bool = True
    groups: bytes = b""
    pairs: bytes = b""

    @classmethod
    def of(cls, own: Aligner, span: bytes) -> Fragment:
        """The fragment of raw bytes; spaces at its very beginning cannot be judged yet."""
        cuts = [m.start() for m in _CUT.finditer(span) if m.start() >= _CONTEXT]
        if not cuts:
            return cls(span)
        out = cls(span[:cuts[0]], span[cuts[-1]:])
        return out if cuts[0] == cuts[-1] else out._close(own, span[cuts[0]:cuts[-1]])

    def _close(self, own: Aligner, span: bytes, before: bool = False) -> Fragment:
        """Add the groups of a span of whole units, behind or before those already closed."""
        if not span:
            return self
        found = own.look_up(units(span))
        text = b";".join([own.groups[i] for i in found.tolist()])
        pairs = own.gather(found).tobytes()
        halves = [(self.groups, self.pairs), (text, pairs)]
        (g1, p1), (g2, p2) = halves[::-1] if before else halves
        totals = own.numbers[found].sum(axis=0)
        return Fragment(
            self.head, self.tail, self.numbers + totals[:4],
            self.fine and bool(own.numbers[found, 4].all()),
            b";".join(x for x in (g1, g2) if x), p1 + p2,
        )

    def compose(self, own: Aligner, right: Fragment) -> Fragment:
        """The fragment of both ranges; associative."""
        if self.tail is None:
            middle = Fragment.of(own, self.head + right.head)
            if right.tail is None:
                return middle
            if middle.tail is None:
                return Fragment(middle.head, right.tail, right.numbers, right.fine, right.groups, right.pairs)
            # right.head ends where a unit does, so the middle's tail is whole units.
            out = Fragment(middle.head, right.tail, right.numbers, right.fine, right.groups, right.pairs)
            return out._join_before(middle._close(own, middle.tail))
        span = self.tail + right.head
        if right.tail is not None:
            out = self._close(own, span)
            closed = Fragment(out.head, right.tail, out.numbers, out.fine, out.groups, out.pairs)
            return closed._join_behind(right)
        cuts = [m.start() for m in _CUT.finditer(span) if m.start()]
        last = cuts[-1] if cuts else 0
        out = self._close(own, span[:last])
        return Fragment(out.head, span[last:], out.numbers, out.fine, out.groups, out.pairs)

    def _join_before(self, left: Fragment) -> Fragment:
        return Fragment(
            self.head, self.tail, left.numbers + self.numbers, left.fine and self.fine,
            b";".join(x for x in (left.groups, self.groups) if x), left.pairs + self.pairs,
        )

    def _join_behind(self, right: Fragment) -> Fragment:
        return Fragment(
            self.head, self.tail, self.numbers + right.numbers, self.fine and right.fine,
            b";".join(x for x in (self.groups, right.groups) if x), self.pairs + right.pairs,
        )

    def whole(self, own: Aligner) -> Fragment:
        """The document of this fragment: its beginning and end close what is open."""
        return self._close(own, self.head, before=True)._close(own, self.tail or b"")


_NO_LINKS = np.zeros(0, np.int64)
_NOTHING = np.zeros(4, np.int64), ""

_BLOCK = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("numbers", pa.binary()),
    ("sha", pa.list_(pa.string())), ("sizes", pa.binary()), ("units", pa.binary()),
    ("links", pa.binary()), ("pairs", pa.binary()),
])
BLOCKS = (
    "block long, doc_id array<long>, numbers binary, sha array<string>, sizes binary, "
    "units binary, links binary, pairs binary"
)


def _block(number: int, docs: list[tuple], sizes, units, links, pairs) -> pa.RecordBatch:
    """Documents (doc_id, numbers, sha) as one row.

    ``sizes`` says how many units each has, ``units`` numbers them within the block, and
    each of the block's units has ``links`` of its ``pairs``.
    """
    ids, numbers, sha = zip(*docs, strict=True)
    cells = (
        number, list(ids), np.array(numbers, "<i8").tobytes(), list(sha),
        *(np.asarray(x, "<u4").tobytes() for x in (sizes, units, links)), pairs.tobytes(),
    )
    return pa.RecordBatch.from_arrays(
        [pa.array([c], f.type) for c, f in zip(cells, _BLOCK, strict=True)], schema=_BLOCK
    )


def _short(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Blocks of documents that are one fragment each."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        numbers = count(TaskContext.get().partitionId() << 32)
        rows, sizes, found = [], [], []

        def block() -> pa.RecordBatch:
            units, place = np.unique(np.concatenate([*found, _NO_LINKS]), return_inverse=True)
            return _block(next(numbers), rows, sizes, place, own.numbers[units, 3], own.gather(units))

        for batch in batches:
            for part in _parts(batch, PART_BYTES):
                texts = part.column("text").to_pylist()
                split = [units(b" " + t.encode()) if t else [] for t in texts]
                at = own.look_up([u for s in split for u in s])
                edges = np.cumsum([0, *map(len, split)])
                sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(own.numbers[at], axis=0)])
                sums = sums[edges[1:]] - sums[edges[:-1]]
                names = list(map(own.groups.__getitem__, at.tolist()))
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    low, high = edges[i], edges[i + 1]
                    if low == high or sums[i, 4] < high - low:
                        rows.append((doc_id, *_NOTHING))
                        sizes.append(0)
                        continue
                    sha = hashlib.sha256(b";".join(names[low:high])).hexdigest()
                    rows.append((doc_id, sums[i, :4], sha))
                    sizes.append(high - low)
                    found.append(at[low:high])
                if sum(sizes) >= BLOCK_UNITS or len(rows) >= BLOCK_UNITS or len(own.known) > REMEMBERED:
                    yield block()
                    rows, sizes, found = [], [], []
                    if len(own.known) > REMEMBERED:
                        own.forget()
        if rows:
            yield block()
        # The worker goes on to other work; its next task learns the frequent units in a moment.
        own.forget()

    return docs.mapInArrow(align, BLOCKS)


_FRAGMENT = "rid long, doc_id long, part long, head binary, tail binary, numbers binary, fine boolean, groups binary, pairs binary"


def _frame(rows: Iterable[tuple[int, int, int, Fragment]]) -> pd.DataFrame:
    return pd.DataFrame(
        [
            (rid, doc_id, part, f.head, f.tail, f.numbers.astype("<i8").tobytes(), f.fine, f.groups, f.pairs)
            for rid, doc_id, part, f in rows
        ],
        columns=["rid", "doc_id", "part", "head", "tail", "numbers", "fine", "groups", "pairs"],
    ).astype({"doc_id": "Int64"})


def _fragment(row) -> Fragment:
    numbers = np.frombuffer(row.numbers, "<i8")
    return Fragment(row.head, row.tail, numbers, bool(row.fine), row.groups, row.pairs)


def _long(docs: DataFrame, paths: tuple[str, str], size: int) -> DataFrame:
    """Blocks of one document each, reduced from fragments of ``size`` bytes."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rid, doc_id, text in zip(frame["rid"], frame["doc_id"], frame["text"], strict=True):
                span = b" " + text.encode()
                for part in range(-(-len(span) // size)):
                    yield pd.DataFrame({
                        "rid": [rid], "doc_id": pd.array([doc_id], "Int64"), "part": [part],
                        "raw": [span[part * size:(part + 1) * size]],
                    })

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                own = aligner(*paths)
                if len(own.known) > REMEMBERED:
                    own.forget()
                yield _frame([(row.rid, row.doc_id, row.part, Fragment.of(own, row.raw))])

    def composed(frame: pd.DataFrame) -> tuple[Aligner, Fragment]:
        own = aligner(*paths)
        if len(own.known) > REMEMBERED:
            own.forget()
        rows = frame.sort_values("part").itertuples()
        return own, reduce(lambda x, y: x.compose(own, y), map(_fragment, rows))

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        return _frame([(first["rid"], first["doc_id"], first["part"] // FAN, composed(frame)[1])])

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        own, f = composed(frame)
        f = f.whole(own)
        doc_id = None if pd.isna(first["doc_id"]) else int(first["doc_id"])
        pairs = np.frombuffer(f.pairs if f.fine else b"", own.kind)
        what = (f.numbers, hashlib.sha256(f.groups).hexdigest()) if f.fine else _NOTHING
        return _block(-1 - int(first["rid"]), [(doc_id, *what)], [1], [0], [len(pairs)], pairs).to_pandas()

    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    raw = stage(numbered.mapInPandas(cut, "rid long, doc_id long, part long, raw binary"), "ranges")
    most, total = raw.agg(F.max("part"), F.count("*")).first()
    spread = raw.repartition(max(1, min(total, 4096)), "rid", "part")
    # A shuffle lies between any two of these steps, and the last one composes and finishes:
    # a task has one Python worker, and so one pair of tokenizers in memory.
    parts = spread.mapInPandas(make, _FRAGMENT)
    most = (most or 0) + 1
    while most > FAN:
        parts = parts.groupBy("rid", F.floor(F.col("part") / FAN).alias("_up")).applyInPandas(compose, _FRAGMENT)
        most = -(-most // FAN)
    return parts.groupBy("rid").applyInPandas(finish, BLOCKS)


def _block_pairs(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of each block and how often they are linked there."""
    for batch in batches:
        # A batch may hold many blocks of megabytes: they are read where they lie, one by one.
        for i, block in enumerate(batch.column("block").to_pylist()):
            pairs, links, places = (
                np.frombuffer(batch.column(c)[i].as_buffer(), k)
                for c, k in (("pairs", kind), ("links", "<u4"), ("units", "<u4"))
            )
            times = np.bincount(places, minlength=len(links))
            found, at = np.unique(pairs, return_inverse=True)
            number = np.bincount(at, weights=np.repeat(times, links), minlength=len(found))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(found), block)), pa.array(found.astype(np.int64)),
                    pa.array(number.astype(np.int64)),
                ], names=["block", "pair", "links"],
            )


def align(docs: DataFrame, path_a: str, path_b: str, fragment_bytes: int = FRAGMENT_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with what its alignment amounts to.

    Side a is a byte-level vocabulary over space and text, side b a sentence-piece model
    that puts the space in front itself; strings of special tokens are plain text. Both
    paths must exist on every executor. Returns doc_id, n_a, n_b, n_groups, n_links, n_best
    (links whose pair is linked most often, over all documents, among those of its b id),
    count_sum (the links' pair counts) and groups_sha256. Null and empty texts, and texts
    whose bytes the tokens do not give back, have zeros and the empty string. Repeated rows
    are aligned and counted each. Other columns are ignored, an empty table gives an empty
    one.

    A worker holds a fragment or a block of documents; a document longer than a fragment is
    aligned by many tasks, and only its composed result is one row again, as its text is.
    """
    paths = path_a, path_b
    own = aligner(*paths)
    kind, radix = own.kind, own.radix
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    long = F.coalesce(F.octet_length("text") >= fragment_bytes, F.lit(False))
    blocks = stage(
        _short(rows.where(~long), paths).unionByName(_long(rows.where(long), paths, fragment_bytes)),
        "aligned", large_rows=True,
    )
    pairs = stage(
        blocks.select("block", "units", "links", "pairs").mapInArrow(lambda b: _block_pairs(b, kind), "block long, pair long, links long"),
        "pairs",
    )
    counts = stage(
        pairs.groupBy("pair").agg(F.sum("links").alias("links"), F.count("*").alias("blocks")), "counts"
    )
    other = F.pmod(F.col("pair"), F.lit(radix)).alias("other")
    # One row for each id of side b: as many as its vocabulary has.
    highest = F.broadcast(counts.groupBy(other).agg(F.max("links").alias("highest")))
    info = counts.select("pair", "blocks", "links", other).join(highest, "other").select(
        "pair", "blocks", F.col("links").alias("total"), (F.col("links") == F.col("highest")).alias("best")
    )
    total = pairs.count()
    known = join_hot(pairs.select("block", "pair"), info, "pair", "blocks", total).select(
        "block", "pair", "total", "best"
    )

    def finish(block: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        block = block.iloc[0]
        known = known.sort_values("pair")
        numbers = np.frombuffer(block["numbers"], "<i8").reshape(-1, 4)
        sizes, units, links = (np.frombuffer(block[c], "<u4").astype(np.int64) for c in ("sizes", "units", "links"))
        at = np.searchsorted(known["pair"].to_numpy(), np.frombuffer(block["pairs"], kind).astype(np.int64))

        def added(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            sums, ends = np.r_[0, np.cumsum(values)], np.cumsum(lengths)
            return sums[ends] - sums[ends - lengths]

        best, total = (added(added(known[c].to_numpy(np.int64)[at], links)[units], sizes) for c in ("best", "total"))
        ids = pd.array([None if pd.isna(i) else int(i) for i in block["doc_id"]], "Int64")
        return pd.DataFrame({
            "doc_id": ids, "n_a": numbers[:, 0], "n_b": numbers[:, 1], "n_groups": numbers[:, 2],
            "n_links": numbers[:, 3], "n_best": best, "count_sum": total, "groups_sha256": list(block["sha"]),
        })

    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(
        finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
        "count_sum long, groups_sha256 string"
    )
