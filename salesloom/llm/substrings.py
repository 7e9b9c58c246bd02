"""Repeated passages, found with a compressed FM-index per shard.

Every window of consecutive words is assigned to its anchor, the smallest hash among the
short word groups in it, so equal windows have equal anchors. Anchors that occur once need
no search. The stretches of text around the others are collapsed: equal ones become one,
which weighs as many places as it has. What is left is dealt to shards by anchor; an anchor
with too many different stretches for a shard is split by a second anchor, made of groups
that cover a whole window, and its windows are collapsed again. A shard sorts its stretches
into an index: the Burrows-Wheeler transform in a wavelet matrix of packed bits. Backward
search then streams each stretch from its end, one word at a time, and keeps the interval
of the last words up to the window's length: its weight is the number of places where they
occur. Windows in more than one place are reported, whatever way their stretch came.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import WordHashes, extend, join_hot, stage, text_key, words_of
from .jaccard import _mix

WINDOW = 35
#: Words of the groups that anchors are chosen from.
GROUP = 8
#: Stretches per shard, on average.
SHARD_STRETCHES = 4_096
#: An anchor with more different stretches than this is split by a second one.
HOT_ANCHOR = 256
EMPTY = hashlib.sha256(b"").hexdigest()

_ODD = np.uint64(0x9E3779B97F4A7C15)


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (anchor, first window, last window) of hashed words."""
    n = len(hashes)
    if n < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    value = np.zeros(n - GROUP + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(GROUP):
            value = (value ^ hashes[i:n - GROUP + 1 + i]) * _ODD
            value ^= value >> np.uint64(29)
    value = _mix(value)
    # The place in the low half makes the leftmost of equal hashes the smallest.
    least = (value & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(value), dtype=np.uint64)
    width, wanted = 1, WINDOW - GROUP + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wanted:
        least = np.minimum(least[:width - wanted], least[wanted - width:])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    return value[place[first]].view(np.int64), first, last


_POWERS = [np.ones(1, np.uint64)] * 2
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 14)
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def runs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`anchors` with a hash of the words of each run's stretch: (anchor, stretch, first, last)."""
    anchor, first, last = anchors(hashes)
    if not len(first):
        return anchor, anchor, first, last
    up, down = _powers(len(hashes) + 1)
    with np.errstate(over="ignore"):
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(hashes * up[:len(hashes)], dtype=np.uint64)]
        value = (sums[last + WINDOW] - sums[first]) * down[first]
        value = _mix(value + (last - first).astype(np.uint64) * _ODD)
    return anchor, value.view(np.int64), first, last


class WaveletMatrix:
    """A sequence of symbols as one packed bit vector per bit, with ranks by symbol."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for bit in range(self.bits - 1, -1, -1):
            ones = ((symbols >> bit) & 1).astype(bool)
            padded = np.zeros((len(ones) // 64 + 1) * 64, bool)
            padded[:len(ones)] = ones
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.before.append(np.cumsum(counts) - counts)
            self.zeros.append(len(ones) - int(ones.sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` elements' share of ``symbols`` ends in the last order.

        The rank of a symbol is the difference to ``descend(symbol, 0)``.
        """
        for level in range(self.bits):
            word, offset = at >> 6, (at & 63).astype(np.uint64)
            below = (np.uint64(1) << offset) - np.uint64(1)
            ones = self.before[level][word] + np.bitwise_count(self.words[level][word] & below)
            bit = (symbols >> (self.bits - 1 - level)) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-preserving ranks of pairs."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].reshape(-1)


def _ahead(ranks: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([ranks[by:], np.zeros(min(by, len(ranks)), ranks.dtype)])


class FMIndex:
    """Backward search over stretches of words, given as symbols from 1, each with a weight."""

    def __init__(self, stretches: list[np.ndarray], window: int, weights: list[int] | None = None):
        self.window = window
        text = np.concatenate([x for s in stretches for x in (s, [0])]).astype(np.int64)
        # Sorted by the first words only: as far as any search will look.
        ranks, width = _pairs(text, np.zeros_like(text)), 1
        while 2 * width <= window:
            ranks, width = _pairs(ranks, _ahead(ranks, width)), 2 * width
        exact = _pairs(ranks, _ahead(ranks, window - width)) if width < window else ranks
        order = np.argsort(_pairs(ranks, _ahead(ranks, width)), kind="stable")
        self.matrix = WaveletMatrix(text[order - 1])
        symbols = np.arange(int(text.max()) + 1)
        counts = np.bincount(text, minlength=len(symbols))
        self.base = np.cumsum(counts) - counts - self.matrix.descend(
            symbols, np.zeros(len(symbols), np.int64)
        )
        # Rows that agree in the first ``window`` words: where their run begins and ends.
        run = exact[order]
        edge = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        number = np.cumsum(np.r_[True, run[1:] != run[:-1]]) - 1
        self.first, self.end = edge[number], np.r_[edge[1:], len(run)][number]
        self.size = len(text)
        # Weight of all rows before each.
        each = np.repeat(weights or [1] * len(stretches), [len(s) + 1 for s in stretches])
        self.weight = np.r_[0, np.cumsum(each[order])]

    def counts(self, stretches: list[np.ndarray]) -> list[np.ndarray]:
        """Matching statistics: in how many places each window of each stretch occurs.

        All stretches advance together, from their ends to their beginnings.
        """
        lengths = np.array([len(s) for s in stretches])
        out = [np.zeros(max(0, n - self.window + 1), np.int64) for n in lengths]
        flat = np.concatenate(stretches)
        ends = np.cumsum(lengths)
        found = np.zeros(len(flat), np.int64)
        low = np.zeros(len(stretches), np.int64)
        high = np.full(len(stretches), self.size)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero(lengths > step)
            at = ends[live] - 1 - step
            symbol = flat[at]
            both = self.matrix.descend(np.r_[symbol, symbol], np.r_[low[live], high[live]])
            low[live] = self.base[symbol] + both[:len(live)]
            high[live] = self.base[symbol] + both[len(live):]
            if step >= self.window:  # one word more than a window: let go of the last one
                row = low[live]
                low[live], high[live] = self.first[row], self.end[row]
            if step >= self.window - 1:
                found[at] = self.weight[high[live]] - self.weight[low[live]]
        for i, n in enumerate(lengths):
            if n >= self.window:
                out[i] = found[ends[i] - n:ends[i] - self.window + 1]
        return out


def _covered(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The stretches of words that windows at sorted ``starts`` cover, as (start, end)."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > window)
    return list(zip(
        starts[np.r_[0, gap + 1]].tolist(), (starts[np.r_[gap, len(starts) - 1]] + window).tolist(),
        strict=True,
    ))


def _search(frame: pd.DataFrame) -> pd.DataFrame:
    """Index the pieces of one shard and report the repeated intervals of each."""
    symbols: dict[bytes, int] = {}
    pieces = [
        np.array([symbols.setdefault(w, len(symbols) + 1) for w in s.split(b" ")], np.int64)
        for s in frame["words"]
    ]
    found = FMIndex(pieces, WINDOW, frame["weight"].tolist()).counts(pieces)
    rows = []
    for key, piece, n, counts in zip(frame["key"], frame["piece"], frame["n"], found, strict=True):
        rows += [(key, piece, n, a, b) for a, b in _covered(np.flatnonzero(counts > 1), WINDOW)]
    return pd.DataFrame(rows, columns=["key", "piece", "n", "start", "end"], dtype="int64")


def _read(docs: DataFrame) -> DataFrame:
    def make():
        hashes = WordHashes()

        def read(text):
            words = words_of(text)
            sha = hashlib.sha256(b" ".join(words)).hexdigest()
            if len(words) < WINDOW:
                return len(words), sha, None, None, None
            anchor, stretch, _, _ = runs(hashes.array(words))
            order = np.lexsort((stretch, anchor))
            anchor, stretch = anchor[order], stretch[order]
            first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (stretch[1:] != stretch[:-1])])
            times = np.diff(np.r_[first, len(anchor)])
            return (
                len(words), sha, anchor[first].tobytes(), stretch[first].tobytes(),
                times.astype("<i4").tobytes(),
            )

        return read

    return extend(
        docs.select("doc_id", "dk", "th", "text"), "text", make,
        "n_words long, sha string, anchors binary, stretches binary, times binary",
    )


def _places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each different stretch of a text and how often it is there."""
    for frame in frames:
        sizes = [len(a) // 8 for a in frame["anchors"]]
        yield pd.DataFrame({
            "id": np.repeat(frame["id"].to_numpy(), sizes),
            "anchor": np.frombuffer(b"".join(frame["anchors"]), np.int64),
            "stretch": np.frombuffer(b"".join(frame["stretches"]), np.int64),
            "times": np.frombuffer(b"".join(frame["times"]), "<i4"),
        })


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of each wanted stretch, or its windows one by one where its anchor is split."""
    hashes = WordHashes()
    for frame in frames:
        rows = []
        for text, wanted in zip(frame["text"], frame["wanted"], strict=True):
            words = words_of(text)
            where = {}
            for a, s, first, last in zip(*(x.tolist() for x in runs(hashes.array(words))), strict=True):
                where.setdefault((a, s), (first, last))
            for r in wanted:
                own = r["anchor"], r["stretch"]
                first, last = where[own]
                if not r["split"]:
                    rows.append((*own, 0, *own, r["weight"], False, b" ".join(words[first:last + WINDOW])))
                    continue
                for at in range(first, last + 1):
                    window = b" ".join(words[at:at + WINDOW])
                    two = np.frombuffer(xxhash.xxh3_128_digest(window), np.int64).tolist()
                    rows.append((*own, at - first, *two, r["weight"], True, window))
        yield pd.DataFrame(rows, columns=["anchor", "stretch", "at", "key", "piece", "weight", "split", "words"])


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for frame in frames:
        rows = []
        for doc, text, found in zip(frame["id"], frame["text"], frame["found"], strict=True):
            words = words_of(text)
            spans = {(r["anchor"], r["stretch"]): r["spans"] for r in found}
            starts, ends = [], []
            for a, s, first in zip(*(x.tolist() for x in runs(hashes.array(words))[:3]), strict=True):
                for span in spans.get((a, s), ()):
                    starts.append(first + span["start"])
                    ends.append(first + span["end"])
            gone = np.bincount(starts, minlength=len(words) + 1) - np.bincount(ends, minlength=len(words) + 1)
            keep = np.cumsum(gone)[:-1] == 0
            kept = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
            rows.append((
                doc, len(words) - int(keep.sum()), hashlib.sha256(kept).hexdigest(),
                kept.decode(),
            ))
        yield pd.DataFrame(rows, columns=["id", "n_removed", "kept_sha256", "kept_text"])


def repeats(
    docs: DataFrame, hot: int = HOT_ANCHOR, per_shard: int = SHARD_STRETCHES
) -> DataFrame:
    """Remove every word covered by a window of WINDOW words that also starts elsewhere.

    Returns per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256
    (of the kept words joined by one space) and, for rows that lose some but not all words,
    kept_text; it is null where nothing is removed and empty where everything is. dk and th
    identify the row. Windows are judged on the whole input, the same document included.
    Words are ``[^\\x20\\x09-\\x0D]+`` unchanged; null and empty texts have none, shorter
    texts than a window lose nothing. Rows with equal words are indexed once: if they have
    a window, all their words go. Other columns are ignored, an empty table gives an empty
    one.

    ``hot`` only decides whether an anchor's different stretches meet in one shard or are
    split by a second anchor first; it changes no result.
    """
    keyed = docs.select(
        "doc_id", "text", F.xxhash64("doc_id", F.lit(1)).alias("dk"), text_key().alias("th")
    )
    rows = stage(_read(keyed), "words")
    texts = stage(
        rows.where(F.col("n_words") >= WINDOW).groupBy("sha").agg(
            F.count("*").alias("copies"), F.min(F.struct("dk", "th")).alias("who"),
            *[F.first(c).alias(c) for c in ("n_words", "anchors", "stretches", "times")],
        ).select(
            F.monotonically_increasing_id().alias("id"), "sha", "copies", "who.dk", "who.th",
            "n_words", "anchors", "stretches", "times",
        ), "texts",
    )
    # Texts that occur more than once are gone already, but others may repeat their parts.
    places = texts.select("id", "anchors", "stretches", "times").mapInPandas(
        _places, "id long, anchor long, stretch long, times int"
    )
    often = stage(
        places.groupBy("anchor").agg(F.sum("times").alias("all"), F.count("*").alias("n"))
        .where(F.col("all") > 1).drop("all"), "often",
    )
    total = often.agg(F.sum("n")).first()[0] or 0
    shared = stage(join_hot(places, often, "anchor", "n", total).drop("n"), "shared")
    distinct = stage(
        shared.groupBy("anchor", "stretch").agg(
            F.sum("times").alias("weight"), F.count("*").alias("rows"), F.min("id").alias("id")
        ), "distinct",
    )
    variety = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"))
    number = distinct.count()
    split = (F.col("kinds") > hot).alias("split")
    wanted = join_hot(distinct, variety, "anchor", "kinds", number).groupBy("id").agg(
        F.collect_list(F.struct("anchor", "stretch", "weight", split)).alias("wanted")
    )
    text_of = keyed.select("dk", "th", "text")

    def with_text(found: DataFrame) -> DataFrame:
        """Rows by id with their whole texts; repeated rows of a document come once."""
        who = found.join(texts.select("id", "dk", "th", "copies"), "id")
        return text_of.join(who, ["dk", "th"]).dropDuplicates(["dk", "th"])

    pieces = stage(
        with_text(wanted).select("text", "wanted").mapInPandas(
            _pieces, "anchor long, stretch long, at int, key long, piece long, weight long, split boolean, words binary"
        ), "pieces",
    )
    one = pieces.where(~F.col("split")).select("key", "piece", "weight", F.lit(1).cast("long").alias("n"), "words")
    windows = pieces.where("split").groupBy("key", "piece").agg(
        F.sum("weight").alias("weight"), F.count("*").alias("n"), F.first("words").alias("words")
    )
    shards = max(1, -(-pieces.count() // per_shard))
    indexed = stage(
        one.unionByName(windows)
        .groupBy(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
        .applyInPandas(_search, "key long, piece long, n long, start long, end long"), "intervals",
    )
    # Windows of split anchors go back to the stretches that they come from.
    parts = pieces.where("split").select("anchor", "stretch", "at", "key", "piece")
    back = join_hot(parts, indexed.select("key", "piece", "n"), ["key", "piece"], "n", parts.count()).select(
        "anchor", "stretch", F.col("at").cast("long").alias("start"), (F.col("at") + WINDOW).cast("long").alias("end")
    )
    plain = indexed.join(distinct.select("anchor", "stretch"), (F.col("key") == F.col("anchor")) & (F.col("piece") == F.col("stretch")))
    spans = plain.select("anchor", "stretch", "start", "end").unionByName(back).groupBy("anchor", "stretch").agg(
        F.collect_list(F.struct("start", "end")).alias("spans")
    )
    judged = spans.join(distinct.select("anchor", "stretch", "rows"), ["anchor", "stretch"])
    found = join_hot(
        shared.select("id", "anchor", "stretch"), judged, ["anchor", "stretch"], "rows", shared.count()
    ).groupBy("id").agg(F.collect_list(F.struct("anchor", "stretch", "spans")).alias("found"))
    cut = with_text(found).where("copies = 1").select("id", "text", "found").mapInPandas(
        _cut, "id long, n_removed long, kept_sha256 string, kept_text string"
    )
    alike = F.col("copies") > 1
    known = stage(
        texts.select("id", "sha", "copies", "n_words").join(cut, "id", "left").select(
            "sha", "copies",
            F.when(alike, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
            .cast("long").alias("n_removed"),
            F.when(alike, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha"))
            .alias("kept_sha256"),
            F.when(alike, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        ), "known",
    )
    long = rows.where(F.col("n_words") >= WINDOW).select("doc_id", "dk", "th", "n_words", "sha")
    short = rows.where(F.col("n_words") < WINDOW).select(
        "doc_id", "dk", "th", "n_words", F.lit(0).cast("long").alias("n_removed"),
        F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"),
    )
    return join_hot(long, known, "sha", "copies", rows.count()).select(
        *short.columns
    ).unionByName(short)
