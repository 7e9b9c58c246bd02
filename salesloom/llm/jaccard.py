"""Set similarity join of word shingles by chosen paths.

A document is the set of its five-word shingles, represented by minwise hashes: two sets
agree in a coordinate with the probability of their Jaccard similarity. Starting from all
sets, every node of a tree chooses a few coordinates and splits its sets on the shared
values found there; the same path leads the same sets together. Small nodes are compared
pair by pair, large ones split on, and independent trees are grown until the chance to
miss a pair is below the target. What was found together is then verified on the whole
shingle sets, all pairs of a candidate component against each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import (
    BLOCK, WordHashes, blockwise, components, extend, join_hot, join_salted, match_pairs, stage,
    text_key, words_of,
)

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Chance to meet a pair at the threshold, over all trees.
RECALL = 0.9999
#: Coordinates of the minwise representation, and levels after which a node splits no more.
COORDINATES, DEPTH = 128, 4
#: Standard deviations that an estimate may fall short of the threshold.
MARGIN = 4.5

_ODD = np.uint64(0x9E3779B97F4A7C15)
_COINS = np.random.default_rng(20_240_117).integers(1, 2**32, (2, COORDINATES), np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit value of each 64-bit value."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        for shift in (np.uint64(32), np.uint64(29)):
            x ^= x >> shift
            x *= _ODD
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray) -> np.ndarray:
    """The distinct shingles of hashed words; a shorter text is one shingle."""
    if not len(words):
        return words
    k = min(SHINGLE_WORDS, len(words))
    value = np.full(len(words) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            value = (value ^ words[i:len(words) - k + 1 + i]) * _ODD
            value ^= value >> np.uint64(31)
    return np.unique(_mix(value))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Minwise hashes of a set; sets agree in each with the chance of their similarity."""
    x = (tokens ^ (tokens >> np.uint64(32))).astype(np.uint32)
    factor, shift = (_COINS[0] | np.uint32(1))[:, None], _COINS[1][:, None]
    least = np.full(COORDINATES, 2**32 - 1, np.uint32)
    for start in range(0, len(x), 4096):
        part = x[start:start + 4096] ^ shift
        part *= factor
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x85EBCA6B)
        np.minimum(least, part.min(axis=1), out=least)
    return least


def trees(recall: float, threshold: float) -> int:
    """How many trees let a pair at the threshold meet in a node with the chance ``recall``.

    A node chooses one coordinate, and a second with the chance 1 / threshold - 1, so that
    a pair shares one child on average; the chance to share all levels follows by level.
    """
    extra, meets = min(1.0, 1 / threshold - 1), 1.0
    for _ in range(DEPTH):
        child = threshold * meets
        meets = (1 - extra) * child + extra * (1 - (1 - child) ** 2)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def split(nodes: np.ndarray, sketches: np.ndarray, threshold: float) -> list[tuple]:
    """Child paths of sets in nodes: (rows, paths) for the first and the second coordinate."""
    out = []
    rows = np.arange(len(nodes))
    for turn, chance in ((1, 1.0), (2, min(1.0, 1 / threshold - 1))):
        dice = _mix(nodes + np.uint64(turn * 0x51ED27))
        own = rows[(dice >> np.uint64(40)).astype(float) / 2**24 < chance]
        coordinate = (dice[own] % np.uint64(COORDINATES)).astype(np.int64)
        value = sketches[own, coordinate].astype(np.uint64)
        paths = _mix(_mix(nodes[own] ^ (value << np.uint64(8))) + coordinate.astype(np.uint64))
        out.append((own, paths.view(np.int64)))
    return out


def _matrix(cells: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), -1)


def _represent(docs: DataFrame) -> DataFrame:
    def make():
        hashes = WordHashes()

        def represented(text):
            tokens = shingles(hashes.array(words_of(text)))
            if not len(tokens):
                return None, 0, None
            return xxhash.xxh3_128_digest(tokens.tobytes()), len(tokens), sketch(tokens).tobytes()

        return represented

    return extend(
        docs.select("doc_id", "dk", "th", "text"), "text", make,
        "digest binary, size long, sketch binary",
    )


def _grow(sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Rows (gid, id) of the nodes in which sets are compared."""
    roots = _mix(np.arange(1, trees(recall, threshold) + 1, dtype=np.uint64))

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sketches, ids = _matrix(frame["sketch"], np.uint32), frame["id"].to_numpy()
            for root in roots:
                nodes = np.full(len(ids), root, np.uint64)
                for own, paths in split(nodes, sketches, threshold):
                    yield pd.DataFrame({"gid": paths, "id": ids[own]})

    def further(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            nodes = frame["gid"].to_numpy(np.int64).view(np.uint64)
            ids = frame["id"].to_numpy()
            for own, paths in split(nodes, _matrix(frame["sketch"], np.uint32), threshold):
                yield pd.DataFrame({"gid": paths, "id": ids[own]})

    done = None
    level = stage(sets.select("id", "sketch").mapInPandas(first, "gid long, id long"), "paths")
    for depth in range(1, DEPTH + 1):
        sizes = stage(level.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        shared = stage(join_hot(level, sizes, "gid", "n", level.count()), "nodes")
        final = shared if depth == DEPTH else shared.where(F.col("n") <= BLOCK)
        done = final if done is None else done.unionByName(final)
        large = shared.where(F.col("n") > BLOCK)
        if depth == DEPTH or large.isEmpty():
            break
        level = stage(
            large.join(sets.select("id", "sketch"), "id").select("gid", "id", "sketch")
            .mapInPandas(further, "gid long, id long"), "paths",
        )
    return done.select("gid", "id")


def _similar_sketches(threshold: float):
    """Pairs whose estimate is not below the threshold by more than chance explains."""
    slack = MARGIN * math.sqrt(threshold * (1 - threshold) / COORDINATES)
    least = (threshold - slack) * COORDINATES

    def match(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        left = _matrix(a["payload"], np.uint8)
        right = left if b is None else _matrix(b["payload"], np.uint8)
        agree = np.array([(right == row).sum(axis=1) for row in left])
        return match_pairs(a, b, agree >= least, counts=False)

    return match


def _similar_sets(threshold: float):
    """Pairs whose whole shingle sets reach the threshold."""

    def match(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        cells = list(a["payload"]) + ([] if b is None else list(b["payload"]))
        tokens = [np.frombuffer(c, np.uint64) for c in cells]
        sizes = np.array([len(t) for t in tokens])
        owner = np.repeat(np.arange(len(tokens)), sizes)
        _, column, seen = np.unique(
            np.concatenate(tokens), return_inverse=True, return_counts=True
        )
        keep = seen[column] > 1  # a token of one set alone is in no intersection
        owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
        n, na = len(tokens), len(a)
        cut = np.s_[:na], np.s_[:n] if b is None else np.s_[na:]
        common = np.zeros((na, n if b is None else n - na), np.float32)
        width = 4096
        by_part = np.argsort(column // width, kind="stable")
        owner, column = owner[by_part], column[by_part]
        edges = np.searchsorted(
            column // width, np.arange(int(column.max(initial=-1)) // width + 2)
        )
        for part, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            has = np.zeros((n, width), np.float32)
            has[owner[lo:hi], column[lo:hi] - part * width] = 1
            common += has[cut[0]] @ has[cut[1]].T
        union = sizes[cut[0]][:, None] + sizes[cut[1]][None, :] - common
        return match_pairs(a, b, common >= threshold * union - 1e-6, counts=True)

    return match


def _tokens(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The whole shingle sets of the sets in ``wanted``, read again from their documents."""

    def make():
        hashes = WordHashes()
        return lambda text: (shingles(hashes.array(words_of(text))).tobytes(),)

    # Repeated rows of one doc_id and text are the same set once.
    texts = docs.select("dk", "th", "text").join(wanted, ["dk", "th"])
    distinct = texts.dropDuplicates(["dk", "th"]).select("gid", "id", "weight", "text")
    return extend(distinct, "text", make, "payload binary")


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Classes of documents linked by similar shingle sets, over whole texts.

    Returns per row of ``docs`` (doc_id, text): doc_id, class_id (smallest doc_id reachable
    by links), n_links (rows linked to it directly, copies included) and kept (whether it
    is the row that stands for its class). Words are ``[^\\x20\\x09-\\x0D]+`` unchanged; a
    text of one to four words is one shingle. A text without words, empty or null, links
    with nothing and is its own class. Rows with equal sets are one set that counts often;
    repeated rows therefore cost nothing and link with each other. Other columns are
    ignored, an empty table gives an empty one.
    """
    keyed = docs.select(
        "doc_id", "text", F.xxhash64("doc_id", F.lit(1)).alias("dk"), text_key().alias("th")
    )
    rows = stage(_represent(keyed), "shingled")
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "dk", "th")
    sets = rows.where("digest is not null").groupBy("digest").agg(
        F.min(who).alias("who"), F.count("*").alias("weight"), F.first("sketch").alias("sketch")
    )
    sets = stage(sets.select(
        F.monotonically_increasing_id().alias("id"), "digest", "weight", "sketch", "who.doc_id",
        "who.dk", "who.th",
    ), "sets")

    def narrow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cells = _matrix(frame.pop("sketch"), np.uint32).astype(np.uint8)
            yield frame.assign(payload=[row.tobytes() for row in cells])

    brief = sets.select("id", "sketch").mapInPandas(narrow, "id long, payload binary")
    found = blockwise(
        _grow(sets, threshold, recall).join(brief, "id"), _similar_sketches(threshold),
        "u long, v long, links long",
    )
    candidates = components(found.select("u", "v")).select(
        F.col("node").alias("id"), F.col("component").alias("gid")
    )
    wanted = sets.select("id", "weight", "dk", "th").join(candidates, "id")
    verified = stage(blockwise(
        _tokens(keyed, wanted), _similar_sets(threshold), "u long, v long, links long"
    ), "links")
    links = verified.where("u = v").groupBy(F.col("u").alias("id")).agg(
        F.sum("links").alias("links")
    )
    member = stage(components(verified.where("u <> v").select("u", "v")).join(
        sets.select(F.col("id").alias("node"), who.alias("who")), "node"
    ), "members")
    first = member.groupBy("component").agg(F.min("who").alias("first"))
    classes = join_salted(member, first, "component", "node").select(
        F.col("node").alias("id"), F.col("first.doc_id").alias("class_id"),
        (F.col("who") == F.col("first")).alias("is_first"),
    )
    known = stage(
        sets.select("id", "digest", "weight", "doc_id", "dk", "th")
        .join(classes, "id", "left").join(links, "id", "left")
        .select(
            "digest", "weight", F.col("dk").alias("rep_dk"), F.col("th").alias("rep_th"),
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("is_first", F.lit(True)).alias("is_first"),
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        ), "known",
    )
    worded = rows.where("digest is not null").select("doc_id", "dk", "th", "digest")
    stands = (
        F.col("is_first") & (F.col("dk") == F.col("rep_dk")) & (F.col("th") == F.col("rep_th"))
    )
    linked = join_hot(worded, known, "digest", "weight", rows.count()).select(
        "doc_id", "dk", "th", "class_id", "n_links", stands.alias("kept")
    )
    alone = rows.where("digest is null").select(
        "doc_id", "dk", "th", F.col("doc_id").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"),
    )
    return linked.unionByName(alone)
