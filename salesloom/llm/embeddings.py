"""Near-duplicate embeddings by spherical-cap filters.

Filter directions are the codewords of random product codes: after a random rotation every
block of coordinates has a few random directions, and a codeword takes one from each block.
A vector passes a filter if its inner product with the codeword exceeds a level; the blocks'
inner products list all passed filters without looking at every codeword. Codewords of one
code are alike, so several codes with rotations of their own are used, as many as two
vectors at the given angle need to pass a common filter with near certainty. Rows that meet
in a filter are compared, and what was found together is verified in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import blockwise, components, join_hot, join_salted, match_pairs, stage

COSINE = 0.93
#: Chance that two vectors at that cosine pass a common filter.
RECALL = 0.9999
#: Rows of the largest label that a filter lets pass, and filters of a code that a vector
#: passes, on average.
BUCKET, PER_CODE = 64, 2.5
BLOCKS = 2
#: Pairs and codes that the number of codes is worked out from.
TRIAL_PAIRS, TRIAL_CODES = 2_000, 4
#: Sums of inner products that are held at once.
CELLS = 1 << 21
SEED = 93


class Caps(NamedTuple):
    """The level of the filters, the directions per block and the number of codes."""

    level: float
    directions: int
    codes: int


class Code:
    """The random product code with this number, the same in every task."""

    def __init__(self, dim: int, cap: Caps, number: int):
        random = np.random.default_rng([SEED, number, dim, cap.directions])
        self.rotation = np.linalg.qr(random.standard_normal((dim, dim)))[0]
        self.cap = cap
        self.parts = [p for p in np.array_split(np.arange(dim), BLOCKS) if len(p)]
        self.words = []
        for part in self.parts:
            words = random.standard_normal((cap.directions, len(part)))
            words /= np.linalg.norm(words, axis=1, keepdims=True) * math.sqrt(len(self.parts))
            self.words.append(words)

    def scores(self, unit: np.ndarray) -> list[np.ndarray]:
        turned = unit @ self.rotation
        return [turned[:, p] @ w.T for p, w in zip(self.parts, self.words, strict=True)]

    def passed(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (row, codeword) with an inner product of at least the level.

        Rows are taken so many at a time that their sums fit CELLS.
        """
        step = max(1, CELLS // self.cap.directions ** len(self.parts))
        found = [self._passed(unit[i:i + step]) for i in range(0, len(unit), step)]
        rows = [at + i * step for i, (at, _) in enumerate(found)]
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *rows]), np.concatenate([empty, *[w for _, w in found]])

    def _passed(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks are taken in turn; a prefix that the best rest cannot lift is left out."""
        scores = self.scores(unit)
        best = [s.max(axis=1) for s in scores]
        rows = np.arange(len(unit))
        word = np.zeros(len(unit), np.int64)
        total = np.zeros(len(unit))
        for i, score in enumerate(scores):
            rest = sum(best[i + 1:], np.zeros(len(unit)))
            sums = total[:, None] + score[rows]
            keep, own = np.nonzero(sums >= self.cap.level - rest[rows][:, None])
            word = word[keep] * self.cap.directions + own
            total, rows = sums[keep, own], rows[keep]
        return rows, word


def _level(code: Code, unit: np.ndarray, passes: float) -> float:
    """The inner product that the part ``passes`` of all (row, codeword) reaches.

    It is the quantile of all of them, found in fixed memory: only the largest ones are
    kept, and a prefix that cannot lead to one of them is left out.
    """
    size = len(unit) * code.cap.directions ** len(code.parts)
    place = (size - 1) * (1 - passes)
    count = size - math.floor(place)
    top, cut = np.zeros(0), -math.inf
    step = max(1, CELLS // code.cap.directions ** len(code.parts))
    for start in range(0, len(unit), step):
        *first, last = code.scores(unit[start:start + step])
        total = np.zeros((len(last), 1))
        for score in first:
            total = (total[:, :, None] + score[:, None, :]).reshape(len(last), -1)
        rows, at = np.nonzero(total + last.max(axis=1)[:, None] >= cut)
        some = max(1, CELLS // last.shape[1])
        for i in range(0, len(rows), some):
            r, c = rows[i:i + some], at[i:i + some]
            sums = total[r, c][:, None] + last[r]
            top = np.concatenate([top, sums[sums >= cut]])
            if len(top) > count:
                top = np.partition(top, len(top) - count)[-count:]
                cut = top.min()
    low, high = np.sort(top)[:2] if count > 1 else (top.max(), top.max())
    return float(low + (high - low) * (place - math.floor(place)))


@lru_cache(maxsize=64)
def caps(rows: int, dim: int, cosine: float, recall: float) -> Caps:
    """Filters for labels of up to ``rows`` vectors: selective enough, and enough of them.

    A filter shall let BUCKET of ``rows`` vectors pass. What level that takes, and how
    often two vectors at the cosine share a filter of one code, is found by trying random
    pairs: the codes are rotated at random, so the chance is the same for every pair, and
    codes miss a pair independently of each other. Takes fixed memory and is worked out on
    the driver; the tasks get the result.
    """
    passes = min(0.25, BUCKET / max(rows, 1))
    directions = max(2, math.ceil((PER_CODE / passes) ** (1 / BLOCKS)))
    random = np.random.default_rng([SEED, dim, directions])
    x, z = (random.standard_normal((TRIAL_PAIRS, dim)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * z
    drafts = [Code(dim, Caps(0, directions, 1), 1_000_000 + i) for i in range(TRIAL_CODES)]
    level = float(np.mean([_level(draft, x, passes) for draft in drafts]))
    met = 0
    for draft in drafts:
        draft.cap = Caps(level, directions, 1)
        size = directions**BLOCKS
        a, b = (rows_ * size + word for rows_, word in (draft.passed(x), draft.passed(y)))
        met += len(np.unique(np.intersect1d(a, b) // size))
    share = min(met / (TRIAL_PAIRS * TRIAL_CODES), 1 - 1e-6)
    codes = math.ceil(math.log(1 - recall) / math.log(1 - max(share, 1e-3)))
    return Caps(level, directions, max(2, codes))


def _unit(cells: pd.Series) -> np.ndarray:
    vectors = np.array([np.asarray(c, np.float64) for c in cells])
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _brief(unit: np.ndarray) -> list[bytes]:
    """A vector in one byte per component, after the scale as a float."""
    scale = (np.abs(unit).max(axis=1) / 127).astype(np.float32)
    cells = np.rint(unit / scale[:, None]).clip(-127, 127).astype(np.int8)
    return [s.tobytes() + c.tobytes() for s, c in zip(scale, cells, strict=True)]


def _may_link(cosine: float):
    """Pairs that reach the cosine within the error of the brief vectors: none is lost."""

    def match(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        def side(frame):
            cells = np.array([np.frombuffer(p, np.int8) for p in frame["payload"]])
            scale = cells[:, :4].copy().view(np.float32)[:, 0].astype(np.float64)
            return cells[:, 4:].astype(np.float32) * scale[:, None].astype(np.float32), scale

        x, s = side(a)
        y, t = (x, s) if b is None else side(b)
        # Rounding moves a vector by at most half a step in each of its components.
        error = 0.51 * math.sqrt(x.shape[1]) * (s[:, None] + t[None, :]) * 1.02 + 1e-5
        return match_pairs(a, b, x @ y.T >= cosine - error, counts=False)

    return match


def _do_link(cosine: float):
    def match(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        x = _unit(a["payload"].map(lambda p: np.frombuffer(p, np.float32)))
        y = x if b is None else _unit(b["payload"].map(lambda p: np.frombuffer(p, np.float32)))
        return match_pairs(a, b, x @ y.T >= cosine, counts=True)

    return match


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL
) -> DataFrame:
    """Links between equally labelled vectors at ``cosine`` or more, and their components.

    ``vectors`` has vec_id, embedding (floats) and label. Returns per row vec_id, n_links,
    component_id (smallest vec_id reachable by links, itself included) and kept. A row
    whose label or vector is null, or whose vector is empty, zero or has null or non-finite
    components, links with nothing and is its own component. Vectors of different length
    never link. Equal vectors with one label are one vector that counts often, so repeated
    rows cost nothing; rows that share a vec_id count as rows each. Other columns are
    ignored, an empty table gives an empty one.
    """
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))
    rows = stage(vectors.select(
        "vec_id", "label", F.col("embedding").cast("array<float>").alias("embedding"),
        usable.alias("usable"),
    ).withColumn("digest", F.md5(F.concat_ws(
        "|", F.col("label").cast("string"), F.col("embedding").cast("string")
    ))), "vectors")
    digested = rows.where("usable")
    sets = stage(
        digested.groupBy("digest").agg(
            F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"),
            F.first("label").alias("label"), F.first("embedding").alias("embedding"),
        ).withColumn("id", F.monotonically_increasing_id())
        .withColumn("dim", F.size("embedding")), "sets",
    )
    sizes = {r["dim"]: r["rows"] for r in sets.groupBy("label", "dim").count().groupBy("dim").agg(
        F.max("count").alias("rows")
    ).collect()}
    largest = max([1, *sizes.values()])
    # A vector alone with its label and length has nothing to meet.
    filter_caps = {dim: caps(largest, dim, cosine, recall) for dim, n in sizes.items() if n > 1}

    def filters(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, list[Code]] = {}
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                if dim not in filter_caps:
                    continue
                if dim not in known:
                    cap = filter_caps[dim]
                    known[dim] = [Code(dim, cap, i) for i in range(cap.codes)]
                for start in range(0, len(part), 512):
                    some = part[start:start + 512]
                    unit = _unit(some["embedding"])
                    brief = np.array(_brief(unit), object)
                    for number, code in enumerate(known[dim]):
                        at, word = code.passed(unit)
                        yield pd.DataFrame({
                            "label": some["label"].to_numpy()[at], "dim": dim,
                            "code": number, "word": word,
                            "id": some["id"].to_numpy()[at], "payload": brief[at],
                        })

    met = sets.select("id", "label", "dim", "embedding").mapInPandas(
        filters, "label long, dim int, code int, word long, id long, payload binary"
    ).select(F.xxhash64("label", "dim", "code", "word").alias("gid"), "id", "payload")
    found = blockwise(met, _may_link(cosine), "u long, v long, links long")
    candidates = components(found.select("u", "v")).select(
        F.col("node").alias("id"), F.col("component").alias("gid")
    )

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cells = frame.pop("embedding")
            yield frame.assign(payload=[np.asarray(c, np.float32).tobytes() for c in cells])

    wanted = sets.select("id", "weight", "embedding").join(candidates, "id").select(
        "gid", "id", "weight", "embedding"
    ).mapInPandas(whole, "gid long, id long, weight long, payload binary")
    verified = stage(
        blockwise(wanted, _do_link(cosine), "u long, v long, links long"), "links"
    )
    links = verified.where("u = v").groupBy(F.col("u").alias("id")).agg(
        F.sum("links").alias("links")
    )
    member = stage(components(verified.where("u <> v").select("u", "v")).join(
        sets.select(F.col("id").alias("node"), "vec_id"), "node"
    ), "members")
    first = member.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    classes = join_salted(member, first, "component", "node").select(
        F.col("node").alias("id"), "component_id"
    )
    known = stage(
        sets.select("id", "digest", "weight", "vec_id")
        .join(classes, "id", "left").join(links, "id", "left")
        .select(
            "digest", "weight", F.coalesce("component_id", "vec_id").alias("component_id"),
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        ), "known",
    )
    linked = join_hot(
        digested.select("vec_id", "digest"), known, "digest", "weight", rows.count()
    ).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
