"""Exact top-k inner products from an impact-ordered index, score at a time.

Every block of vectors is indexed by component: its values, shifted to be non-negative in
the direction of a query's sign, fall into quantised levels, and a level's vectors are a
posting segment. A query takes the segments of all components by descending impact (weight
times level), adding up scores, so after any segment the most that a vector can still gain
is known. It stops when that proves that the best k are among few possible members, which
are then scored exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stage

SCALE = 1_024
K = 10
QUERY_MODULUS = 100
#: Vectors of an index block, and queries that a task holds beside one.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 1_024
LEVELS = 16
#: Possible members may be scored exactly once they are one in so many of a block.
FEW = 32
#: Segments are added up in so many rounds; a proof is tried in the second half.
ROUNDS = 16
SCHEMA = "query_id long, vec_id long, score long"


class Index:
    """Posting segments of a block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.doubles = ids, vectors, vectors.astype(np.float64)
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)
        self.largest = max(-int(self.low.min()), int(self.high.max()), 0)
        self.width = np.maximum(1, -(-(self.high - self.low + 1) // LEVELS))
        self.level = ((vectors - self.low) // self.width).astype(np.uint8)
        order = np.argsort(self.level, axis=0, kind="stable").T.copy()
        steps = np.arange(LEVELS + 1)
        starts = np.array([
            np.searchsorted(self.level[rows, d], steps) for d, rows in enumerate(order)
        ])
        self.sizes = np.diff(starts, axis=1)
        self.segments = [
            order[d, starts[d, v]:starts[d, v + 1]]
            for d in range(len(order)) for v in range(LEVELS)
        ]

    def top(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best by (score, smaller id), without rows of ``own``."""
        n = len(self.ids)
        others = np.flatnonzero(self.ids != own)
        if len(others) <= 8 * k:
            return self._best(others, query, k)
        # A component's gain counts from the worst value for the sign of the query there:
        # a level gives at least its near edge and at most its far one.
        weight = np.abs(query)[:, None]
        upward = (query >= 0)[:, None]
        span, width = (self.high - self.low)[:, None], self.width[:, None]
        edge = np.arange(LEVELS)[None, :] * width
        least = np.where(upward, edge, span - edge - width + 1).clip(0) * weight
        most = np.where(upward, edge + width - 1, span - edge).clip(0, span) * weight
        dims, levels = np.nonzero(self.sizes)
        turn = np.argsort(-most[dims, levels], kind="stable")
        dims, levels = dims[turn], levels[turn]
        gained = np.zeros(n)
        hidden = (weight * (width - 1))[:, 0]
        reached = np.full(len(query), LEVELS)  # depth down to which segments were added
        cuts = np.linspace(0, len(dims), ROUNDS + 1).astype(int)
        for step, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            d, v = dims[lo:hi], levels[lo:hi]
            rows = [self.segments[x] for x in (d * LEVELS + v).tolist()]
            gains = np.repeat(least[d, v].astype(float), self.sizes[d, v])
            if rows:
                gained += np.bincount(np.concatenate(rows), gains, n)
            np.minimum.at(reached, d, np.where(upward[d, 0], v, LEVELS - 1 - v))
            if step < ROUNDS // 2 or step % 2 == 0 and hi < len(dims):
                continue
            bar = np.partition(gained[others], len(others) - k)[-k]
            if hi == len(dims):
                # Every level was added: only what the levels hide is still possible.
                members = others[gained[others] + hidden.sum() >= bar]
                break
            # The most that is still possible: for components already added what their
            # level hides, for the others the most of the next segment to come.
            ahead = np.zeros(len(query))
            later = dims[hi:]
            np.maximum.at(ahead, later, most[later, levels[hi:]])
            few = n // FEW + k
            # No row can gain less than the smaller of the two, which often settles that
            # too many stay possible.
            if np.count_nonzero(gained[others] + np.minimum(hidden, ahead).sum() >= bar) > few:
                continue
            first = np.where(upward[:, 0] | (reached == LEVELS), reached, 0)
            last = np.where(upward[:, 0], LEVELS, LEVELS - 1 - reached).clip(0)
            added = (self.level >= first.astype(np.uint8)) & (self.level <= last.astype(np.uint8))
            able = gained + ahead.sum() + added.astype(np.float64) @ (hidden - ahead)
            members = others[able[others] >= bar]
            if len(members) <= few:
                break
        return self._best(members, query, k)

    def _best(self, rows: np.ndarray, query: np.ndarray, k: int):
        if self.largest * int(np.abs(query).max(initial=0)) * len(query) < 2**53:
            # Doubles hold every sum exactly, and their products are much faster.
            scores = (self.doubles[rows] @ query.astype(np.float64)).astype(np.int64)
        else:
            scores = self.vectors[rows] @ query
        if len(rows) > k:
            high = np.flatnonzero(scores >= np.partition(scores, len(rows) - k)[-k])
            rows, scores = rows[high], scores[high]
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[best], scores[best]


def _integers() -> Column:
    """floor(SCALE * x) of every component, null if one is null or not finite."""
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return F.when(finite & (F.size("embedding") > 0), whole)


def search(
    vectors: DataFrame, k: int = K, is_query: Column | None = None
) -> DataFrame:
    """The k best rows for every query among all other rows, exactly.

    ``vectors`` has vec_id and embedding. Queries are the rows with vec_id divisible by
    QUERY_MODULUS, or ``is_query``. Returns query_id, rank (from 1), vec_id and score, the
    integer inner product; ties go to the smaller vec_id, and all candidates are returned
    if there are fewer than k. Null vec_ids, empty vectors and vectors that are null or have
    null or non-finite components take no part; vectors of different length never meet. A
    row repeated under the query's own vec_id counts as its own row; other repeated rows are
    candidates each, and a query id that is repeated is one query. Other columns are
    ignored; a table without queries gives an empty result.

    Queries are a fixed share of all rows, so both sides are dealt into blocks: a task has
    one block of vectors and one of queries, whatever the number of either.
    """
    rows = stage(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"), _integers().alias("x"),
            (F.col("vec_id") % QUERY_MODULUS == 0 if is_query is None else is_query).alias("q"),
        ).where("vec_id is not null and x is not null"), "integers",
    )
    asked = rows.where("q").dropDuplicates(["vec_id"])
    total, queries = rows.count(), asked.count()
    blocks = max(1, -(-total // BLOCK_ROWS))
    query_blocks = max(1, -(-queries // BLOCK_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    indexed = rows.select(
        "vec_id", "x", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
        every(query_blocks).alias("part"),
    )
    asking = asked.select(
        "vec_id", "x", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int")
        .alias("part"), every(blocks).alias("block"),
    )

    def meet(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        dims, asked_dims = block["x"].map(len), queries["x"].map(len)
        for dim in sorted(set(dims) & set(asked_dims)):
            mine = block[dims == dim]
            index = Index(mine["vec_id"].to_numpy(), np.array(mine["x"].tolist(), np.int64))
            some = queries[asked_dims == dim]
            for own, x in zip(some["vec_id"].to_numpy(), some["x"], strict=True):
                at, scores = index.top(np.asarray(x, np.int64), k, own)
                out.append(pd.DataFrame(
                    {"query_id": own, "vec_id": index.ids[at], "score": scores}
                ))
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return pd.concat(out, ignore_index=True) if out else empty

    best = indexed.groupBy("block", "part").cogroup(asking.groupBy("block", "part"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        best.applyInPandas(meet, SCHEMA)
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
