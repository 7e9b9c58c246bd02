"""Helpers that the operators share: words, balanced ranks, joins with hot keys, components.

Nothing here collects rows that grow with the data. Intermediate tables go to the
folder in ``spark.checkpoint.dir`` (see :mod:`salesloom.staging`).
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..staging import materialise as stage, release

__all__ = [
    "WordHashes", "blockwise", "components", "extend", "join_hot", "join_salted", "match_pairs",
    "ranked", "ship", "stage", "table", "text_key", "words_of",
]

#: Rows of one block; a task never holds more than two blocks of one group.
BLOCK = 128
#: Rows of small groups that one call handles together.
BIN_ROWS = 256
#: Keys that count as hot: more than one row in so many, hence at most so many keys.
HOT_KEYS = 1000
#: Copies of the smaller side in joins on node ids of a graph.
SALTS = 16


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        folder = os.path.realpath(tempfile.mkdtemp(prefix="py-files-"))  # the driver's own copy
        spark.sparkContext.addPyFile(shutil.make_archive(
            f"{folder}/{package.name}", "zip", package.parent, package.name
        ))
        _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8, unchanged; null has none."""
    return text.encode().split() if text else []


def text_key() -> Column:
    """Tells apart rows of one doc_id with different texts."""
    return F.xxhash64(F.col("text"))


def extend(
    df: DataFrame, column: str, make: Callable[[], Callable[[object], tuple]], added: str
) -> DataFrame:
    """Replace ``column`` by the columns ``added`` that a function makes of its value.

    ``make`` is called once per task and returns the function; the other columns pass
    through untouched, whatever they hold. Batches are halved down to pieces of a few
    megabytes, so long values need little memory beside their own size.
    """
    kept = [f for f in df.schema if f.name != column]
    new = StructType.fromDDL(added)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for part in _parts(batch):
                rows = [function(value.as_py()) for value in part.column(column)]
                values = zip(*rows, strict=True) if rows else [()] * len(new)
                arrays = [part.column(f.name) for f in kept]
                arrays += [pa.array(v, t) for v, t in zip(values, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    types = [_ARROW[f.dataType.simpleString()] for f in new]
    names = [f.name for f in kept] + new.names
    return df.mapInArrow(each, StructType([*kept, *new]))


_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
    "binary": pa.binary(),
}


def _parts(batch: pa.RecordBatch, limit: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    if batch.num_rows <= 1 or batch.nbytes <= limit:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from _parts(batch.slice(0, half), limit)
        yield from _parts(batch.slice(half), limit)


class WordHashes(dict):
    """Word to 64-bit hash, remembered for the most recent ``limit`` words."""

    def __init__(self, limit: int = 1 << 18):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, count=len(words))


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: ranks 0, 1, ... without gaps inside each value of ``keys``.

    The rank follows a hash of ``order`` and then ``order`` itself, so reruns agree. A key
    with most of all rows costs no large task: rows are ranked inside about sqrt(n) hash
    buckets, and the buckets' counts are summed up before.
    """
    stored = stage(df, "ranked")
    total = stored.count()
    buckets = max(16, int(total**0.5))
    bucketed = stored.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = bucketed.groupBy(*keys, "_bucket").count().withColumn(
        "_start", F.coalesce(F.sum("count").over(before), F.lit(0))
    ).drop("count")
    renamed = starts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"), "_start",
    )
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        bucketed.join(renamed, same)
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_b", "_start", *[f"_k{i}" for i in range(len(keys))])
    )


def join_hot(
    left: DataFrame, right: DataFrame, key: str | list[str], rows: str, total: int
) -> DataFrame:
    """Inner join on ``key`` (one or more columns), unique in ``right``, where few keys may have most rows of ``left``.

    ``right`` says in column ``rows`` how many rows of ``left`` its key has; ``total`` is
    their sum. Keys with more than one row in HOT_KEYS are at most HOT_KEYS keys: they are
    broadcast, so their rows stay where they are. All others meet by a shuffle.
    """
    limit = max(BLOCK, -(-total // HOT_KEYS))
    hot = right.where(F.col(rows) > limit)
    cold = right.where(F.col(rows) <= limit)
    near = left.join(F.broadcast(hot), key)
    names = [key] if isinstance(key, str) else key
    far = left.join(F.broadcast(hot.select(*names)), key, "left_anti").join(cold, key)
    return near.unionByName(far)


def join_salted(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """Join where a hub may have most rows of ``left``: ``right`` has one short row a key.

    Both sides are shuffled: the rounds of a graph would else send a broadcast through the
    driver each, which holds all of them until it collects its garbage.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return (
        left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        .join(right.withColumn("_salt", salts).hint("merge"), [key, "_salt"])
        .drop("_salt")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v): a row (node, component) per node.

    The component is its smallest node. Alternating large and small stars: every round
    ties each node to the smallest known neighbour, until a round changes nothing.
    """
    now = stage(
        edges.where("u <> v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        ).distinct(), "edges",
    )
    mark = None
    while True:
        count, digest = now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if not count or (count, digest) == mark:
            break
        mark = (count, digest)
        release(edges.sparkSession)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            join_salted(both.where("v > u"), least, "u", "v")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = stage(large.where("u <> v"), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            join_salted(large, low, "u", "v").where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        )
        now = stage(small.distinct(), "edges")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def blockwise(
    rows: DataFrame, match: Callable[[pd.DataFrame, pd.DataFrame | None], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Compare all rows that share ``gid``, however many; ``id`` tells rows apart.

    ``match(a, None)`` gets rows to compare among themselves, ``match(a, b)`` two disjoint
    sets to compare with each other; every pair of rows of a group comes up exactly once.
    Groups of up to BLOCK rows are handled many to a call. A larger one is dealt into
    blocks and every pair of blocks is a task of its own, so nothing is capped and no
    task holds more than two blocks.
    """
    stored = stage(rows, "grouped")
    total = stored.count()
    sizes = stage(stored.groupBy("gid").agg(F.count("*").alias("_n")).where("_n > 1"), "sizes")
    sized = join_hot(stored, sizes, "gid", "_n", total)
    bins = -(-total // BIN_ROWS) + 1
    small = sized.where(F.col("_n") <= BLOCK).withColumn(
        "_task", F.pmod(F.xxhash64("gid"), F.lit(bins))
    )

    def few(frame: pd.DataFrame) -> pd.DataFrame:
        found = (match(g, None) for _, g in frame.groupby("gid", sort=False))
        return _concat([f for f in found if len(f)] or [NOTHING])

    blocks = F.ceil(F.col("_n") / BLOCK)
    dealt = sized.where(F.col("_n") > BLOCK).withColumn(
        "_own", F.pmod(F.xxhash64("id"), blocks)
    ).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.withColumn("_lo", F.least("_own", "_other")).withColumn(
        "_hi", F.greatest("_own", "_other")
    )

    def two(frame: pd.DataFrame) -> pd.DataFrame:
        own = (frame["_own"] == frame["_lo"]).to_numpy()
        if (frame["_lo"] == frame["_hi"]).iloc[0]:
            return match(frame, None)
        return match(frame[own], frame[~own])

    return small.groupBy("_task").applyInPandas(few, schema).unionByName(
        dealt.groupBy("gid", "_lo", "_hi").applyInPandas(two, schema)
    )


NOTHING = pd.DataFrame({c: np.empty(0, np.int64) for c in ("u", "v", "links")})


def _concat(frames: list[pd.DataFrame]) -> pd.DataFrame:
    return frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)


def match_pairs(
    a: pd.DataFrame, b: pd.DataFrame | None, linked: np.ndarray, counts: bool
) -> pd.DataFrame:
    """Rows of a comparison instead of its pairs: a spanning forest, and link weights.

    ``linked`` is the boolean matrix of a x b (or a x a). Returns rows (u, v, links): forest
    edges with links 0, and with ``counts`` for each id a row (id, id, links), where links
    adds up the ``weight`` of the rows linked to it.
    """
    ids = a["id"].to_numpy() if b is None else np.concatenate([a["id"], b["id"]])
    left = np.arange(len(a))
    right = left if b is None else len(a) + np.arange(len(b))
    if b is None:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return NOTHING
    label = np.arange(len(ids))
    forest = []
    for i in left[linked.any(axis=1)]:
        near = right[linked[i]]
        found, first = np.unique(label[near], return_index=True)
        fresh = found != label[i]
        if fresh.any():
            forest += [(i, j) for j in near[first[fresh]]]
            label[np.isin(label, found[fresh])] = label[i]
    pairs = np.array(forest, np.int64).reshape(-1, 2)
    out = [pd.DataFrame({"u": ids[pairs[:, 0]], "v": ids[pairs[:, 1]], "links": np.int64(0)})]
    if counts:
        weight = a["weight"].to_numpy() if b is None else b["weight"].to_numpy()
        sums = [(a["id"].to_numpy(), linked @ weight)]
        if b is not None:
            sums.append((b["id"].to_numpy(), linked.T @ a["weight"].to_numpy()))
        out += [
            pd.DataFrame({"u": x[n > 0], "v": x[n > 0], "links": n[n > 0].astype(np.int64)})
            for x, n in sums
        ]
    return _concat(out)
