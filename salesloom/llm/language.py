"""Language identification by rank-order profiles of character n-grams.

A language's profile lists its most frequent n-grams by rank. A document's own list is
compared with each profile: every n-gram adds how far out of place its rank is, one that
the profile lacks adds the whole length. The nearest profile names the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import extend

#: N-grams of a profile and of a document's list.
PROFILE = 300
#: Documents per language that the profiles are counted over, chosen by a hash: the
#: documented size of the sample (as expected value).
SAMPLE_PER_LANGUAGE = 1_000
#: Characters that are counted at a time, so very long texts need little memory.
CHUNK = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The 1- to 3-grams of a text and their counts.

    Letters in lower case; everything between words is one blank, which n-grams may begin
    or end with. An n-gram is a number of 21 bits per character. Null and texts without a
    letter have none.
    """
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    keep = letter | np.r_[True, letter[:-1]]  # one blank for a run of other characters
    chars = np.where(letter, codes, 32)[keep].astype(np.uint64)
    chars = np.r_[np.uint64(32), chars[0 if letter[0] else 1:], np.uint64(32)]
    if chars[-2] == 32:
        chars = chars[:-1]
    found, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    bits = np.uint64(21)
    for start in range(0, len(chars), CHUNK):
        c = chars[start:start + CHUNK + 2]
        own = len(chars[start:start + CHUNK])
        two = (c[:-1] << bits) | c[1:]
        three = (two[:-1] << bits) | c[2:]
        parts = [c[:own][c[:own] != 32], two[:own], three[:own][c[1:-1][:own] != 32]]
        gram, n = np.unique(np.concatenate(parts), return_counts=True)
        found, counts = _merge(found, counts, gram, n) if len(found) else (gram, n)
    return found, counts


def _merge(a, n, b, m):
    gram, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return gram, np.bincount(at, np.concatenate([n, m])).astype(np.int64)


def ranking(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order; equal counts by the n-gram itself."""
    if len(grams) > 4 * size:  # only those that can be among the first
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))[:size]]


class Profiles:
    """Ranked n-grams by language."""

    def __init__(self, ranked: dict[str, np.ndarray]):
        self.names = sorted(ranked)
        self.sorted = []
        for name in self.names:
            order = np.argsort(ranked[name])
            self.sorted.append((ranked[name][order], order))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Mean out-of-place distance to each profile, as a share of the greatest one."""
        place = np.arange(len(own))
        out = []
        for grams, ranks in self.sorted:
            at = np.searchsorted(grams, own).clip(max=len(grams) - 1)
            off = np.where(grams[at] == own, np.abs(ranks[at] - place), PROFILE)
            out.append(np.minimum(off, PROFILE).mean() / PROFILE)
        return np.array(out)

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranking(*ngrams(text))
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        far = self.distances(own)
        near = np.exp(-20 * (far - far.min()))
        return self.names[int(far.argmin())], float(near.max() / near.sum())


def fit(docs: DataFrame) -> Profiles:
    """Profiles from rows with text and lang whose crc32(doc_id as text) mod 4 is not 2.

    About SAMPLE_PER_LANGUAGE documents of each language are counted. Only the number of
    rows per language and the ranked n-grams come to the driver.
    """
    learn = docs.select("doc_id", "text", "lang").where(
        "doc_id is not null and text is not null and lang is not null"
    ).where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    sizes = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles({})
    share = F.create_map(*[
        F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, SAMPLE_PER_LANGUAGE / n))
    ])
    dice = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) / 1_000_000
    sample = learn.where(dice < share[F.col("lang")]).select("lang", "text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                total = np.empty(0, np.uint64), np.empty(0, np.int64)
                for text in part["text"]:
                    total = _merge(*total, *ngrams(text))
                yield pd.DataFrame({
                    "lang": lang, "gram": total[0].astype(np.int64), "n": total[1]
                })

    grams = sample.mapInPandas(count, "lang string, gram long, n long").groupBy(
        "lang", "gram"
    ).agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = grams.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= PROFILE)
    ranked: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "rank").select("lang", "gram").collect():
        ranked.setdefault(row["lang"], []).append(row["gram"])
    return Profiles({k: np.array(v, np.uint64) for k, v in ranked.items()})


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """Predict the language of every row of ``docs`` (doc_id, text) from its whole text.

    A null text, one without a letter, and any text when nothing was learned are ``und``
    with score 0. The score compares the distances of the languages. Repeated rows are
    predicted each, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return extend(
        docs.select("doc_id", held_out.alias("held_out"), "text"), "text",
        lambda: lambda text: shared.value.predict(text), "lang_pred string, score double",
    )


def language(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, predict all rows."""
    return identify(docs, fit(docs))
