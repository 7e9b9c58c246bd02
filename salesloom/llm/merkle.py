"""A Merkle manifest of a dataset: a hash tree per language under one root.

Every row is a leaf. Leaves of a language stand in the order of doc_id; runs of eight
consecutive nodes are hashed to a parent until one node is left, and the languages' last
nodes form a tree of their own. On every level a window with fixed offsets supplies each
node's siblings (lag and lead columns, masked by the node's slot in its run and the length
of the run), and the first child of each run hashes the parent. Going down again, a node
hands its path to its children, so every leaf ends with its proof.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stage

FANOUT = 8
#: Nodes of one window partition, a multiple of FANOUT, so no run is cut.
WINDOW_NODES = FANOUT**4
#: Rows of one range of the order.
RANGE_ROWS = 1 << 17
#: A document is tampered with if this divides the crc32 of its id.
TAMPERED = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its UTF-8 length in front; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    others = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return digest(*others, field(text))


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``pos`` 0, 1, ... in the order of ``order`` in each group, and the group's ``size``.

    The rows are range-partitioned, numbered inside each range, and the ranges' counts are
    summed up, so a group with most rows costs no large task. Equal rows are told apart by
    a number of their own, so they may fill many ranges.
    """
    stored = stage(rows, "unordered")
    ranges = -(-stored.count() // RANGE_ROWS) or 1
    keys = [group, *order, "_row"]
    dealt = stage(
        stored.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()), "ordered",
    )
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(group, "_range").count().select(
        group, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"),
        F.sum("count").over(Window.partitionBy(group)).alias("size"),
    )
    inside = Window.partitionBy(group, "_range").orderBy(*order, "_row")
    return (
        dealt.withColumn("_number", F.row_number().over(inside) - 1)
        .join(starts, [group, "_range"])
        .withColumn("pos", F.col("_start") + F.col("_number"))
        .drop("_row", "_range", "_number", "_start")
    )


def siblings(nodes: DataFrame) -> DataFrame:
    """Add ``before`` and ``after``: the digests of the run's other nodes on either side."""
    near = Window.partitionBy("grp", F.floor(F.col("pos") / WINDOW_NODES)).orderBy("pos")
    slot = F.col("pos") % FANOUT
    run = F.least(F.lit(FANOUT), F.col("size") - F.col("pos") + slot)
    empty = F.lit("")
    left = [
        F.when(slot >= k, F.lag("digest", k).over(near)).otherwise(empty)
        for k in range(FANOUT - 1, 0, -1)
    ]
    right = [
        F.when(slot + k < run, F.lead("digest", k).over(near)).otherwise(empty)
        for k in range(1, FANOUT)
    ]
    return nodes.withColumn("before", F.concat(*left)).withColumn("after", F.concat(*right))


def levels(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """The levels of all groups' trees, from ``nodes`` (grp, pos, size, digest) to the tops.

    ``largest`` is the size of the largest group. A group whose only node is left has
    its top on that level and is not on later ones.
    """
    out = []
    while True:
        out.append(stage(siblings(nodes), "level"))
        if largest <= 1:
            return out
        largest = -(-largest // FANOUT)
        nodes = out[-1].where((F.col("pos") % FANOUT == 0) & (F.col("size") > 1)).select(
            "grp", F.floor(F.col("pos") / FANOUT).alias("pos"),
            F.ceil(F.col("size") / FANOUT).alias("size"),
            digest(F.col("digest"), F.col("after")).alias("digest"),
        )


def tops(tree: list[DataFrame]) -> DataFrame:
    """The last node of each group: (grp, digest)."""
    return reduce(DataFrame.unionByName, [
        level.where("size = 1").select("grp", "digest") for level in tree
    ])


def paths(tree: list[DataFrame], above: DataFrame) -> DataFrame:
    """Rows (grp, pos, path) of the lowest level: siblings of all ancestors, own level first.

    ``above`` (grp, top_path) is what follows the group's top.
    """
    here = F.array(F.struct("before", "after")).cast(_PATH)
    down = None
    for level in reversed(tree):
        last = level.where("size = 1").join(above, "grp").select(
            "grp", "pos", F.col("top_path").alias("path")
        )
        if down is None:
            down = last
            continue
        parent = down.select(
            "grp", F.col("pos").alias("_parent"), F.col("path").alias("_above")
        )
        inner = level.where("size > 1").withColumn("_parent", F.floor(F.col("pos") / FANOUT))
        down = inner.join(parent, ["grp", "_parent"]).select(
            "grp", "pos", F.concat(here, F.col("_above")).alias("path")
        ).unionByName(last)
    return down


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and the siblings on its path lead to."""
    return F.aggregate(path, start, lambda d, step: F.sha2(F.concat(step.before, d, step.after), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, lang, n_chars, text).

    Returns doc_id, lang, the untampered leaf, subroot, root and proof_sha256, and the root
    that the tampered leaf leads to with the original siblings (folded_root, verified). A
    null in any column is ``-`` in the leaf; an empty text is ``0:``. A null doc_id stands
    first in its language and is not tampered with, equal doc_ids stand in the order of
    their leaves, repeated rows are leaves each. Other columns are ignored, an empty table
    gives an empty manifest. Texts are read once, to be hashed.
    """
    crc = F.crc32(F.col("doc_id").cast("string"))
    changed = leaf(F.translate(F.col("text"), _UPPER, _LOWER))
    leaves = docs.select("doc_id", "source", "lang", "n_chars", "text").select(
        "doc_id", "lang",
        F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("+"), F.col("lang"))).alias("grp"),
        leaf(F.col("text")).alias("digest"),
        F.when(crc % TAMPERED == 0, changed).alias("tampered"),
    )
    placed = stage(positions(leaves, "grp", ["doc_id", "digest"]), "leaves")
    largest = placed.agg(F.max("size")).first()[0] or 0
    tree = levels(placed.select("grp", "pos", "size", "digest"), largest)
    subroots = stage(tops(tree).select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest"), "subroots")
    ordered = stage(positions(subroots, "grp", ["of"]), "subroots")
    upper = levels(ordered.select("grp", "pos", "size", "digest"), ordered.count())
    start = F.lit(None).cast(_PATH)
    root = tops(upper).select("grp", F.col("digest").alias("root"), F.coalesce(start, F.array().cast(_PATH)).alias("top_path"))
    above = stage(
        ordered.join(paths(upper, root.select("grp", "top_path")), ["grp", "pos"])
        .join(root.select("grp", "root"), "grp")
        .select(F.col("of").alias("grp"), F.col("digest").alias("subroot"), "root", F.col("path").alias("top_path")),
        "above",
    )
    proofs = paths(tree, above.select("grp", "top_path"))
    found = placed.join(proofs, ["grp", "pos"]).join(above.select("grp", "subroot", "root"), "grp")
    steps = F.transform("path", lambda step: F.concat(step.before, step.after))
    folded = fold(F.coalesce("tampered", "digest"), F.col("path"))
    return found.select(
        "doc_id", "lang", F.col("digest").alias("leaf"), "subroot", "root",
        F.sha2(F.array_join(steps, ""), 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(depth: int = 8, upper_depth: int = 4) -> str:
    """The query's rows as SQL: all levels written out, for up to 8^depth rows a language."""
    crc = (
        "list_reduce([c & 255 FOR c IN list_transform(range(1, len(doc_id::VARCHAR) + 1), "
        "lambda i: unicode(substr(doc_id::VARCHAR, i::BIGINT, 1))::BIGINT)], lambda a, b: "
        "list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) "
        "ELSE x >> 1 END, xor(a, b)), 4294967295::BIGINT)"
    )

    def sql_leaf(text: str) -> str:
        each = (f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')" for c in (
            "doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text
        ))
        return f"sha256({' || '.join(each)})"

    parts = [f"""t AS (
    SELECT doc_id, lang, coalesce('+' || lang, '') AS g, {sql_leaf("text")} AS d,
        CASE WHEN xor({crc}, 4294967295) % {TAMPERED} = 0
            THEN {sql_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS td
    FROM documents
), l0 AS (
    SELECT *, d AS leaf, coalesce(td, d) AS f, '' AS p,
        row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS pos,
        count(*) OVER (PARTITION BY g) AS n
    FROM t
)"""]

    def climb(name: str, group: str, times: int) -> str:
        for i in range(times):
            parts.append(f"""{name}n{i} AS (
    SELECT DISTINCT {group} AS g, pos, n, d FROM {name}{i}
), {name}s{i} AS (
    SELECT g, pos, n, d,
        coalesce(string_agg(d, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
        coalesce(string_agg(d, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
    FROM {name}n{i} WINDOW r AS (PARTITION BY g, pos // {FANOUT} ORDER BY pos)
), {name}{i + 1} AS (
    SELECT x.* REPLACE (
        CASE WHEN x.n > 1 THEN sha256(s.b || x.d || s.a) ELSE x.d END AS d,
        CASE WHEN x.n > 1 THEN sha256(s.b || x.f || s.a) ELSE x.f END AS f,
        x.p || s.b || s.a AS p, x.pos // {FANOUT} AS pos, (x.n + {FANOUT - 1}) // {FANOUT} AS n)
    FROM {name}{i} x JOIN {name}s{i} s ON x.{group} = s.g AND x.pos = s.pos
)""")
        return f"{name}{times}"

    last = climb("l", "g", depth)
    parts.append(f"""u0 AS (
    SELECT *  EXCLUDE (pos, n), d AS subroot, 0 AS top, dense_rank() OVER (ORDER BY g) - 1 AS pos,
        (SELECT count(DISTINCT g) FROM {last}) AS n
    FROM {last}
)""")
    root = climb("u", "top", upper_depth)
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = d AS verified
FROM {root}"""
