"""A Merkle manifest of a table: a tree for each group of rows, and a tree over the groups.

A leaf is H of a row's columns; H is SHA-256 of its inputs joined, digests as lower-case hex text. In a tree every
``FANOUT`` consecutive nodes (the last run: fewer, even one) become their H, until one node is left; a lone leaf stays as it
is. Each group's leaves are ordered by key; the groups' roots, ordered by group (null first), make the upper tree.

1. Leaves are made by built-in functions in one pass, and written as a narrow table: one row of about 100 bytes for each.
2. They are numbered inside their group: a range sort (a group may hold most of the rows: it is spread over many
   ranges), a row number in each range, and a count for each range and group.
3. Superblocks: leaves are bucketed by index div FANOUT^LEVELS, and ``applyInPandas`` collapses up to LEVELS levels of one
   bucket, at most FANOUT^LEVELS rows, to its root and gives every leaf its siblings inside the bucket. The roots are the
   next round's leaves, until each group has one. The groups' roots are reduced in the same way.
4. From the top down each bucket takes on the siblings of what is above it, so a row's proof is its lower siblings followed by the upper ones.

Nothing of a whole group or of the whole table is in one task, or on the driver (which learns only how many rounds there are).

Edge cases: a null column is ``-`` in its leaf, an empty text ``0:``; a null key comes first in its group, a null group is a
group of its own and comes first. Rows that repeat a key are leaves of their own, ordered by their leaf; equal rows are
equal leaves side by side. An empty table gives an empty result. Columns that are not named are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import BROADCAST_KEYS, Scratch
from tessera.llm.textkernel import tidied

FANOUT = 3
#: Levels that one round collapses: 3^8 = 6,561 rows in a bucket.
LEVELS = 8


def leaf_hash(*columns: Column | str) -> Column:
    """H of the columns in order: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def parent(nodes: list[bytes]) -> bytes:
    """H of the digests, as they are written in hex."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def collapse(nodes: list[bytes], levels: int | None, fanout: int = FANOUT) -> tuple[bytes, list[bytes]]:
    """(root, siblings of each node joined from the lowest level up) after ``levels`` levels, or with None until one node is left."""
    proofs: list[list[bytes]] = [[] for _ in nodes]
    now, width = nodes, 1
    while len(now) > 1 if levels is None else levels > 0:
        runs = [now[i : i + fanout] for i in range(0, len(now), fanout)]
        for i, proof in enumerate(proofs):
            at = i // width
            run = runs[at // fanout]
            if len(run) > 1:
                proof.append(b"".join(run[: at % fanout]) + b"".join(run[at % fanout + 1 :]))
        now, width = [parent(r) for r in runs], width * fanout
        levels = None if levels is None else levels - 1
    return now[0], [b"".join(p) for p in proofs]


def fold(leaf: bytes, steps: list[tuple[int, int]], siblings: bytes, fanout: int = FANOUT) -> bytes:
    """The root that a leaf and its siblings lead to. ``steps``: (index, number of leaves) of each tree, the lowest first."""
    at = 0
    for index, count in steps:
        while count > 1:
            first = index - index % fanout
            size = min(fanout, count - first)
            others = [siblings[at + 32 * i : at + 32 * (i + 1)] for i in range(size - 1)]
            at += 32 * (size - 1)
            others.insert(index - first, leaf)
            leaf = parent(others)
            index, count = index // fanout, -(-count // fanout)
    return leaf


def _numbered(rows: DataFrame, scratch: Scratch, name: str, group: str, order: list[str]) -> DataFrame:
    """``rows`` (a written table) with index (from 0 inside the group) and count (of the group), in order: a range sort and one count for each range and group."""
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (group, *order)]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (group, *order)])
    at = scratch.save(ranged.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)), f"{name}-sorted")
    parts = at.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    one = Window.partitionBy(group)
    begins = parts.select(group, "_part", "_first", (F.sum("_n").over(one.orderBy("_part")) - F.col("_n")).alias("_begin"), F.sum("_n").over(one).alias("count"))  # ranges of a group
    begins = scratch.save(begins, f"{name}-ranges")
    few = F.broadcast(begins) if begins.count() <= BROADCAST_KEYS else begins
    few = few.withColumnsRenamed({group: "_group", "_part": "_own"})
    joined = at.join(few, at[group].eqNullSafe(few["_group"]) & (at["_part"] == few["_own"]))
    return joined.select(*rows.columns, (F.col("_begin") + F.col("_id") - F.col("_first")).alias("index"), "count")


def _round(nodes: DataFrame, scratch: Scratch, name: str, fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with bucket and siblings inside it, the buckets' roots as the next nodes). ``nodes``: tree, index, count, digest and whatever goes with a node."""
    span = fanout**levels
    carried = [f for f in nodes.schema if f.name not in ("tree", "index", "count", "digest")]
    schema = ", ".join(["root boolean", "tree string", "index bigint", "count bigint", "digest binary", "siblings binary", *[f"`{f.name}` {f.dataType.simpleString()}" for f in carried]])

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("index", kind="stable")
        count = int(rows["count"].iloc[0])
        root, siblings = collapse([bytes(d) for d in rows["digest"]], None if count <= span else levels, fanout)
        own = rows.assign(root=False, siblings=siblings)
        top = {"root": True, "tree": rows["tree"].iloc[0], "index": int(rows["index"].iloc[0]) // span, "count": -(-count // span), "digest": root, "siblings": None, **{f.name: None for f in carried}}
        return pd.concat([own.astype(object), pd.DataFrame([top], dtype=object)])[["root", "tree", "index", "count", "digest", "siblings", *[f.name for f in carried]]]

    bucketed = nodes.withColumn("bucket", F.floor(F.col("index") / span))
    both = scratch.save(bucketed.groupBy("tree", "bucket").applyInPandas(reduce, schema), name, by="root")
    return both.filter("not root").drop("root"), both.filter("root").select("tree", "index", "count", "digest")


def _reduced(leaves: DataFrame, scratch: Scratch, name: str, fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """(leaves with the siblings of all rounds, tree and digest of each root). ``leaves``: tree, index, count, digest and more."""
    span = fanout**levels
    rounds, nodes = [], leaves
    while True:
        own, nodes = _round(nodes, scratch, f"{name}-{len(rounds)}", fanout, levels)
        rounds.append(own)
        if not nodes.filter("count > 1").take(1):
            break
    above = None
    for own in reversed(rounds):  # from the top down: siblings of a node are its own and those of its bucket's root
        if above is not None:
            up = above.select(F.col("tree").alias("_tree"), F.col("index").alias("_bucket"), F.col("siblings").alias("_upper"))
            few = F.broadcast(up) if above.count() <= BROADCAST_KEYS // 50 else up
            own = own.withColumn("_at", F.floor(F.col("index") / span)).join(few, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_at") == F.col("_bucket")))
            own = own.withColumn("siblings", F.concat("siblings", "_upper")).drop("_at", "_tree", "_bucket", "_upper")
        above = own
    return above, nodes.select("tree", "digest")


def manifest(leaves: DataFrame, group: str = "source", key: str = "doc_id", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``leaves`` (``group``, ``key``, leaf: hex, and more columns) with index, count (of the group), group_index, groups, subroot, root (hex) and
    siblings (binary: 32 bytes each, level by level up to the root)."""
    scratch = Scratch(leaves.sparkSession, "merkle")
    more = [c for c in leaves.columns if c not in (group, key, "leaf")]
    narrow = scratch.save(leaves.select(F.col(group).cast("string").alias("tree"), F.col(key).alias("key"), F.unhex("leaf").alias("digest"), F.struct(*[F.col(f"`{c}`") for c in more], F.lit(0).alias("_none")).alias("more")), "leaves")
    numbered = _numbered(narrow, scratch, "leaves", "tree", ["key", "digest"])
    rows, subroots = _reduced(numbered, scratch, "rows", fanout, levels)
    subroots = scratch.save(subroots, "subroots")
    # the groups' roots are the leaves of one more tree, whose name is empty
    upper = _numbered(subroots.select(F.lit("").alias("all"), F.col("tree").alias("own"), "digest"), scratch, "groups", "all", ["own"]).withColumnRenamed("all", "tree")
    groups, root = _reduced(upper, scratch, "groups", fanout, levels)
    groups = scratch.save(groups.select(F.col("own").alias("_own"), F.col("index").alias("group_index"), F.col("count").alias("groups"), F.lower(F.hex("digest")).alias("subroot"), F.col("siblings").alias("_upper")), "tops")
    few = F.broadcast(groups) if groups.count() <= BROADCAST_KEYS // 50 else groups
    out = rows.join(few, rows["tree"].eqNullSafe(F.col("_own"))).join(F.broadcast(root.select(F.lower(F.hex("digest")).alias("root"))))  # one row
    names = [F.col("more")[c].alias(c) for c in more]
    return out.select(F.col("tree").alias(group), F.col("key").alias(key), F.lower(F.hex("digest")).alias("leaf"), *names, "index", "count", "group_index", "groups", "subroot", "root", F.concat("siblings", "_upper").alias("siblings"))


def verified(proofs: DataFrame, leaf: Column, fanout: int = FANOUT) -> DataFrame:
    """``proofs`` (of ``manifest``) with proof_sha256, folded_root (where ``leaf``, hex, leads) and verified (folded_root is the root)."""
    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema], "proof_sha256 string", "folded_root string", "verified boolean"])
    names = proofs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, count, group, groups, siblings, root = (batch.column(names.index(c)).to_pylist() for c in ("index", "count", "group_index", "groups", "siblings", "root"))
            start = batch.column(len(names)).to_pylist()
            digest = [hashlib.sha256(s.hex().encode()).hexdigest() for s in siblings]
            folded = [fold(bytes.fromhex(x), [(i, n), (g, m)], s, fanout).hex() for x, i, n, g, m, s in zip(start, index, count, group, groups, siblings)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(digest, pa.string()), pa.array(folded, pa.string()), pa.array([f == r for f, r in zip(folded, root)], pa.bool_())], [*names, "proof_sha256", "folded_root", "verified"])

    return proofs.select("*", leaf.alias("_start")).mapInArrow(tidied(run), kinds)
