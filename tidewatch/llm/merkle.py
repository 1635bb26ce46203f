"""Merkle manifest of a dataset: a tree per group, a tree over the groups, and a proof per row.

Nodes are labelled with nested intervals: a node covers the leaf ranks lo .. hi - 1 of its
tree.  Levels are handled in bands of ``BAND_LEVELS``: the ranks of a band are cut into aligned
buckets of 2^BAND_LEVELS, and all nodes of a bucket up to its top are made in one bounded group.
On the way down, a bucket's rows meet the path of its top in a co-grouped join on (tree,
bucket); inside, a row's ancestor at each level is the node whose interval contains it, and the
sibling is the parent's interval minus the child's.  No path is ever shuffled for a single
row, only one per bucket.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import python_ready, saved

BAND_LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "tree string, rank bigint, n bigint, digest string"
_PATHS = "tree string, rank bigint, path string, subroot string, root string"


def field_text(c: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value as text."""
    value = c.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def row_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


def node_digest(children: list[str]) -> str:
    """Digest of one or two child digests, as hex text."""
    return sha256("".join(children).encode()).hexdigest()


# -- numbering

def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rank from 0 within ``group`` (not null) by ``order``, and the group's size ``n``.

    Rows are dealt by ranges of (group, order), so a large group spreads over many tasks; a row's
    place in its range plus the counts of the ranges before it is its rank.  Rows that agree in all
    these columns are interchangeable."""
    by = [group, *order]
    placed = saved(rows.repartitionByRange(*by).sortWithinPartitions(*by)
                   .withColumn("_at", F.monotonically_increasing_id()))
    spans = placed.groupBy(group, F.shiftright("_at", 33).alias("_range")).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    in_group = W.partitionBy(group)
    spans = spans.select(
        group, "_range", "_first", F.sum("_size").over(in_group).alias("n"),
        F.coalesce(F.sum("_size").over(in_group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"))
    return (placed.withColumn("_range", F.shiftright("_at", 33)).join(spans, [group, "_range"])
            .withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_at", "_range", "_first", "_before"))


# -- one bucket

class Level:
    """Nodes of one level of a bucket, by interval."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, digest: list[str]):
        self.lo, self.hi, self.digest = lo, hi, digest

    def parents(self) -> "Level":
        pairs = range(0, len(self.lo), 2)
        return Level(self.lo[::2], np.append(self.hi[1::2], self.hi[-1:] if len(self.lo) % 2 else []).astype(np.int64),
                     [node_digest(self.digest[i:i + 2]) for i in pairs])

    def holder(self, at: np.ndarray) -> np.ndarray:
        """Place of the node whose interval contains each rank."""
        return np.searchsorted(self.lo, at, "right") - 1


def levels_of(rank: np.ndarray, digest: list[str], n: int, band_levels: int = BAND_LEVELS) -> list[Level]:
    """Levels of a bucket, leaves first.  A tree that fits into one bucket ends at its root;
    elsewhere every bucket is carried up all levels of the band."""
    whole = n <= 1 << band_levels
    out = [Level(rank, rank + 1, digest)]
    while len(out[-1].lo) > 1 if whole else len(out) <= band_levels:
        out.append(out[-1].parents())
    return out


def paths_of(levels: list[Level], above: str) -> list[str]:
    """Path of every leaf up to the root: per level ``L`` or ``R`` (the side on which the sibling
    stands) and the sibling's digest, or ``-`` for a node without one.  ``above`` is the path of the
    bucket's top."""
    path = [above]
    for child, parent in zip(reversed(levels[:-1]), reversed(levels[1:])):
        holder = parent.holder(child.lo)
        lo, hi = parent.lo[holder], parent.hi[holder]
        left, right = lo < child.lo, child.hi < hi       # the parent's interval minus the child's
        sibling = child.holder(np.where(left, lo, np.where(right, child.hi, child.lo)))
        steps = [("L" if a else "R") + child.digest[s] if a or b else "-" for a, b, s in zip(left, right, sibling)]
        path = [s + path[h] for s, h in zip(steps, holder)]
    return path


def siblings(path: str) -> str:
    """The sibling digests of a path, joined."""
    return path.replace("L", "").replace("R", "").replace("-", "")


def folded(leaf: str, path: str) -> str:
    """Root that a leaf and the siblings of its path give."""
    at = 0
    while at < len(path):
        side = path[at]
        other = path[at + 1:at + 65]
        leaf = node_digest([other, leaf] if side == "L" else [leaf, other] if side == "R" else [leaf])
        at += 1 if side == "-" else 65
    return leaf


# -- trees in bands

def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("rank")


def _bucketed(nodes: DataFrame, band_levels: int) -> DataFrame:
    return nodes.withColumn("bucket", F.shiftright("rank", band_levels))


def bands(nodes: DataFrame, band_levels: int = BAND_LEVELS) -> list[DataFrame]:
    """(tree, rank, n, digest) tables from the leaves up to one node a tree; a further table
    holds the bucket tops of the one before."""

    def top(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        rank, n = table.column("rank").to_numpy(), table.column("n")[0].as_py()
        levels = levels_of(rank, table.column("digest").to_pylist(), n, band_levels)
        return pa.table({"tree": [table.column("tree")[0].as_py()], "rank": [int(rank[0]) >> band_levels],
                         "n": [-(-n // (1 << band_levels))], "digest": [levels[-1].digest[0]]},
                        schema=pa.schema([("tree", pa.string()), ("rank", pa.int64()), ("n", pa.int64()),
                                          ("digest", pa.string())]))

    out = [nodes.select("tree", "rank", "n", "digest")]
    while True:
        tallest = out[-1].agg(F.max("n")).first()[0]
        if tallest is None or (tallest <= 1 and len(out) > 1):
            return out
        out.append(saved(_bucketed(out[-1], band_levels).groupBy("tree", "bucket").applyInArrow(top, _NODES)))


def _descend(nodes: DataFrame, above: DataFrame, schema: str, emit, band_levels: int) -> DataFrame:
    """Rows of a band with the path of their bucket's top: ``emit(rows, paths, top row)``."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"string": pa.string(), "bigint": pa.int64()}[c.split()[1]] for c in schema.split(", ")]

    def meet(rows: pa.Table, tops: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table([pa.array([], t) for t in kinds], names=names)
        rows = _sorted(rows)
        levels = levels_of(rows.column("rank").to_numpy(), rows.column("digest").to_pylist(), rows.column("n")[0].as_py(),
                           band_levels)
        top = tops.to_pylist()[0]
        columns = emit(rows, paths_of(levels, top["path"]), top)
        return pa.table([pa.array(c, t) if isinstance(c, list) else c.cast(t) for c, t in zip(columns, kinds)],
                        names=names)

    tops = above.withColumnRenamed("rank", "bucket")
    return (_bucketed(nodes, band_levels).groupBy("tree", "bucket").cogroup(tops.groupBy("tree", "bucket"))
            .applyInArrow(meet, schema))


def _node_paths(rows: pa.Table, paths: list[str], top: dict) -> list:
    n = len(paths)
    return [rows.column("tree"), rows.column("rank"), paths, [top["subroot"]] * n, [top["root"]] * n]


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS,
             altered: dict[str, Column] | None = None, with_path: bool = False,
             band_levels: int = BAND_LEVELS) -> DataFrame:
    """Leaf, subroot, root and proof of every row, checked against a present state of the rows.

    Returns doc_id, leaf, subroot (of the row's group), root, proof_sha256 (of the siblings from the
    leaf to the root), folded_root (recomputed from the present leaf and the manifest's siblings) and
    verified; ``with_path`` adds the path itself.  ``altered`` gives columns' present values where
    they differ from the manifest's; without it every row verifies.

    Per group, leaves ascend by id, then by leaf digest; a null id comes first and a null group is a
    group of its own, before all others.  Rows that agree in every field are leaves like any other.
    An empty table gives no rows.  Extra columns are not read.
    """
    python_ready(docs.sparkSession)
    altered = altered or {}
    present = [altered.get(f, F.col(f)) for f in fields]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("tree"),
        row_digest([F.col(f) for f in fields]).alias("digest"),
        (row_digest(present) if altered else F.lit(None).cast("string")).alias("present"))
    leaves = saved(numbered(saved(rows), "tree", ["doc_id", "digest"]))
    group_bands = bands(leaves, band_levels)
    # the groups' roots are the leaves of one more tree
    roots = group_bands[-1].select(F.col("tree").alias("group"), "digest", F.lit("").alias("tree"))
    roots = saved(numbered(roots, "tree", ["group"]))
    root_bands = bands(roots, band_levels)

    paths = root_bands[-1].select("tree", "rank", F.lit("").alias("path"), F.lit("").alias("subroot"),
                                  F.col("digest").alias("root"))
    for nodes in reversed(root_bands[:-1]):
        paths = _descend(nodes, paths, _PATHS, _node_paths, band_levels)
    paths = (paths.select("rank", "path", "root").join(roots.select("rank", "group", "digest"), "rank")
             .select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("rank"), "path",
                     F.col("digest").alias("subroot"), "root"))
    for nodes in reversed(group_bands[1:-1]):
        paths = _descend(nodes, paths, _PATHS, _node_paths, band_levels)

    def proofs(rows: pa.Table, paths: list[str], top: dict) -> list:
        leaf, present = rows.column("digest").to_pylist(), rows.column("present").to_pylist()
        ends = [folded(p or d, path) for d, p, path in zip(leaf, present, paths)]
        n = len(leaf)
        return [rows.column("doc_id"), leaf, [top["subroot"]] * n, [top["root"]] * n,
                [sha256(siblings(p).encode()).hexdigest() for p in paths], ends, *([paths] if with_path else [])]

    out = _descend(leaves, paths, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, "
                   "folded_root string" + (", path string" if with_path else ""), proofs, band_levels)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
