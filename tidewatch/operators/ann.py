"""Nearest-neighbour index: an inverted file of k-means cells with compressed vectors.

``build`` learns cells on a bounded sample, assigns every row to its nearest cell and writes
the rows in a table partitioned by cell: id, a one-byte-per-dimension code of the residual
(vector minus cell centre), the code's error, and the vector.  ``Index.search`` looks up a batch of
queries of any size:

1. each query's nearest cells are scanned by code; this bounds its k-th best similarity from below;
2. a further cell is visited only if its centre and radius allow a better row (or, with
   ``probes``, if it is among the query's nearest cells);
3. codes there give similarity intervals; rows whose interval ends below the bound are out;
4. what is left is rescored with the whole vectors.

Without ``probes`` the result is exact, since every cut is by a proven bound.  Queries and rows meet by
an equi-join on the cell, so neither side passes through the driver, and a plan has the same size
for any number of queries.  Only the cell centres are collected and broadcast (at most
``MAX_CELLS`` of each vector length).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.vector import PLACES, unit_rows
from tidewatch.operators.windows import top_per_group
from tidewatch.session import materialized, ship_package

SAMPLE_ROWS = 50_000       # rows a vector length's cells are learned on
MAX_CELLS = 4096
SLICE_ROWS = 50_000        # rows of a cell that one task scores
QUERIES_AT_ONCE = 50_000   # queries of a cell that one task scores them against
SEED_CELLS = 2             # nearest cells that give a query its first bound
_SLACK = 1e-9              # rounding of a code's score
_SCORES_AT_ONCE = 4_000_000
_PROBES_AT_ONCE = 200_000

_ROWS = "dim int, cell int, id bigint, code binary, scale double, err double, away double, vector array<float>"
_CENTRES = "dim int, cell int, centre array<float>"
_PROBES = "qid bigint, query_vec array<float>, bound double, dim int, cell int"
_FOUND = "qid bigint, dim int, cell int, id bigint, low double, high double"


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id, vector, dim) with an id and a vector without gaps."""
    v = F.col("vector")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vector"))
            .where(F.col("id").isNotNull() & (F.size(v) > 0) & whole)
            .withColumn("dim", F.size(v)))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim)


def k_means(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Unit-length centres of the rows of ``x`` (unit vectors)."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), cells, replace=False)].copy()
    step = max(1, _SCORES_AT_ONCE // cells)
    for _ in range(rounds):
        of = np.concatenate([(x[i:i + step] @ centres.T).argmax(axis=1) for i in range(0, len(x), step)])
        order = np.argsort(of, kind="stable")
        cut = np.searchsorted(of[order], np.arange(cells))
        held = np.flatnonzero(np.append(cut[1:], len(x)) > cut)
        centres[held] = np.add.reduceat(x[order], cut[held], axis=0)
        centres = unit_rows(centres)
    return centres


def _learned(sample: DataFrame, max_cells: int) -> DataFrame:
    """Centres per vector length; their number is the square root of the length's rows."""
    kinds = T._parse_datatype_string(_CENTRES)

    def learn(table: pa.Table) -> pa.Table:
        dim, rows = table.column("dim")[0].as_py(), table.column("rows")[0].as_py()
        x = unit_rows(_matrix(table.sort_by("id").column("vector"), dim))
        cells = min(max_cells, len(x), max(1, int(round(rows ** 0.5))))
        centres = k_means(x, cells).astype(np.float32)
        return pa.table({"dim": pa.array([dim] * cells, pa.int32()), "cell": pa.array(range(cells), pa.int32()),
                         "centre": pa.array(list(centres), pa.list_(pa.float32()))})

    return sample.groupBy("dim").applyInArrow(learn, kinds)


def _nearest(centres: dict[int, np.ndarray]):
    """Assigns rows to their nearest centre and codes what is left."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim in np.unique(b.column("dim").to_numpy()):
                part = b.filter(pa.array(b.column("dim").to_numpy() == dim))
                c = centres.value[int(dim)]
                step = max(1, _SCORES_AT_ONCE // len(c))
                for at in range(0, len(part), step):
                    rows = part.slice(at, step)
                    x = unit_rows(_matrix(rows.column("vector"), int(dim)))
                    cell = (x @ c.T).argmax(axis=1)
                    rest = x - c[cell]
                    scale = np.abs(rest).max(axis=1) / 127
                    scale[scale == 0] = 1.0
                    code = np.rint(rest / scale[:, None]).astype(np.int8)
                    err = np.linalg.norm(rest - code * scale[:, None], axis=1) + _SLACK
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("dim").cast(pa.int32()), pa.array(cell, pa.int32()), rows.column("id"),
                         pa.array([r.tobytes() for r in code], pa.binary()), pa.array(scale), pa.array(err),
                         pa.array(np.linalg.norm(rest, axis=1)), rows.column("vector").cast(pa.list_(pa.float32()))],
                        names=["dim", "cell", "id", "code", "scale", "err", "away", "vector"])
    return assign


def _centres_of(cells: DataFrame) -> dict[int, np.ndarray]:
    out: dict[int, list] = {}
    for r in cells.orderBy("dim", "cell").collect():
        out.setdefault(r["dim"], []).append(r["centre"])
    return {dim: np.array(rows, dtype=np.float64) for dim, rows in out.items()}


def build(corpus: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding",
          sample_rows: int = SAMPLE_ROWS, max_cells: int = MAX_CELLS) -> "Index":
    """Index every row of ``corpus`` that has an id and a whole vector, under ``path``.

    Cells are learned on the ``sample_rows`` rows of each vector length with the smallest id hash;
    all rows are indexed."""
    spark = corpus.sparkSession
    ship_package(spark)
    rows = _usable(corpus, id_col, vec_col)
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("rows"))
    picked = top_per_group(rows.withColumn("_pick", F.xxhash64("id")), ["dim"], [F.col("_pick"), F.col("id")],
                           sample_rows, "_rank", ["id"])
    _learned(picked.join(sizes, "dim").select("dim", "id", "vector", "rows"), max_cells) \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    index = Index(spark, path)
    index._write(rows, "overwrite")
    return index


class Index:
    """A built index; opening one reads only its cell table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.centres = _centres_of(spark.read.schema(_CENTRES).parquet(f"{path}/centres"))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_ROWS).parquet(f"{self.path}/rows")

    def cells(self) -> DataFrame:
        """(dim, cell, n, radius, slices) over all segments."""
        return (self.spark.read.parquet(f"{self.path}/cells").groupBy("dim", "cell")
                .agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
                .withColumn("slices", F.ceil(F.col("n") / SLICE_ROWS).cast("int")))

    def add(self, corpus: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> None:
        """Append rows as a new segment: the cells stay, radii and counts follow.  Rows of a vector
        length without cells need a new build."""
        rows = _usable(corpus, id_col, vec_col)
        strange = rows.where(~F.col("dim").isin(sorted(self.centres))).limit(1).count()
        if strange:
            raise ValueError(f"vectors of a length without cells (known: {sorted(self.centres)})")
        self._write(rows, "append")

    def _write(self, rows: DataFrame, mode: str) -> None:
        ship_package(self.spark)
        shared = self.spark.sparkContext.broadcast(self.centres)
        coded = rows.select("dim", "id", "vector").mapInArrow(_nearest(shared), _ROWS)
        coded = materialized(coded)
        coded.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")) \
            .coalesce(1).write.mode(mode).parquet(f"{self.path}/cells")
        # one directory a cell; a large cell is split over tasks and files
        coded.hint("rebalance", "dim", "cell").write.mode(mode).partitionBy("dim", "cell").parquet(f"{self.path}/rows")

    # -- search

    def _probed(self, asked: DataFrame, first: int, last: int | None) -> DataFrame:
        """(query, cell) for the query's nearest cells from place ``first`` up to ``last``, unless the
        cell's centre and radius show that no row there reaches the query's bound."""
        radius = {(r["dim"], r["cell"]): r["radius"] for r in self.cells().collect()}   # at most MAX_CELLS a length
        held = {}
        for dim, c in self.centres.items():
            filled = [i for i in range(len(c)) if (dim, i) in radius]
            if filled:
                held[dim] = (np.array(filled, dtype=np.int32), c[filled], np.array([radius[dim, i] for i in filled]))
        shared = self.spark.sparkContext.broadcast(held)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims = b.column("dim").to_numpy()
                for dim, (cells, centres, radii) in shared.value.items():
                    part = b.filter(pa.array(dims == dim))
                    step = max(1, _PROBES_AT_ONCE // len(cells))
                    for at in range(0, len(part), step):
                        rows = part.slice(at, step)
                        score = unit_rows(_matrix(rows.column("query_vec"), dim)) @ centres.T
                        order = np.argsort(-score, axis=1, kind="stable")
                        reach = np.take_along_axis(score + radii, order, 1) + _SLACK
                        wanted = reach >= rows.column("bound").to_numpy()[:, None]
                        wanted[:, :first] = False
                        if last is not None:
                            wanted[:, last:] = False
                        i, j = np.nonzero(wanted)
                        yield pa.RecordBatch.from_arrays(
                            [*(rows.column(c).take(pa.array(i)) for c in ("qid", "query_vec", "bound")),
                             pa.array(np.full(len(i), dim), pa.int32()), pa.array(cells[order[i, j]])],
                            names=["qid", "query_vec", "bound", "dim", "cell"])

        return asked.select("qid", "query_vec", "bound", "dim").mapInArrow(probe, _PROBES)

    def _scan(self, probes: DataFrame, blocks: int, k: int) -> DataFrame:
        """Rows of the probed cells whose similarity interval reaches the query's bound, or the k-th
        best of their slice."""
        sizes = self.cells().select("dim", "cell", "slices")
        block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")
        asked = (probes.join(sizes, ["dim", "cell"]).withColumn("block", block)
                 .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
                 .select("dim", "cell", "slice", "block", "qid", "query_vec", "bound"))
        rows = (self.rows().drop("vector", "away").join(sizes, ["dim", "cell"])
                .withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
                .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
                .select("dim", "cell", "slice", "block", "id", "code", "scale", "err"))
        centres = self.spark.sparkContext.broadcast(self.centres)
        schema = T._parse_datatype_string(_FOUND)
        names = ["qid", "dim", "cell", "id", "low", "high"]

        def score(held: pa.Table, asked: pa.Table) -> pa.Table:
            parts = [[np.zeros(0, dtype=np.int64)] for _ in range(2)] + [[np.zeros(0)] for _ in range(2)]
            dim = cell = 0
            if len(held) and len(asked):
                dim, cell = held.column("dim")[0].as_py(), held.column("cell")[0].as_py()
                centre = centres.value[dim][cell]
                code = np.frombuffer(b"".join(held.column("code").to_pylist()), dtype=np.int8).reshape(len(held), dim)
                about = centre + code * held.column("scale").to_numpy()[:, None]
                err, ids = held.column("err").to_numpy(), held.column("id").to_numpy()
                q = unit_rows(_matrix(asked.column("query_vec"), dim))
                bound, qids = asked.column("bound").to_numpy(), asked.column("qid").to_numpy()
                step = max(1, _SCORES_AT_ONCE // len(held))
                for at in range(0, len(q), step):
                    s = q[at:at + step] @ about.T
                    low, least = s - err, bound[at:at + step].copy()
                    if len(held) >= k:
                        least = np.maximum(least, -np.partition(-low, k - 1, axis=1)[:, k - 1])
                    i, j = np.nonzero(s + err >= least[:, None])
                    for p, x in zip(parts, (qids[at:at + step][i], ids[j], low[i, j], (s + err)[i, j])):
                        p.append(x)
            who, what, low, high = (np.concatenate(p) for p in parts)
            return pa.table([pa.array(who), pa.array(np.full(len(who), dim), pa.int32()),
                             pa.array(np.full(len(who), cell), pa.int32()), pa.array(what), pa.array(low), pa.array(high)],
                            names=names)

        keys = ["dim", "cell", "slice", "block"]
        return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(score, schema)

    def _bounds(self, found: DataFrame, k: int) -> DataFrame:
        """Per query the k-th best lower end found so far; queries with fewer rows have none."""
        best = top_per_group(found.select("qid", "id", "low"), ["qid"], [F.col("low").desc(), F.col("id")], k, "_r", ["id"])
        return best.groupBy("qid").agg(F.count(F.lit(1)).alias("_n"), F.min("low").alias("bound")) \
            .where(F.col("_n") == k).drop("_n")

    def search(self, queries: DataFrame, k: int, qid: str = "qid", qvec: str = "query_vec",
               probes: int | None = None, counts: dict | None = None) -> DataFrame:
        """(qid, id, similarity, rank from 0): the k most similar rows of every query, ties by id.

        ``probes``: visit only each query's nearest cells (approximate); without it the result is exact.
        Queries without an id or a whole vector, or of a length that no row has, have no neighbours.
        ``counts`` receives how many pairs were compared by code and by vector (costs three jobs)."""
        ship_package(self.spark)
        none = F.lit(float("-inf"))
        asked = materialized(_usable(queries, qid, qvec).select(
            F.col("id").alias("qid"), F.col("vector").alias("query_vec"), "dim"))
        blocks = max(1, -(-asked.count() // QUERIES_AT_ONCE))
        near = SEED_CELLS if probes is None else min(SEED_CELLS, probes)
        seeds = self._probed(asked.withColumn("bound", none), 0, near)
        found = materialized(self._scan(seeds, blocks, k))
        bounded = asked.join(self._bounds(found, k), "qid", "left").withColumn("bound", F.coalesce("bound", none))
        rest = self._probed(bounded, near, probes)
        found = materialized(found.unionByName(self._scan(rest, blocks, k)))
        left = (found.join(self._bounds(found, k), "qid", "left")
                .where(F.col("high") >= F.coalesce("bound", none)).select("qid", "dim", "cell", "id"))
        if counts is not None:
            sizes = self.cells().select("dim", "cell", "n")
            both = seeds.select("dim", "cell").unionByName(rest.select("dim", "cell"))
            counts["by_code"] = both.join(sizes, ["dim", "cell"]).agg(F.sum("n")).first()[0] or 0
            counts["by_vector"] = left.count()
        pairs = (left.join(self.rows().select("dim", "cell", "id", "vector"), ["dim", "cell", "id"])
                 .join(asked.select("qid", "query_vec"), "qid").select("qid", "id", "dim", "query_vec", "vector"))
        scored = pairs.mapInArrow(_rescored, "qid bigint, id bigint, similarity double")
        out = top_per_group(scored, ["qid"], [F.col("similarity").desc(), F.col("id").asc()], k, "rank", ["id"])
        return out.withColumnRenamed("qid", qid)


def _rescored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dims = b.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = b.filter(pa.array(dims == dim))
            a, c = (unit_rows(_matrix(part.column(n), int(dim))) for n in ("query_vec", "vector"))
            yield pa.RecordBatch.from_arrays(
                [part.column("qid"), part.column("id"), pa.array(np.round(np.einsum("ij,ij->i", a, c), PLACES))],
                names=["qid", "id", "similarity"])
