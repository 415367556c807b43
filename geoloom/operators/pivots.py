"""Exact nearest neighbours of many queries by a pivot index, joined in Spark.

Some library vectors are pivots. Every vector belongs to the cell of its
nearest pivot and, by its distance to it, to a ring of the cell. The triangle
inequality bounds from below how near a ring's vectors can be to a query:

1. Distances to pivots alone give each query a first bound on its k-th
   neighbour, and its home ring, which is searched and makes the bound tight.
2. Only rings that may hold something nearer are searched after that.

Queries meet rings in a join; neither is gathered. Rings are of bounded size,
and a ring that many queries visit is met by blocks of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.operators.lineage import written

#: Pivots are as many as the root of the number of vectors, up to this; they go to every task.
MOST_PIVOTS = 512
#: Vectors of a ring, and queries that meet it at once, about.
RING, BLOCK = 4096, 1024
#: Values of any array that a task works on, about.
MOST_CELLS = 500_000
#: Bounds are widened by this share against rounding.
SLACK = 1e-9

_PART = ["cell", "ring", "salt"]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x to all rows of y, by differences."""
    out = np.empty((len(x), len(y)))
    for k, p in enumerate(y):
        d = x - p
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return np.sqrt(out, out=out)


def _sliced(batches: Iterator[pd.DataFrame], wide: int) -> Iterator[pd.DataFrame]:
    """The rows of all batches, so few at a time that `wide` values for each are about MOST_CELLS."""
    step = max(1, MOST_CELLS // wide)
    for pdf in batches:
        for i in range(0, len(pdf), step):
            yield pdf.iloc[i : i + step]


def _draw_pivots(library: DataFrame, n: int) -> np.ndarray:
    """Different vectors, drawn by a hash of their ids; at most MOST_PIVOTS of them reach the driver."""
    wanted = int(min(MOST_PIVOTS, max(1, np.sqrt(n))))
    drawn = library.orderBy(F.xxhash64("n"), "n").limit(wanted).toPandas()
    return np.unique(_matrix(drawn["v"]), axis=0)


def _in_cells(rows: DataFrame, key: str, pivots: np.ndarray) -> DataFrame:
    """rows(key, v) with cell, the nearest pivot, and dist to it."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _sliced(batches, len(pivots)):
            d = _distances(_matrix(pdf["v"]), pivots)
            yield pdf.assign(cell=d.argmin(axis=1), dist=d.min(axis=1))

    return rows.mapInPandas(place, f"{key} long, v array<double>, cell int, dist double")


def _with_rings(library: DataFrame, cells: DataFrame) -> DataFrame:
    """library with ring: bands of equal width round the pivot, as many as the cell's size asks for."""
    sized = cells.select("cell", "lo", F.greatest((F.col("hi") - F.col("lo")), F.lit(1e-300)).alias("width"), F.ceil(F.col("n_cell") / RING).alias("rings"))
    # One row for each pivot.
    ring = F.least(F.floor((F.col("dist") - F.col("lo")) / F.col("width") * F.col("rings")), F.col("rings") - 1).cast("int")
    return library.join(F.broadcast(sized), "cell").withColumn("ring", ring).drop("lo", "width", "rings")


def _bounded(queries: DataFrame, pivots: np.ndarray, near: dict[int, np.ndarray], k: int) -> DataFrame:
    """queries(q, v) with bound: a distance within which k library vectors lie for sure, by way of the pivots; infinite if there are fewer."""

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _sliced(batches, max(1, sum(map(len, near.values())))):
            d = _distances(_matrix(pdf["v"]), pivots)
            ways = np.concatenate([d[:, [cell]] + dist for cell, dist in near.items()], axis=1)
            least = np.partition(ways, k - 1, axis=1)[:, k - 1] if ways.shape[1] >= k else np.full(len(d), np.inf)
            yield pd.DataFrame({"q": pdf["q"], "v": pdf["v"], "cell": d.argmin(axis=1), "dist": d.min(axis=1), "bound": least})

    return queries.mapInPandas(bound, "q long, v array<double>, cell int, dist double, bound double")


def _visits(queries: DataFrame, pivots: np.ndarray) -> DataFrame:
    """For each query(q, v, home, home_ring, bound) the cells that may hold a vector within its bound: q, v, home, home_ring, bound, cell, dist."""
    apart = _distances(pivots, pivots)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A query may visit all cells, each time with its vector.
        for pdf in _sliced(batches, len(pivots) * pivots.shape[1]):
            d = _distances(_matrix(pdf["v"]), pivots)
            home = d.argmin(axis=1)
            # A vector of another cell lies beyond the plane halfway between the two pivots.
            with np.errstate(divide="ignore", invalid="ignore"):
                beyond = (d**2 - d.min(axis=1)[:, None] ** 2) / (2 * apart[home])
            beyond[np.arange(len(d)), home] = 0.0
            row, cell = np.nonzero(beyond <= (pdf["bound"].to_numpy() * (1 + SLACK) + SLACK * (1 + d.max(axis=1)))[:, None])
            yield pdf.iloc[row].assign(cell=cell.astype(np.int32), dist=d[row, cell])

    return queries.mapInPandas(choose, "q long, v array<double>, home int, home_ring int, bound double, cell int, dist double")


def _searched(visits: DataFrame, library: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors of each ring part to each query that visits it: q, neighbour, d2."""

    def nearest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            y, ids = _matrix(held["v"]), held["n"].to_numpy(np.int64)
            for q, v in zip(asked["q"], asked["v"], strict=True):
                d = y - np.asarray(v, np.float64)
                d2 = np.einsum("ij,ij->i", d, d)
                some = np.flatnonzero(d2 <= np.partition(d2, k - 1)[k - 1]) if len(d2) > k else np.arange(len(d2))
                best = some[np.lexsort((ids[some], d2[some]))[:k]]
                out.append(pd.DataFrame({"q": q, "neighbour": ids[best], "d2": d2[best]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "neighbour": [], "d2": []})

    blocks = visits.groupBy(*_PART).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asked = visits.join(blocks, _PART).withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int"))
    held = library.join(blocks, _PART).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = asked.select(*_PART, "block", "q", "v").groupBy(*_PART, "block")
    right = held.select(*_PART, "block", "n", "v").groupBy(*_PART, "block")
    return left.cogroup(right).applyInPandas(nearest, "q long, neighbour long, d2 double")


def knn_join(queries: DataFrame, library: DataFrame, k: int, query_id: str = "qid", library_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The k nearest library vectors of each query, and what was compared to find them.

    First: query_id, rank from 1, neighbour, d2; ties by the smaller id. Query
    ids are unique; library ids are told apart by the caller. Rows with a null
    id or vector are left out; a query meets fewer than k where the library has
    fewer. Second: one row with n_queries, n_vectors, and compared, the pairs
    of vectors whose distance was taken, without those to pivots.
    """
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).where("q is not null and v is not null")
    given = library.select(F.col(library_id).cast("long").alias("n"), F.col(vector).cast("array<double>").alias("v")).where("n is not null and v is not null")
    n_vectors, n_queries = given.count(), asked.count()
    spark = queries.sparkSession
    if not n_vectors or not n_queries:
        none = spark.createDataFrame([], f"{query_id} long, rank int, neighbour long, d2 double")
        return none, spark.createDataFrame([(n_queries, n_vectors, 0)], "n_queries long, n_vectors long, compared long")
    pivots = _draw_pivots(given, n_vectors)
    placed = written(_in_cells(given, "n", pivots), "knn-cells")

    # What reaches the driver has a row for each pivot, and k for each.
    of_cell = Window.partitionBy("cell").orderBy("dist")
    nearest = placed.select("cell", "dist").withColumn("place", F.row_number().over(of_cell)).where(F.col("place") <= k).toPandas()
    near = {int(c): g["dist"].to_numpy() for c, g in nearest.groupby("cell")}
    cells = placed.groupBy("cell").agg(F.count("*").alias("n_cell"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))

    ringed = _with_rings(placed, cells)
    rings = ringed.groupBy("cell", "ring").agg(F.count("*").alias("n_ring"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).withColumn("salts", F.ceil(F.col("n_ring") / RING).cast("int"))
    rings = written(rings, "knn-rings")
    # A ring that is too full, as of equal vectors, is dealt into parts.
    held = ringed.join(rings.select("cell", "ring", "salts"), ["cell", "ring"]).withColumn("salt", F.pmod(F.xxhash64("n"), F.col("salts")).cast("int"))
    held = written(held.select("n", "v", *_PART), "knn-parts")
    in_parts = lambda rows: rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    # The home ring is the cell's ring that is nearest to the query's own distance.
    bounded = written(_bounded(asked, pivots, near, k), "knn-queries")
    outside = F.greatest(F.col("lo") - F.col("dist"), F.col("dist") - F.col("hi"), F.lit(0.0))
    at_home = bounded.join(rings, "cell").groupBy("q").agg(F.min(F.struct(outside.alias("outside"), "ring", "salts")).alias("home"))
    homes = written(bounded.join(at_home, "q").select("q", "v", "bound", "cell", F.col("home.ring").alias("ring"), F.col("home.salts").alias("salts")), "knn-homes")
    first = written(_searched(in_parts(homes), held, k), "knn-found")

    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d2", "neighbour"))).where(F.col("rank") <= k)
    kth = ranked(first).where(F.col("rank") == k).select("q", F.sqrt("d2").alias("kth"))
    tight = homes.join(kth, "q", "left").select("q", "v", F.col("cell").alias("home"), F.col("ring").alias("home_ring"), F.least("bound", F.coalesce("kth", "bound")).alias("bound"))
    wide = F.col("bound") * (1 + SLACK) + SLACK * (1 + F.col("dist"))
    reached = (F.col("dist") - F.col("hi") <= wide) & (F.col("lo") - F.col("dist") <= wide)
    further = _visits(tight, pivots).join(rings, "cell").where(reached & ~((F.col("cell") == F.col("home")) & (F.col("ring") == F.col("home_ring"))))
    further = written(in_parts(further).select("q", "v", *_PART, "n_ring", "salts"), "knn-visits")
    found = ranked(first.union(_searched(further, held, k))).select(F.col("q").alias(query_id), "rank", "neighbour", "d2")

    compared = homes.join(rings, ["cell", "ring"]).select("n_ring").union(further.where("salt = 0").select("n_ring")).agg(F.sum("n_ring").alias("compared"))
    return found, compared.select(F.lit(n_queries).cast("long").alias("n_queries"), F.lit(n_vectors).cast("long").alias("n_vectors"), "compared")
