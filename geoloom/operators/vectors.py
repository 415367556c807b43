"""Nearest vectors, codebooks, and statistics of how codes are used."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions.columns import squared_distance
from geoloom.operators.lineage import written
from geoloom.operators.pivots import knn_join

#: Query vectors that go to every task at most; more are joined.
QUERY_BLOCK = 4096
#: Distances that a task holds at once.
MOST_CELLS = 500_000
#: Codes that are held in one array in every task.
MOST_CODES = 65_536


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in rows])


def _square_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By differences, in slices of y, so that no value is negative and equal vectors give 0."""
    out = np.empty((len(x), len(y)))
    for k in range(len(y)):
        d = x - y[k]
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


def knn(queries: DataFrame, library: DataFrame, k: int, query_id: str = "qid", library_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest library vectors of each query: query_id, rank from 1, neighbour, d2; ties by the smaller id.

    Up to QUERY_BLOCK queries go to every task, which keeps the k best of its
    part of the library; those meet in one window for each query, k rows for
    each task. More queries are joined by pivots instead (`knn_join`).
    """
    numbered = queries.select(F.col(query_id).cast("long").alias("q"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    mine = numbered.limit(QUERY_BLOCK + 1).toPandas()
    if len(mine) > QUERY_BLOCK:
        return knn_join(queries, library, k, query_id, library_id, vector)[0]
    if not len(mine):
        return queries.sparkSession.createDataFrame([], f"{query_id} long, rank int, neighbour long, d2 double")
    ids, points = mine["q"].to_numpy(np.int64), _matrix(mine["v"])

    step = max(1, MOST_CELLS // len(ids))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # What is held are the k best so far of each query, query after query.
        held = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        bound = np.full(len(ids), np.inf)
        for pdf in batches:
            pdf = pdf[pdf["v"].notna()]
            for i in range(0, len(pdf), step):
                some = pdf.iloc[i : i + step]
                d2 = _square_distances(_matrix(some["v"]), points)
                row, of = np.nonzero(~(d2 > bound))
                q, d, n = (np.concatenate(x) for x in zip(held, (of, d2[row, of], some["n"].to_numpy(np.int64)[row]), strict=True))
                order = np.lexsort((n, d, q))
                q, d, n = q[order], d[order], n[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                bound[q[place == k - 1]] = d[place == k - 1]
                held = tuple(x[place < k] for x in (q, d, n))
        if len(held[0]):
            yield pd.DataFrame({"q": ids[held[0]], "neighbour": held[2], "d2": held[1]})

    found = library.select(F.col(library_id).cast("long").alias("n"), F.col(vector).alias("v")).mapInPandas(best, "q long, neighbour long, d2 double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d2", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_id), "rank", "neighbour", "d2")


def _codes(codebook: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Levels of codebook(level, code, vec) as arrays; the number of codes is checked before they are gathered."""
    n = codebook.count()
    if n > MOST_CODES:
        raise ValueError(f"{n} codes; at most {MOST_CODES} fit in every task")
    rows = codebook.orderBy("level", "code").toPandas()
    sizes = {len(v) for v in rows["vec"]}
    if len(sizes) > 1:
        raise ValueError("codes of different lengths")
    return {int(k): (g["code"].to_numpy(np.int64), _matrix(g["vec"])) for k, g in rows.groupby("level")}


def encode(rows: DataFrame, codebook: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The code of each vector on each level: key, level, code, d2; each level encodes what the ones before left over.

    The nearest code wins, the smaller one on ties. The codebook is of checked
    size and goes to every task; no shuffle is needed.
    """
    levels = _codes(codebook)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["v"].notna()]
            if not len(pdf):
                continue
            rest = _matrix(pdf["v"])
            for level, (codes, vectors) in sorted(levels.items()):
                d = _square_distances(rest, vectors)
                best = d.argmin(axis=1)
                yield pd.DataFrame({"k": pdf["k"].to_numpy(), "level": level, "code": codes[best], "d2": d[np.arange(len(best)), best]})
                rest = rest - vectors[best]

    return rows.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).mapInPandas(nearest, "k long, level int, code long, d2 double").withColumnRenamed("k", key)


def decode(codes: DataFrame, codebook: DataFrame, key: str = "vec_id") -> DataFrame:
    """The sum over levels of each key's code vectors: key, embedding. Codes that no codebook row has are left out; a key without any other is left out too.

    A key's codes meet in one row and are summed up as arrays in the task, if
    the codebook is small enough for every task; else by a join of its vectors.
    """
    if codebook.count() > MOST_CODES:
        each = codes.select(key, "level", "code").join(codebook, ["level", "code"]).select(key, F.posexplode("vec").alias("pos", "x"))
        summed = each.groupBy(key, "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
        return summed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("embedding"))
    levels = _codes(codebook)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            owner = np.repeat(np.arange(len(pdf)), [len(x) for x in pdf["level"]])
            if not len(owner):
                continue
            level, code = (np.concatenate([np.asarray(x, np.int64) for x in pdf[c]]) for c in ("level", "code"))
            total, known = None, np.zeros(len(pdf), bool)
            for k, (names, vectors) in levels.items():
                at = np.minimum(np.searchsorted(names, code), len(names) - 1)
                hit = (level == k) & (names[at] == code)
                total = np.zeros((len(pdf), vectors.shape[1])) if total is None else total
                np.add.at(total, owner[hit], vectors[at[hit]])
                known[owner[hit]] = True
            if known.any():
                yield pd.DataFrame({"k": pdf["k"][known].array, "embedding": list(total[known])})

    met = codes.groupBy(F.col(key).alias("k")).agg(F.collect_list(F.struct("level", "code")).alias("c")).select("k", F.col("c.level").alias("level"), F.col("c.code").alias("code"))
    kind = met.schema["k"].dataType.simpleString()
    return met.mapInPandas(add_up, f"k {kind}, embedding array<double>").withColumnRenamed("k", key)


def usage(codes: DataFrame, n_codes: int) -> DataFrame:
    """How often each of n_codes codes is used on each level, unused ones as 0: level, code, uses."""
    counts = codes.groupBy("level", "code").agg(F.count("*").alias("uses"))
    levels = counts.select("level").distinct()
    every = levels.select("level", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_codes - 1).cast("bigint"))).alias("code"))
    return every.join(counts, ["level", "code"], "left").select("level", "code", F.coalesce("uses", F.lit(0)).cast("bigint").alias("uses"))


def usage_metrics(used: DataFrame, top: int = 10) -> DataFrame:
    """Of each level: total, active codes, perplexity, used share, and the shares of the first and the `top` first codes."""
    level = Window.partitionBy("level")
    p = F.col("uses") / F.greatest(F.sum("uses").over(level), F.lit(1))
    ranked = used.withColumns({"p": p, "place": F.row_number().over(level.orderBy(F.col("uses").desc(), "code"))})
    return ranked.groupBy("level").agg(
        F.sum("uses").alias("total"), F.count_if(F.col("uses") > 0).alias("active"), F.exp(-F.sum(F.col("p") * F.log(F.greatest("p", F.lit(1e-10))))).alias("perplexity"),
        (F.count_if(F.col("uses") > 0) / F.count("*")).alias("used_share"), F.max("p").alias("top1_share"), F.sum(F.when(F.col("place") <= top, F.col("p")).otherwise(0.0)).alias("topk_share"),
    )


def sums_by_code(rows: DataFrame, codes: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Sum of the vectors of each code and position: level, code, pos, total, n.

    Each batch hands on one array for each code that it has; only those are
    summed up by position after the shuffle.
    """

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pairs, at = np.unique(pdf[["level", "code"]].to_numpy(np.int64), axis=0, return_inverse=True)
                v = _matrix(pdf["v"])
                total = np.zeros((len(pairs), v.shape[1]))
                np.add.at(total, at.ravel(), v)
                yield pd.DataFrame({"level": pairs[:, 0], "code": pairs[:, 1], "total": list(total), "n": np.bincount(at.ravel())})

    joined = rows.select(key, F.col(vector).alias("v")).where("v is not null").join(codes.select(key, "level", "code"), key).select("level", "code", "v")
    parts = joined.mapInPandas(add_up, "level int, code long, total array<double>, n long")
    each = parts.select("level", "code", "n", F.posexplode("total").alias("pos", "x"))
    return each.groupBy("level", "code", "pos").agg(F.sum("x").alias("total"), F.sum("n").alias("n"))


def ema_update(state: DataFrame, batch: DataFrame, decay: float = 0.99, epsilon: float = 1e-5) -> DataFrame:
    """A codebook's moving averages after a batch.

    state(code, size, pos, average) and batch(code, pos, n, total) give code,
    pos, size, average, vec: sizes are smoothed by Laplace before dividing.
    """
    both = state.join(batch.select("code", "pos", "n", "total"), ["code", "pos"], "left")
    moved = both.select("code", "pos", (F.col("size") * decay + F.coalesce("n", F.lit(0)) * (1 - decay)).alias("size"), (F.col("average") * decay + F.coalesce("total", F.lit(0.0)) * (1 - decay)).alias("average"))
    whole = moved.where("pos = 0").agg(F.sum("size").alias("t"), F.count("*").alias("k"))
    smoothed = (F.col("size") + epsilon) / (F.col("t") + F.col("k") * epsilon) * F.greatest("t", F.lit(1.0))
    # One row with the totals.
    return moved.join(F.broadcast(whole)).select("code", "pos", "size", "average", (F.col("average") / smoothed).alias("vec"))


def restart_dead(codebook: DataFrame, pool: DataFrame, least: float) -> DataFrame:
    """codebook(code, size, vec) with codes of size < least replaced by pool(pool_no, vec), reused in turn if it is small."""
    dead = codebook.where(F.col("size") < least)
    ranked = dead.withColumn("at", F.row_number().over(Window.orderBy("code")) - 1)
    # No more of the pool is ordered than there are dead codes.
    pool = pool.orderBy("pool_no").limit(dead.count())
    n = max(1, pool.count())
    numbered = pool.select((F.row_number().over(Window.orderBy("pool_no")) - 1).alias("p"), F.col("vec").alias("fresh"))
    fresh = ranked.join(numbered, F.pmod("at", F.lit(n)) == F.col("p")).select(F.col("code").alias("c"), "fresh")
    joined = codebook.join(fresh, F.col("code") == F.col("c"), "left")
    return joined.select("code", F.when(F.col("c").isNotNull(), F.lit(1.0)).otherwise(F.col("size")).alias("size"), F.coalesce("fresh", "vec").alias("vec"), F.col("c").isNotNull().alias("restarted"))


def norm_stats(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean, deviation, greatest absolute value of all elements, and least, greatest, mean and deviation of the norms."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    each = rows.select(
        norm.alias("norm"), F.size(vector).alias("n"), F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double")).alias("s"), F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double")))).alias("m")
    )
    total = F.sum("s") / F.sum("n")
    return each.agg(
        total.alias("mean"), F.sqrt(F.sum(F.col("norm") * F.col("norm")) / F.sum("n") - total * total).alias("std"), F.max("m").alias("absmax"),
        F.min("norm").alias("norm_min"), F.max("norm").alias("norm_max"), F.avg("norm").alias("norm_mean"), F.stddev_pop("norm").alias("norm_std"),
    )


def channel_stats(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean and population deviation of each position."""
    return rows.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))


def method_mismatches(rows: DataFrame, codebook: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """How often the code by exact differences is another than by the expanded form |x|^2 - 2xy + |y|^2 in single precision."""
    levels = _codes(codebook)
    codes, vectors = levels[min(levels)]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y = vectors.astype(np.float32)
        for pdf in batches:
            x = _matrix(pdf["v"])
            exact = _square_distances(x, vectors).argmin(axis=1)
            x32 = x.astype(np.float32)
            expanded = (x32 * x32).sum(axis=1)[:, None] - 2 * x32 @ y.T + (y * y).sum(axis=1)
            yield pd.DataFrame({"n": [len(x)], "mismatches": [int((expanded.argmin(axis=1) != exact).sum())], "negatives": [int((expanded < 0).sum())]})

    each = rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("v is not null").mapInPandas(compare, "n long, mismatches long, negatives long")
    return each.agg(F.sum("n").alias("n"), F.sum("mismatches").alias("mismatches"), F.sum("negatives").alias("negatives"))


def kmeans(rows: DataFrame, n_codes: int, rounds: int, level: int = 0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A codebook by Lloyd rounds from the vectors of the n_codes smallest keys: level, code, vec.

    A code that no vector has takes one of the vectors farthest from their
    codes. Each round is one scan with partial sums; the driver holds the
    codebook only.
    """
    spark = rows.sparkSession
    first = rows.where(F.col(vector).isNotNull()).orderBy(key).limit(n_codes).toPandas()
    vectors = _matrix(first[vector])
    schema = "level int, code long, vec array<double>"
    for _ in range(rounds):
        book = spark.createDataFrame([(level, i, v.tolist()) for i, v in enumerate(vectors)], schema)
        codes = written(encode(rows, book, key, vector), "kmeans-codes")
        means = sums_by_code(rows, codes, key, vector).toPandas()
        after = np.full_like(vectors, np.nan)
        after[means["code"].to_numpy(int), means["pos"].to_numpy(int)] = (means["total"] / means["n"]).to_numpy()
        empty = np.flatnonzero(np.isnan(after).any(axis=1))
        if len(empty):
            far = codes.orderBy(F.col("d2").desc(), key).limit(len(empty)).select(key)
            after[empty[: len(far.head(len(empty)))]] = _matrix(rows.join(F.broadcast(far), key).orderBy(key).toPandas()[vector])
            still = np.isnan(after).any(axis=1)
            after[still] = vectors[still]
        vectors = after
    return spark.createDataFrame([(level, i, v.tolist()) for i, v in enumerate(vectors)], schema)


def residual_kmeans(rows: DataFrame, n_levels: int, n_codes: int, rounds: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Codebooks of several levels, each fitted on what the levels before leave over."""
    rest, book = rows.select(key, F.col(vector)), None
    for level in range(n_levels):
        fitted = kmeans(rest, n_codes, rounds, level, key, vector)
        book = fitted if book is None else book.union(fitted)
        if level + 1 < n_levels:
            coded = encode(rest, fitted, key, vector).join(F.broadcast(fitted), ["level", "code"]).select(key, "vec")
            rest = written(rest.join(coded, key).select(key, F.zip_with(vector, "vec", lambda a, b: a.cast("double") - b).alias(vector)), "kmeans-rest")
    return book


def mean_pool(rows: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    return rows.groupBy(key, pos).agg(F.avg(value).alias("mean"))


def hash_order(key: Column, seed: int) -> Column:
    """A fixed random order of keys: a digest of key and seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows drawn without replacement; the same in every run."""
    return rows.withColumn("__order", hash_order(F.col(key), seed)).orderBy("__order", key).limit(n).drop("__order")


def strided_sample(indexed: DataFrame, m: int, index: str = "global_idx") -> DataFrame:
    """m evenly spread rows of a densely numbered table: numbers i * n div m."""
    n = indexed.count()
    hit = F.floor((F.col(index) * m + n - 1) / F.lit(n)) if n else F.lit(0)
    return indexed.where((F.floor(hit * n / m) == F.col(index)) & (hit < m))


def exact_nearest(rows: DataFrame, codebook: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """As one level of `encode`, in SQL expressions only; for small codebooks and for comparison."""
    if (n := codebook.count()) > MOST_CODES:
        raise ValueError(f"{n} codes; at most {MOST_CODES} go to every task")
    every = rows.select(key, F.col(vector).alias("v")).join(F.broadcast(codebook))
    return every.groupBy(key).agg(F.min(F.struct(squared_distance(F.col("v"), F.col("vec")).alias("d2"), "code")).alias("b")).select(key, F.col("b.code").alias("code"), F.col("b.d2").alias("d2"))
