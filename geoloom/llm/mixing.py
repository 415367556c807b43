"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.llm.common import WORD, text_or_empty, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
#: Ranks are told apart by histogram first; only the bucket at the limit is sorted.
BUCKETS = 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """Targets for sizes(source, source_size, mean_size): these columns and target.

    Sources in code point order, null last, weigh `weights` in turn and share
    `share` times all sizes. A target stops at `most` times its source's size;
    the excess is shared again by weight. That end state has one level: the
    sources whose cap lies below level * weight are capped, the others get
    level * weight. All windows here run over one row for each source.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = sizes.select("source", "source_size", "mean_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")).alias("weight"))
    weighed = weighed.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy(F.lit(1))
    rising = everything.orderBy("ratio", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levels = weighed.withColumns({"level": level, "at": F.row_number().over(rising)})
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(everything)
    levels = levels.withColumn("level", fits["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return levels.select("source", "source_size", "mean_size", target.alias("target"))


def _uniform(seed: str) -> Column:
    """A number inside (0, 1) fixed by doc_id and seed."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, seed: str = "mix") -> DataFrame:
    """Decides how many words the mix takes of each row of docs(doc_id, text, source).

    Of target / source_size, the whole part is certain: so many copies of every
    document. The rest is drawn: a document's odds to be included are those of
    the remaining share, times its size over the source's mean size, held to
    0.5 to 2. Documents rank by random odds over inclusion odds, and the mix
    takes them in that order up to the words the source still needs; the last
    one is taken if that comes nearer.

    Returns row_id, doc_id, source, size, source_size, target, copies, taken.
    Null text has size 0 and takes nothing. A null source is a source of its
    own, the last. Repeated rows are separate documents with equal ranks. An
    empty table gives no rows. Other columns of docs are ignored.

    A source may hold any share of the rows: a histogram of the ranks finds the
    bucket in which its need ends, and only that bucket is sorted.
    """
    base = written(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        ),
        "mix-sizes",
    )
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("size").alias("mean_size"))
    shares = source_targets(totals, weights, share, most).withColumnRenamed("source", "of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = shares.withColumn("whole", F.floor(ratio)).withColumn("rest", ratio - F.floor(ratio)).withColumn("need", F.col("target") - F.floor(ratio) * F.col("source_size"))
    shares = written(shares, "mix-targets")

    ranked = base.join(shares, base["source"].eqNullSafe(shares["of"])).withColumn("u", _uniform(seed))
    lean = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("size") / F.col("mean_size")))
    odds = F.col("rest") / (1 - F.col("rest")) * lean
    ranked = ranked.withColumn("rank", F.when((F.col("rest") > 0) & (F.col("size") > 0), F.col("u") / (1 - F.col("u")) / odds))
    ranked = ranked.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS))

    counts = ranked.where(F.col("rank").isNotNull()).groupBy("of", "bucket").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    along = Window.partitionBy("of").orderBy("bucket")
    ends = counts.withColumn("before", F.sum("words").over(along) - F.col("words"))
    ends = ends.where((F.col("before") < F.col("need")) & (F.col("before") + F.col("words") >= F.col("need")))
    ends = written(ends.select(F.col("of").alias("end_of"), F.col("bucket").alias("end_bucket"), "before"), "mix-ends")

    marked = ranked.join(ends, F.col("of").eqNullSafe(F.col("end_of")), "left")
    at_end = F.col("bucket") == F.col("end_bucket")
    order = Window.partitionBy("of").orderBy("rank", "doc_id", "size", "row_id")
    edge = marked.where(at_end).withColumn("sofar", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    edge = edge.withColumn("drawn", (F.col("sofar") < F.col("need")) & (2 * (F.col("need") - F.col("sofar")) >= F.col("size"))).drop("sofar")
    rest = marked.where(at_end.isNull() | ~at_end).withColumn("drawn", F.coalesce(F.col("bucket") < F.col("end_bucket"), F.lit(False)))
    copies = (F.col("whole") + F.col("drawn").cast("long")).cast("long")
    return edge.unionByName(rest).select("row_id", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, seed: str = "mix") -> DataFrame:
    """docs with each row as often as `mix` takes it, rows taken not at all left out; all columns pass through.

    Copies belong to doc_id, source and size: rows that share all three take
    the most copies of any of them. Texts are shuffled once.
    """
    taken = mix(docs, weights, share, most, seed).groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size")).agg(F.max("copies").alias("__copies"))
    keyed = docs.withColumn("__words", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.col("source").cast("string").eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size"))
    rows = keyed.join(taken.where("__copies > 0"), on)
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")).drop("__copy")
