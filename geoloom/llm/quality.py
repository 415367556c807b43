"""Quality rules with an importance score, in DataFrame functions only.

Plain rules count symbols, repeated lines and repeated word windows. The score
is the log-likelihood ratio of a document's hashed word n-grams between two
multinomials, that of trusted documents and that of the whole corpus, for each
n-gram. Every document is thresholded on it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import SPACES, let, text_or_empty, words_of, written

#: Buckets that n-grams are hashed to.
N_BUCKETS = 10_000
#: Added to each bucket's count.
SMOOTHING = 1.0
#: Documents whose score is below this are rejected, where labels do not ask for another threshold. Scores of both
#: labelled groups rise and fall with the size of the corpus, so no constant parts them at every size.
LEAST_SCORE = -0.1
#: Thresholds that are tried lie so many to a unit of the score.
SCORE_STEPS = 10_000
#: Trusted ids are broadcast up to this many; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000

SYMBOLS = "#*$%&|<>"
#: What judge() adds before its verdict, in the order of its columns.
MEASURES = ("word_chars", "n_symbols", "n_dup_lines", "n_words", "n_repeat_words", "score", "base_failed")


def _buckets(words: Column, n_buckets: int) -> Column:
    """The buckets of a document's words and pairs of adjacent words."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(n_buckets)).cast("int"))
    pairs = F.transform(words, lambda w, i: F.when(i > 0, F.pmod(F.xxhash64(F.get(words, i - 1), w), F.lit(n_buckets)).cast("int")))
    return F.concat(single, F.filter(pairs, lambda b: b.isNotNull()))


def _repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more in the document.

    Windows are compared by 64-bit hashes within one document. Positions of
    repeated windows come from one sort, so a text costs n log n at most.
    """

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda x, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), x - F.get(starts, i - 1))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def repeated(sorted_windows: Column) -> Column:
        same = lambda x, i: (F.get(sorted_windows, i - 1)["h"] == x["h"]) | (F.get(sorted_windows, i + 1)["h"] == x["h"])
        starts = F.transform(F.filter(sorted_windows, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])
        return let(F.sort_array(starts), covered)

    def count(hashes: Column) -> Column:
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(tagged, repeated))

    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return let(windows, count)


def _rule_counts(text: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0)
    return {
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def bucket_weights(docs: DataFrame, trusted_ids: DataFrame, n_buckets: int = N_BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """log(p_trusted / p_corpus) of each bucket, counted over all of docs; zeros if no trusted document has a word.

    What reaches the driver is one row for each bucket. The n-grams are counted
    in the tasks that read them, so a hot bucket is one partial row for each.
    """
    ids = trusted_ids.select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    marked = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("trusted_id"), "left")
    grams = marked.select(F.col("trusted_id").isNotNull().cast("long").alias("trusted"), F.explode(let(words_of(text_or_empty()), lambda w: _buckets(w, n_buckets))).alias("bucket"))
    counted = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("trusted")).collect()
    raw, target = [0] * n_buckets, [0] * n_buckets
    for r in counted:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["trusted"]
    if not sum(target):
        return [0.0] * n_buckets
    share = lambda c, all_: math.log((c + smoothing) / (all_ + smoothing * n_buckets))
    n_raw, n_target = sum(raw), sum(target)
    return [round(share(t, n_target) - share(r, n_raw), 4) for t, r in zip(target, raw, strict=True)]


def judge(docs: DataFrame, weights: list[float], least_score: float = LEAST_SCORE) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed and kept.

    base_failed: fewer than 50 words, or over half of them in repeated
    three-word windows. kept: not base_failed, and score >= least_score, where
    score is the mean weight of the document's n-grams (0 without any). Null
    text counts as empty and fails. Columns of docs with these names are
    replaced; others pass through. Rows are judged one by one: repeated rows
    get the same verdict, an empty table stays empty.
    """
    table = F.split(F.lit(",".join(f"{w:g}" for w in weights)), ",").cast("array<double>")
    mean = lambda b: F.when(F.size(b) == 0, 0.0).otherwise(F.aggregate(b, F.lit(0.0), lambda a, x: a + F.element_at(table, x + 1)) / F.size(b))
    measures = let(
        words_of(text_or_empty()),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
            let(_buckets(w, len(weights)), mean).alias("score"),
        ),
    )
    made = docs.withColumns({"__measures": measures, **_rule_counts(text_or_empty())})
    made = made.withColumns({n: F.col(f"__measures.{n}") for n in ("n_words", "n_repeat_words", "score")}).drop("__measures")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    made = made.withColumn("base_failed", failed)
    return made.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least_score))


def parting_score(scored: DataFrame, labels: DataFrame, default: float = LEAST_SCORE, steps: int = SCORE_STEPS) -> float:
    """The threshold that best parts scored(doc_id, score, base_failed) by labels(doc_id, quality 0 or 1).

    Among rows that pass the base rules the share of poor ones that stay and
    the share of good ones that go are added up for every multiple of 1 / steps.
    default is returned if no threshold does better, or if one of the groups is
    empty; else the middle of the longest run of best thresholds. All labelled
    rows count, and what reaches the driver is one row for each step that has any.
    """
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("labelled_id"), "quality").distinct()
    passed = scored.where("not base_failed").select("doc_id", "score")
    step = F.floor(F.col("score") * steps)
    counted = passed.join(known, F.col("doc_id") == F.col("labelled_id")).groupBy(step.alias("step")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("poor"))
    rows = sorted((r["step"], r["good"], r["poor"]) for r in counted.collect())
    n_good, n_poor = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not n_good or not n_poor:
        return default
    # Thresholds from one step with rows to the next: (first, last, loss); below all rows every poor one stays.
    gone, stay, runs, first = 0, n_poor, [], -math.inf
    for at, good, poor in rows:
        runs.append((first, at, gone * n_poor + stay * n_good))
        gone, stay, first = gone + good, stay - poor, at + 1
    runs.append((first, math.inf, gone * n_poor + stay * n_good))
    least = min(r[2] for r in runs)
    best = [r for r in runs if r[2] == least]
    if any(low <= default * steps <= high for low, high, _ in best):
        return default
    low, high, _ = max(best, key=lambda r: r[1] - r[0])
    low, high = max(low, rows[0][0]), min(high, rows[-1][0] + 1)
    return (low + high) // 2 / steps


def judge_by_labels(docs: DataFrame, weights: list[float], labels: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of judge(), with kept by the threshold that parts the labelled documents best.

    Documents are scored once; the scores are written and read again, first
    with the labels and then with the threshold.
    """
    scored = written(judge(docs, weights).select(*columns), "quality-scores")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= parting_score(scored, labels)))
