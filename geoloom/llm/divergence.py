"""How far the sources of a language diverge in their terms.

Every group (language, source) gives each kept term of its language a smoothed
share in whole billionths. The distance of two groups is the sum of absolute
differences over all kept terms, most of which neither or one of them has.
Those are not visited one by one:

* a term that only one group has costs the difference to the other's share of
  a term it lacks, so a histogram of the group's counts prices all of them;
* terms that both have are met by a join of the terms' posting lists, which
  puts right what the two histograms said about them;
* terms that neither has differ by one constant, times their number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.llm.common import small_batches, written

#: Documents of its language that a kept term is in, at least.
FEWEST_DOCS = 30
#: Added to each count, and the unit of a share.
SMOOTHING, UNIT = 5, 1_000_000_000
#: Terms that a group has more often than its language, at most so many are shown.
SHOWN = 50
#: Entries that a task counts up before it hands them on.
MOST_HELD = 1_000_000

#: Terms are runs of letters and of all that is beyond ASCII; in UTF-8 each such byte is above 0x7F.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
COUNTED = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences of terms and documents with them, by group, added up over many documents of a task."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed_on() -> pd.DataFrame:
        rows = [(lang, source, term.decode(), n, docs[term]) for (lang, source), (found, docs) in held.items() for term, n in found.items()]
        held.clear()
        return pd.DataFrame(rows, columns=[c.split()[0] for c in COUNTED.split(", ")])

    for pdf in batches:
        for lang, source, text in zip(pdf["lang"], pdf["source"], pdf["text"], strict=True):
            terms = text.encode().translate(_TERM_BYTES).split()
            found, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found.update(terms)
            docs.update(set(terms))
        if sum(len(found) for found, _ in held.values()) > MOST_HELD:
            yield handed_on()
    yield handed_on()


def kept_terms(docs: DataFrame, fewest_docs: int = FEWEST_DOCS) -> DataFrame:
    """lang, source, term, n of the terms that are in fewest_docs documents of their language or more.

    Also lang_n, the occurrences in the language, and first, true in one of a
    term's rows. One shuffle by language and term: each task hands on its own
    sums, so a frequent term is one row a task and group.
    """
    small_batches(docs.sparkSession)
    parts = docs.select("lang", "source", "text").mapInPandas(_counted, COUNTED).repartition("lang", "term")
    each = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    whole = each.withColumns({"lang_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1})
    return whole.where(F.col("lang_docs") >= fewest_docs).select("lang", "source", "term", "n", "lang_n", "first")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * terms)), exact at any size; null without terms."""
    wide = lambda c, kind: c.cast(f"decimal({kind},0)")
    over = wide(F.lit(UNIT), 10) * wide(count + SMOOTHING, 20)
    return F.when(terms > 0, F.call_function("div", over, wide(total + SMOOTHING * terms, 20)) + 1)


def divergence(docs: DataFrame, fewest_docs: int = FEWEST_DOCS, shown: int = SHOWN) -> DataFrame:
    """Distances between the sources of each language, and the terms that each source has more often than its language.

    docs(text, lang, source): nulls count as ''. Terms are runs of ASCII
    letters and characters beyond ASCII, only A-Z lowered; a language keeps
    those in fewest_docs of its documents or more. Returns lang, source, part,
    item, value, rank. Part 'pair' has a row for each other source of the
    language (value: the distance, 0 where the language keeps no term), part
    'term' the terms whose share exceeds the language's, up to rank `shown`.
    Ranks run from 1 by value descending, then item ascending in UTF-8.

    A group without terms takes part in pairs. Repeated rows count as often as
    they stand. An empty table gives no rows. Other columns are ignored.
    """
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = written(kept_terms(plain, fewest_docs), "divergence-terms")
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    groups = plain.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "lang_total", "total", "support"])
    # The share of a term that the group lacks.
    groups = written(groups.withColumn("none", F.coalesce(share(F.lit(0), F.col("total"), F.col("terms")), F.lit(0))), "divergence-groups")

    own = groups.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "terms", "total", "lang_total", "none")
    priced = kept.join(own, (F.col("lang") == F.col("of_lang")) & (F.col("source") == F.col("of_source"))).withColumns({"p": share(F.col("n"), F.col("total"), F.col("terms")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))})
    priced = written(priced.select("lang", "source", "term", "p", "q", "none"), "divergence-shares")

    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    named = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    terms = ranked(priced.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))).where(F.col("rank") <= shown)
    return named(ranked(_distances(groups, priced)), "pair").union(named(terms, "term"))


def _distances(groups: DataFrame, priced: DataFrame) -> DataFrame:
    """lang, source, item, value: the distance of each ordered pair of a language's sources."""
    side = lambda mark: groups.select("lang", F.col("source").alias(mark), F.col("none").alias(f"none_{mark}"), F.col("support").alias(f"support_{mark}"), "terms")
    pairs = side("a").join(side("b").drop("terms"), "lang").where("a < b")
    neither = (F.col("terms") - F.col("support_a") - F.col("support_b")) * F.abs(F.col("none_a") - F.col("none_b"))

    # One-sided terms: a group's histogram of shares against what each other source gives a term it lacks.
    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("none").alias("none_other"))
    one_sided = histogram.join(others, "lang").where("source != other").groupBy("lang", "source", "other").agg(F.sum(F.col("n") * F.abs(F.col("p") - F.col("none_other"))).alias("cost"))
    one_sided = one_sided.groupBy("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")).agg(F.sum("cost").alias("one_sided"))

    # Terms that both have, from the posting lists: what the histograms and the constant said goes, their difference comes.
    posted = lambda mark: priced.select("lang", "term", F.col("source").alias(mark), F.col("p").alias(f"p_{mark}"), F.col("none").alias(f"zero_{mark}"))
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    put_right = gap("p_a", "p_b") - gap("p_a", "zero_b") - gap("zero_a", "p_b") + gap("zero_a", "zero_b")
    both = posted("a").join(posted("b"), ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(put_right).alias("both"))

    found = pairs.join(one_sided, ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left")
    value = neither + F.coalesce("one_sided", F.lit(0)) + F.coalesce("both", F.lit(0))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return found.select("lang", value.alias("value"), F.explode(ways).alias("w")).select("lang", "w.source", "w.item", "value")
