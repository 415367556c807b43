"""The source divergence audit against SQL and brute force."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from geoloom.llm import divergence, queries
from tests.llm.test_operators import all_docs, odd_docs

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def rows_by_hand(docs, fewest, shown):
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for r in docs:
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        counts[r.lang or "", r.source or ""].update(terms)
        seen[r.lang or ""].update(set(terms))
    out = []
    for lang in seen:
        kept = sorted(t for t, n in seen[lang].items() if n >= fewest)
        groups = {s: c for (g, s), c in counts.items() if g == lang}

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        of = {s: shares(c) for s, c in groups.items()}
        whole = shares(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(sum(abs(of[s][t] - of[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(of[s][t] - whole[t], t) for t in kept if groups[s][t] and of[s][t] > whole[t]]
            for part, each, most in (("pair", pairs, len(pairs)), ("term", terms, shown)):
                ranked = sorted(each, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("fewest", [1, 5, 30, 10_000])
def test_divergence(spark, sf_dir, fewest):
    docs = all_docs(spark, sf_dir)
    rows = divergence.divergence(docs, fewest, 20).collect()
    assert sorted(map(tuple, rows)) == rows_by_hand(docs.collect(), fewest, 20)


def test_odd_rows(spark):
    for docs in (odd_docs(spark), odd_docs(spark).limit(0), odd_docs(spark).withColumn("text", F.lit(None).cast("string"))):
        assert sorted(map(tuple, divergence.divergence(docs, 1).collect())) == rows_by_hand(docs.collect(), 1, 50)


def test_counts_beyond_a_long(spark):
    numbers = [(0, 1, 1), (10**13, 3 * 10**13, 10**6), (7, 9_007_199_254_740_993, 12345)]
    rows = spark.createDataFrame([*numbers, (0, 0, 0)], "n long, total long, v long").select(divergence.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()
    assert [r.p for r in rows] == [*(1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in numbers), None]


def test_hands_on_in_pieces(spark, sf_dir, monkeypatch):
    import pandas as pd

    docs = all_docs(spark, sf_dir).toPandas().fillna("")
    batches = lambda: (docs.iloc[i : i + 20] for i in range(0, len(docs), 20))
    added = lambda frames: pd.concat(frames).astype({"n": int, "docs": int}).groupby(["lang", "source", "term"]).sum().to_dict()
    whole = added(divergence._counted(batches()))
    monkeypatch.setattr(divergence, "MOST_HELD", 100)
    parts = list(divergence._counted(batches()))
    assert len(parts) > 5
    assert added(parts) == whole


@pytest.mark.parametrize("name", ["op12_periodic_runs", "op13_source_divergence"])
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    said = con.execute(queries.ORACLE_SQL[name])
    order = [[d[0] for d in said.description].index(c) for c in df.columns]
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in said.fetchall()), key=key)
