"""The pipeline's stages against brute force."""

import re

import numpy as np
import public_tokenizers

import corpus_pipeline
from geoloom.llm import mixing, neardup, quality, tokens
from geoloom.llm.common import read_table
from geoloom.llm.queries import trusted_ids
from tests.llm.test_operators import WORD, groups_by_hand, odd_docs, rules_by_hand


def test_stages(spark, sf_dir, tmp_path):
    docs = read_table(spark, sf_dir, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "secret_scans", "source_mix", "bpe_encoding"]

    good = stages["quality_rules"](spark, docs, sf_dir)
    good.write.parquet(str(tmp_path / "good"))
    good = spark.read.parquet(str(tmp_path / "good"))
    weights = quality.bucket_weights(docs, trusted_ids(spark, sf_dir))
    scores = {r.doc_id: r.score for r in quality.judge(docs, weights).collect()}
    want = {r.doc_id for r in docs.collect() if not rules_by_hand(r.text or "")[-1] and scores[r.doc_id] >= quality.LEAST_SCORE}
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns

    single = stages["near_duplicates"](spark, good, sf_dir)
    single.write.parquet(str(tmp_path / "single"))
    single = spark.read.parquet(str(tmp_path / "single"))
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in single.collect()} == {d for d, _, _, kept in groups_by_hand(rows) if kept}

    clean = stages["secret_scans"](spark, single, sf_dir)
    clean.write.parquet(str(tmp_path / "clean"))
    clean = spark.read.parquet(str(tmp_path / "clean"))
    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert re.fullmatch(".*".join(map(re.escape, r.text.split("[SECRET]"))), before[r.doc_id], re.S)
        assert r.n_chars == len(r.text)

    mixed = stages["source_mix"](spark, clean, sf_dir)
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(d for d, c in copies.items() for _ in range(c))

    library = tokens.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in clean.collect()}
    for r in stages["bpe_encoding"](spark, mixed, sf_dir).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_stages_take_odd_rows(spark, sf_dir):
    for docs in (odd_docs(spark), odd_docs(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf_dir).columns == docs.columns
            stage(spark, docs, sf_dir).count()


def test_blank_texts_are_no_copies(spark):
    assert not any(WORD.search(t or "") for t in ("", None, " \n"))
    docs = spark.createDataFrame([(1, ""), (2, None), (3, " ")], "doc_id long, text string")
    assert neardup.keep_one(docs).count() == 3
