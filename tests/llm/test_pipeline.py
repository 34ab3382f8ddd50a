import hashlib

import brute
import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from veilscan.llm import byte_bpe, quality_rules


def expected(docs, items):
    """The whole pipeline, plainly: doc_id -> text."""
    limits, line = quality_rules.NGRAM_LIMITS, quality_rules.LINE_LIMIT
    rows = [(i, t) for i, t in docs if brute.rules(t, limits, line)[-1]]
    label = brute.components(rows)
    rows = [(i, t) for i, t in rows if label[i] == i]
    gone = brute.repeated(rows)
    cut = []
    for i, t in rows:
        at, out = 0, []
        for c in t:
            n = len(c.encode())
            if not all(gone[i][at : at + n]):
                out.append(c)
            at += n
        cut.append((i, "".join(out)))
    plain = [brute.plain_words(t) for t in items]
    clean = {}
    for i, t in cut:
        w = brute.plain_words(t)
        grams = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        if not any(
            sum(tuple(p[k : k + 3]) in grams for k in range(len(p) - 2)) * 3 >= 0.6 * len(p) and brute.tile(p, w) >= 0.6 * len(p) for p in plain if len(p) >= 3
        ):
            clean[i] = t
    return clean


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = expected(docs, items)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert sorted(got) == sorted(want)
    ranks = {e: k for k, e in enumerate(byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.RANKS)))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, text in want.items():
        ids = plain.encode_ordinary(text)
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_columns_and_odd_rows(spark, sf_dir, make, odd_rows):
    docs = make(odd_rows)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        ids = [r.doc_id for r in out.collect()]
        assert None in ids and 2 in ids and 7 in ids
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, sf_dir).collect()} == {None, 1, 2, 3, 4, 7, 9}
    kept = corpus_pipeline.keep_good(spark, docs, sf_dir)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {4, 5}
    cut = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, sf_dir).collect()}
    assert cut[1].text is None and cut[4].n_chars == len(odd_rows[3][1]) and cut[5].text == ""


def test_empty_table(spark, sf_dir, make):
    docs = make([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
