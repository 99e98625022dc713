from collections import Counter

import sentencepiece

import corpus_pipeline
from duolattice.llm import quality
from duolattice.llm.queries import quality_model, vocabulary
from test_duplicates import brute_contamination, brute_groups, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    scores = {r.doc_id: r.score for r in quality.score(docs, quality_model(spark, SF, docs)).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id] >= 0.3)
    rows = [(i, t) for (i, _), (t, _) in zip(rows, brute_lines(rows))]
    rows = [r for r, g in zip(rows, brute_groups(rows)) if g[2] == r[0]]
    rows = [r for r, c in zip(rows, brute_contamination([t for _, t in rows], bench, 10)) if not c[1]]
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = Counter((i, tuple([*sp.encode(t or ""), sp.eos_id()])) for i, t in rows)
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_awkward_documents_go_through(spark):
    rows = [(None, None, "en", "s", None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "Clean words stand here and there.", "en", "s", 33), (3, "Clean words stand here and there.", "en", "s", 33)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.filter("false")):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, SF).count() <= 5
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
