"""The pipeline against a brute-force version of its deterministic stages."""

import hashlib
from collections import Counter

import corpus_pipeline
from rowloom.llm import mixing, pu_toxicity, sentencepiece_table
from rowloom.llm.common import split_of

from .test_llm import EDGE, brute_exact, brute_near


def test_pipeline_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    weights, bias = pu_toxicity.fit(docs, labels, split_of("doc_id", 5) != 0)
    rows = {r["doc_id"]: r for r in docs.collect()}
    clean = {i: r["text"] for i, r in rows.items() if pu_toxicity.probability(pu_toxicity.margin_of(r["text"], weights, bias, {})) < 0.5}
    assert 0 < len(clean) < len(rows)
    once = {i: clean[i] for i, _, _, kept, _ in brute_exact(list(clean.items())) if kept}
    near = brute_near(list(once.items()), 5, 80)
    apart = {i: t for i, t in once.items() if near[i][1] == i}
    taken = {r["doc_id"]: r["copies"] for r in mixing.plan(docs.where(docs["doc_id"].isin(list(apart)))).collect() if r["copies"]}
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(taken)
    encoder = sentencepiece_table.ChunkEncoder(sentencepiece_table.model_bytes())
    assert all(list(r["ids"]) == encoder.sp.encode(rows[r["doc_id"]]["text"]) for r in got)


def test_stages_take_edge_rows(spark, sf):
    docs = spark.createDataFrame([(i, t, lang, s, len(t) if t else None) for i, t, lang, s in EDGE], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, sf)
            assert rows.columns == corpus_pipeline.COLUMNS
        corpus_pipeline.STAGES[-1][1](spark, rows, sf).collect()


def test_last_stage_decodes_and_tells_round_trips(spark, sf):
    docs = spark.createDataFrame([(i, t, lang, s, len(t) if t else None) for i, t, lang, s in EDGE], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    sp = sentencepiece_table.ChunkEncoder(sentencepiece_table.model_bytes()).sp
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((i, sha(sp.decode(sp.encode(t)) if t else ""), (sp.decode(sp.encode(t)) if t else "") == (t or "")) for i, t, *_ in EDGE)
    assert Counter((r["doc_id"], r["decoded_sha256"], r["round_trip"]) for r in got) == want
