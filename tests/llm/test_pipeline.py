"""The pipeline, stage by stage, against plain versions on its own input."""

import corpus_pipeline
import data
from layerscan.session import materialize


def test_stages(spark):
    docs = spark.read.parquet(f"{data.SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, data.SMALL), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        kept[name] = ({r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()})
        docs = out
    before, after = kept["quality rules"]
    assert 0 < len(after) < len(before)
    before, after = kept["MinHash near-dedup"]
    assert set(after) == {r[0] for r in data.brute_near([(i, r.text) for i, r in before.items()], 80) if r[3]}
    before, after = kept["substring dedup"]
    for i, words, removed, _ in data.brute_substring([(i, r.text) for i, r in before.items()]):
        assert (i in after) == (not removed or removed < words)
        if i in after:
            assert (after[i] == before[i]) == (removed == 0)
    before, after = kept["benchmark decontamination"]
    assert 0 < len(after) < len(before) and all(after[i] == before[i] for i in after)
    before, after = kept["SentencePiece encoding and decoding"]
    assert set(after) == set(before) and all(r.round_trip and r.n_tokens == len(r.ids) for r in after.values())


def test_odd_rows_pass(spark, odd, none):
    for docs in (odd.drop("chunk", "id", "rest", "kept"), none.drop("chunk", "id", "rest", "kept")):
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, data.SMALL), "test")
        docs.collect()
