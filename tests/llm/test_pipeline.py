from collections import Counter

import corpus_pipeline
from tests.llm.test_minhash import brute
from tests.support import DATA


def test_stages_follow_each_other(spark):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        source = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns, name
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(source)
        if name == "near_duplicates":
            assert set(after) == {i for i, x in brute(source, 5).items() if x[2]}
        if name == "personal_data":
            assert set(after) == set(source)
        if name == "mix":
            assert max(Counter(r["doc_id"] for r in docs.collect()).values()) <= 3
        before[name] = len(after)
    assert before["quality"] >= before["near_duplicates"] == before["personal_data"] >= before["mix"] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    times = Counter(r["doc_id"] for r in docs.collect())
    pieces = Counter(r["doc_id"] for r in last if r["piece"] == 0)
    assert pieces == times
    once = [r for r in last if times[r["doc_id"]] == 1]
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if times[r["doc_id"]] == 1}
    assert {r["doc_id"] for r in once} == set(texts)
    sequences = Counter()
    for r in last:
        sequences[r["sequence_id"]] += r["length"]
    assert max(sequences.values()) <= 2048
