"""Each stage of the pipeline against its operator on the stage's own input, and on odd rows."""

from collections import Counter

import corpus_pipeline
from matchforge.llm import mixing
from matchforge.llm.common import durable

from .test_minhash import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    stages, seen = dict(corpus_pipeline.STAGES), {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name, f in stages.items():
        seen[name] = docs
        docs = durable(f(spark, docs, sf))
        assert name == "packing" or docs.columns == COLUMNS
    rows = {k: [tuple(r) for r in v.collect()] for k, v in seen.items()}
    assert {r[0] for r in rows["language_id"]} - {r[0] for r in rows["exact_dedup"]} <= {r[0] for r in rows["language_id"] if not any(map(str.isalpha, r[1] or "")) or len(r[1].split()) < 5}
    first = {}
    for r in sorted(rows["exact_dedup"]):
        first.setdefault(r[1], r)
    assert sorted(rows["near_dedup"]) == sorted(first.values())
    kept = {i for i, _, least in brute([(r[0], r[1]) for r in rows["near_dedup"]], 5, 80) if i == least}
    assert sorted(rows["mixing"]) == sorted(r for r in rows["near_dedup"] if r[0] in kept)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(seen["mixing"]).collect()}
    assert Counter(r[0] for r in rows["packing"]) == Counter({k: n for k, n in copies.items() if n})
    pieces = Counter(r["doc_id"] for r in docs.where("piece = 0").collect())
    assert pieces == Counter(r[0] for r in rows["packing"])


def test_odd_rows_pass_every_stage(spark, odd_documents, no_documents):
    for start in (odd_documents, no_documents):
        docs = start
        for _, f in corpus_pipeline.STAGES:
            docs = durable(f(spark, docs, ""))
        assert start is odd_documents or docs.count() == 0
