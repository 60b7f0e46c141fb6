"""Sequences of the pipeline follow the mixing stage's schedule, also over several files."""

import random

import corpus_pipeline
from depscope.llm import mixing
from depscope.scratch import materialise


def test_sequences_follow_slots(spark):
    pick = random.Random(2)
    rows = []
    for d in range(300):
        words = " ".join(f"{pick.randrange(10**6):x}" for _ in range(pick.choice([20, 900, 2500])))
        rows.append((d, words, "en", f"src{d % 5}", len(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    order = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.mix(docs, corpus_pipeline.WEIGHTS).collect()}
    mixed = corpus_pipeline.source_mixing(spark, docs, "")
    written = materialise(mixed, "test-mixed")
    assert len(written.inputFiles()) > 1
    for table in (written, mixed):
        full = [r for r in corpus_pipeline.best_fit_packing(spark, table, "").collect() if r["length"] == corpus_pipeline.CAPACITY]
        full.sort(key=lambda r: r["sequence_id"])  # full pieces are sequences of their own and never placed anew
        places = [(*order[r["doc_id"]], r["piece"]) for r in full]
        assert len(full) > 100 and places == sorted(places)
