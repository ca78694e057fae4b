"""Tables that grow with the corpus stay out of the driver when SimHash joins them, whatever size Spark expects."""

from __future__ import annotations

from itertools import combinations

import corpus_pipeline
from vitalgrid.llm import simhash
from vitalgrid.session import materialize


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_not_broadcast(spark):
    prints = [0, 1, 0b111, 0b11111, 1 << 40, (1 << 40) + 3, -1, -2, 0x0F0F0F0F0F0F0F0F]
    table = materialize(spark.createDataFrame([(x,) for x in prints], "fp long"), "prints")
    links = simhash.near_pairs(table, 4)
    assert "Broadcast" not in plan(links)
    want = {(min(a, b), max(a, b)) for a, b in combinations(prints, 2) if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 4}
    assert {tuple(r) for r in links.collect()} == want


def test_documents_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, f"one two three four five {i % 3}") for i in range(9)], "doc_id long, text string")
    groups = simhash.simhash_groups(docs)
    first = next(line for line in plan(groups).splitlines() if "Join" in line)
    assert "SortMergeJoin" in first and groups.count() == 9


def test_pipeline_candidates_are_not_broadcast(spark, monkeypatch):
    seen = []

    def watched(links, a, b):
        seen.append(plan(links))
        return components(links, a, b)

    components = simhash.connected_components
    monkeypatch.setattr(simhash, "connected_components", watched)
    words = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, words), (2, f"{words} more"), (3, "something else is told here")],
                                 "doc_id long, text string")
    left = corpus_pipeline.near(spark, docs, "").collect()
    assert len(seen) == 1 and "Broadcast" not in seen[0]
    assert sorted(r["doc_id"] for r in left) == [1, 3]
