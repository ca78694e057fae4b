"""What is taken of a source comes as near to its target as its documents allow."""

import random

import pytest

from vitalgrid.llm.mixing import mix

KIND = "doc_id long, text string, source string"


def by_source(rows):
    out = {}
    for r in rows:
        s = out.setdefault(r["source"], {"target": r["target"], "taken": 0, "sizes": [], "left": []})
        s["taken"] += r["taken"]
        s["sizes"].append(r["size"])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_one_long_document_does_not_stop_the_source(spark, seed):
    rows = [(i, "w " * 50, "a") for i in range(400)] + [(1000 + i, "w " * 9000, "a") for i in range(2)]
    rows += [(2000 + i, "w " * 70, "b") for i in range(300)]
    docs = spark.createDataFrame(rows, KIND)
    got = by_source(mix(docs, seed=seed, keep=["doc_id", "source"]).collect())
    for s in got.values():
        assert abs(s["taken"] - s["target"]) <= 35


def test_each_source_near_its_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix(docs, keep=["doc_id", "source"]).collect()
    floor = {}
    for r in rows:
        times = r["taken"] // r["size"] if r["size"] else 0
        if r["size"] and times == r["target"] // r["source_size"]:  # not taken for the fractional part
            floor[r["source"]] = min(floor.get(r["source"], r["size"]), r["size"])
    for source, s in by_source(rows).items():
        assert abs(s["taken"] - s["target"]) <= max(floor.get(source, 0), 0.005 * s["target"])
    assert all(r["taken"] <= 3 * r["size"] for r in rows)


def test_equal_sizes_and_a_null_source(spark):
    draw = random.Random(1)
    rows = [(i, "w " * 10, draw.choice([None, "a", "b", "c"])) for i in range(3000)]
    docs = spark.createDataFrame(rows, KIND).repartition(5)
    first = mix(docs, keep=["doc_id", "source"]).collect()
    for s in by_source(first).values():
        assert abs(s["taken"] - s["target"]) <= 5
    again = mix(docs.repartition(3), keep=["doc_id", "source"]).collect()
    assert {r["doc_id"]: r["taken"] for r in first} == {r["doc_id"]: r["taken"] for r in again}
