"""Graph operators against plain Python on small graphs."""

from __future__ import annotations

import random

from vellum.operators import graphs
from vellum.plans import texts

from .conftest import values
from .oracle import rows_of_spark, rows_of_sql


def test_component_labels_equal_union_find_on_a_long_chain(spark):
    r = random.Random(7)
    chain = [f"n{i:03d}" for i in range(40)]
    r.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [("x1", "x2"), ("x2", "x1"), ("x3", "gone"), ("gone", "x4"), ("x5", "x5")]
    nodes = chain + ["x1", "x2", "x3", "x4", "x5"]
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        if a in up and b in up:
            low, high = sorted((root(a), root(b)))
            up[high] = low
    got = graphs.component_labels(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "source string, target string"))
    assert values(got, "id", "label") == sorted(((n, root(n)) for n in nodes), key=repr)


def test_top_30_when_one_type_holds_most_nodes(spark, make, tmp_path):
    works = [{"delivery_id": i, "id": f"W{i:02d}", "work_type": "article" if i < 40 else f"t{i % 3}", "referenced_works": [f"W{k:02d}" for k in range(i)] if i < 40 else []} for i in range(50)]
    make("oa_works", *works).write.parquet(str(tmp_path / "oa_works.parquet"))
    got = texts.QUERIES["graph_top_30"](spark, str(tmp_path))
    rows = {r["id"]: r["rank_in_type"] for r in got.collect()}
    # all articles have degree 39, the rest none: 30 articles by id, and two of each other type
    assert rows == {f"W{i:02d}": i + 1 for i in range(30)} | {"W40": 1, "W43": 2, "W41": 1, "W44": 2, "W42": 1, "W45": 2}
    assert rows_of_spark(got) == rows_of_sql(texts.ORACLES["graph_top_30"], str(tmp_path))
