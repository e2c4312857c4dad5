"""Each rule that the given tables don't break, broken and kept by a small ledger; modes; literal rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vellum.operators import graphs, reports, review, rules
from vellum.plans.views import Ledger

from .conftest import values


class Small(Ledger):
    """A ledger of given tables and views."""

    def __init__(self, spark, make, **tables):
        super().__init__(spark, "nowhere")
        self._make = make
        self.__dict__.update(tables)

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        return self._make(name)


def cited(spark, *rows):
    return spark.createDataFrame(list(rows), "claim string, consensus string, eid string, score double, source string")


def screen(*rows):
    return [{"seq": i, "source": s, "reviewer": "pass1", "verdict": v, "reason": r} for i, (s, v, r) in enumerate(rows)]


def subjects(t, check, mode="standard"):
    return values(rules.RULES[check](t, mode), "severity", "subject")


def test_single_venue(spark, make):
    sources = make("sources", *[{"id": f"S{i}", "rec_id": i} for i in range(1, 8)])
    recs = make("recs", *[{"rec_id": i, "venue": "Only" if i <= 4 else f"V{i}"} for i in range(1, 8)])
    c = cited(spark, *[("CL1", "strong", f"E{i}", 8.0, f"S{i}") for i in (1, 2, 3)], *[("CL2", "strong", f"E{i}", 8.0, f"S{i}") for i in (1, 2, 5)], ("CL3", "strong", "E1", 8.0, "S1"), *[("CL4", "thin", f"E{i}", 8.0, f"S{i}") for i in (1, 2, 3)])
    assert subjects(Small(spark, make, cited=c, sources=sources, recs=recs), "single-venue-consensus") == [("warn", "CL1")]


def test_retracted_and_cache_and_abstract_only(spark, make):
    sources = make(
        "sources", {"id": "S1", "rec_id": 1, "read_at": None}, {"id": "S2", "rec_id": 2, "read_scope": "abstract"}, {"id": "S3", "rec_id": 1}, {"id": "S4", "rec_id": 3, "cache_chars": 0}, {"id": "S5", "rec_id": 3, "cache_chars": 9},
    ).withColumn("read_at", F.when(F.col("id").isin("S4", "S5"), F.current_timestamp()))
    t = Small(spark, make, sources=sources, recs=make("recs", {"rec_id": 1, "retracted": True}, {"rec_id": 2, "retracted": False}, {"rec_id": 3}), screening=make("screening", *screen(("S1", "include", None), ("S2", "include", None), ("S3", "exclude", "x"), ("S4", "include", None), ("S5", "include", None))))
    assert subjects(t, "retracted-included") == [("error", "S1")]
    assert subjects(t, "cache-missing") == [("error", "S4")]
    assert subjects(t, "abstract-only-in-systematic", "systematic") == [("warn", "S2")]
    assert subjects(t, "abstract-only-in-systematic", "standard") == [] == subjects(t, "abstract-only-in-systematic", "quick")


def test_thin_questions_and_no_search_log(spark, make):
    ev = make("evidence", {"id": "E1", "question": "SQ1", "score": 6.0}, {"id": "E2", "question": "SQ1", "score": 6.5}, {"id": "E3", "question": "SQ2", "score": 7.0}, {"id": "E4", "question": "SQ2", "score": 2.0})
    assert subjects(Small(spark, make, evidence=ev), "question-thin") == [("warn", "SQ1")]
    assert subjects(Small(spark, make), "no-search-log") == [("warn", "queries")]
    assert subjects(Small(spark, make, queries=make("queries", {"q": "x"})), "no-search-log") == []


@pytest.mark.parametrize("unobtainable, others, found", [(3, 17, True), (3, 18, False), (2, 1, False), (4, 0, True)])
def test_unobtainable_share(spark, make, unobtainable, others, found):
    rows = screen(*[(f"S{i}", "exclude", "unobtainable") for i in range(unobtainable)], *[(f"T{i}", "include", None) for i in range(others)])
    assert subjects(Small(spark, make, screening=make("screening", *rows)), "access-bias-unobtainable") == ([("warn", "unobtainable")] if found else [])


@pytest.mark.parametrize("abstracts, others, found", [(1, 1, True), (1, 2, False), (1, 0, False), (2, 0, True)])
def test_abstract_only_share(spark, make, abstracts, others, found):
    ids = [f"S{i}" for i in range(abstracts + others)]
    sources = make("sources", *[{"id": s, "read_scope": "abstract" if i < abstracts else "fulltext"} for i, s in enumerate(ids)])
    t = Small(spark, make, sources=sources, screening=make("screening", *screen(*[(s, "include", None) for s in ids])))
    assert subjects(t, "access-bias-abstract-only") == ([("warn", "abstract-only")] if found else [])


def test_figures_from_abstracts_by_mode(spark, make):
    ev = make("evidence", {"id": "E1", "source": "S1", "summary": "It rose by 40%", "from_scope": "abstract"}, {"id": "E2", "source": "S1", "summary": "It rose"}, {"id": "E3", "source": "S2", "summary": "It rose by 40%"})
    claims = spark.createDataFrame([("CL1", ["E1", "E2", "E3"], "thin")], "id string, evidence array<string>, consensus string")
    t = Small(spark, make, evidence=ev, claims=claims, sources=make("sources", {"id": "S1", "read_scope": "fulltext"}, {"id": "S2", "read_scope": "abstract"}))
    for mode, level in (("standard", "error"), ("systematic", "error"), ("quick", "warn")):
        assert subjects(t, "figure-from-abstract", mode) == [(level, "E1"), (level, "E3")]


def test_audit_of_empty_tables_is_the_missing_search_log(spark, make):
    assert values(rules.audit(Small(spark, make)), "severity", "check", "subject") == [("warn", "no-search-log", "queries")]


def test_claims_absent_from_a_report_and_temporal_gap(spark, make):
    from vellum.plans import review as plans

    sources = make("sources", *[{"id": f"S{y}", "year": y} for y in (2019, 2021, 2022, 2023, 2031)])
    ev = make("evidence", *[{"id": f"E{i}", "source": f"S{y}", "question": q} for i, (q, y) in enumerate([("old", 2019), ("old", 2022), ("edge", 2023), ("edge", 2021), ("odd", 2031), ("odd", 2021)])])
    t = Small(spark, make, sources=sources, evidence=ev)
    assert values(plans.temporal_gap(t), "question", "newest") == [("odd", 2021), ("old", 2022)]


def test_streaks_across_stretches(make):
    import random

    r = random.Random(6)
    logs = {"a": [r.random() < 0.8 for _ in range(300)], "b": [True] * 97, "c": [False] * 9, "d": [True, False, True, True], "e": [False] + [True] * 60 + [False] + [True] * 59}
    rows = [{"seq": 1000 + 3 * i, "reviewer": w, "source": f"S{i}", "verdict": " EXCLUDE" if x else "include"} for w, log in logs.items() for i, x in enumerate(log)]
    rows += [{"reviewer": "a", "verdict": "exclude"}, {"seq": 5, "verdict": "exclude"}]
    expect = []
    for w, log in logs.items():
        best = run = 0
        for x in log:
            run = run + 1 if x else 0
            best = max(best, run)
        if best:
            expect.append((w, best))
    log = make("screening", *rows)
    for part in (1, 7, 50, 10**6):
        assert values(review.exclude_streaks(log, part), "reviewer", "longest") == sorted(expect)


TRUTH = [("identified", 7), ("read", 3)]


def test_counts_blocks(spark):
    block = lambda body, close="<!-- /counts -->": f"Text.\n<!-- counts v1\n{body}\n-->\n{close}\nMore."
    docs = [(1, "No block here"), (2, block('{"identified": 7, "read": 3}')), (3, block('{"identified": 7}', "")), (4, block("{broken")), (5, block('{"identified": 8, "read": "3", "other": 1}')), (6, None), (7, ""), (8, block('{"read": "many"}')), (9, block("[1]"))]
    got = values(reports.counts_findings(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(TRUTH, "key string, n long")))
    assert got == sorted([
        ("warn", "no-stats-block", "1"), ("error", "stats-block-unterminated", "3"), ("error", "stats-block-unparseable", "4"), ("error", "stats-block-stale", "5>identified"), ("warn", "stats-block-unknown-key", "5>other"),
        ("warn", "no-stats-block", "6"), ("warn", "no-stats-block", "7"), ("error", "stats-block-stale", "8>read"), ("error", "stats-block-unparseable", "9"),
    ], key=repr)


def test_graph_files(spark):
    node = lambda i, *ids: '{"id": "%s", "ledger_ids": [%s]}' % (i, ", ".join(f'"{x}"' for x in ids))
    files = [
        ("a", '{"nodes": [%s, %s, {"ledger_ids": ["E1"]}], "edges": [{"source": "n1", "target": "n9", "ledger_ids": ["S2"]}, {"source": "n1", "ledger_ids": []}], "metadata": {"node_count": 3, "edge_count": 5}}' % (node("n1", "S1", "s3"), node("n2", "[S9]", "bogus", "CL1"))),
        ("b", "{nodes"), ("c", '{"nodes": [], "edges": []}'), ("d", '{"nodes": [%s]}' % node("x", "S4")), ("e", None),
    ]
    known = spark.createDataFrame([(x,) for x in ("S1", "S2", "S3", "S4", "E1", "CL1")], "id string")
    sources = spark.createDataFrame([("S1", True, True), ("S2", None, True), ("S3", True, False), ("S4", True, True)], "id string, included boolean, was_read boolean")
    got = values(graphs.file_findings(spark.createDataFrame(files, "file string, text string"), known, sources))
    assert got == sorted([
        ("error", "graph-node-without-id", "a>node 2"), ("warn", "graph-count-mismatch", "a>edges"), ("error", "graph-edge-endpoint-missing", "a>edge 1>target"), ("error", "graph-dangling-edge", "a>edge 0>n9"),
        ("warn", "graph-without-ledger-id", "a>edge 1"), ("error", "graph-bad-id", "a>node 1>BOGUS"), ("error", "graph-unknown-id", "a>node 1>S9"), ("error", "graph-excluded-source", "a>edge 0>S2"), ("error", "graph-unread-source", "a>node 0>S3"),
        ("error", "graph-unparseable", "b"), ("error", "graph-empty", "c"), ("error", "graph-unparseable", "e"),
    ], key=repr)


def test_dense_clusters_and_bridges(spark):
    clique = lambda names: [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    edges = clique("abcd") + clique("wxyz") + [("d", "w"), ("p", "q"), ("q", "q"), (None, "a")]
    df = spark.createDataFrame(edges, "source string, target string")
    label = {r["id"]: r["cluster"] for r in graphs.dense_clusters(df).collect()}
    assert label["a"] == label["b"] == label["c"] and label["x"] == label["y"] == label["z"] and label["p"] == label["q"] == "p" and set(label) == set("abcdwxyzpq")
    got = {r["id"]: r["clusters"] for r in graphs.bridges(df).collect()}
    assert all(n >= 2 for n in got.values()) and not {"p", "q", "x", "y", "z"} & set(got)
    assert graphs.bridges(df, hot_rows=1).count() == len(got) and graphs.bridges(df.limit(0)).count() == 0
