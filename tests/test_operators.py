"""Operators on small fixtures: skew, numbering, nesting, similarity, streaming and the page source."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from vellum.functions.text import tokens
from vellum.operators import ingest, nested, review, similarity
from vellum.operators.ranking import global_row_number
from vellum.operators.skew import salted_lookup
from vellum.sources.pages import CataloguePages, read_pages
from vellum.streaming import latest

from .conftest import DATA, values


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("counted", [None, "n"])
def test_salted_lookup_equals_a_join(spark, how, counted):
    r = random.Random(1)
    rows = spark.createDataFrame([(i, 7 if i % 3 else r.randrange(9)) for i in range(300)] + [(999, None)], "id int, k int")
    lookup = rows.filter("k is not null and k <> 4").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    plain = rows.join(lookup, ["k"], how)
    got = salted_lookup(rows, lookup, ["k"], "id", how, hot_rows=20, counted=counted)
    assert sorted(got.columns) == sorted(plain.columns)
    assert values(got, "id", "k") == values(plain, "id", "k")


def test_global_row_number(spark):
    df = spark.createDataFrame([(i, (i * 37) % 11) for i in range(100)], "id int, v int")
    got = {r["id"]: r["p"] for r in global_row_number(df, [F.desc("v"), F.asc("id")], "p").collect()}
    order = sorted(range(100), key=lambda i: (-((i * 37) % 11), i))
    assert got == {i: k + 1 for k, i in enumerate(order)}


def test_nested_leaves_of_nulls_on_every_level(make):
    works = make(
        "oa_works",
        {"delivery_id": 1, "authorships": [None, (None, "first"), (("A",), None), (("",), "last")], "referenced_works": ["r0", None, "r2"], "abstract_inverted_index": {"w": [3, 1], "v": None, "u": [None]}, "primary_location": ("page", None)},
        {"delivery_id": 2},
        {"delivery_id": 1, "referenced_works": [], "abstract_inverted_index": {}, "primary_location": (None, ("V", None))},
    )
    assert values(nested.flat_leaves(works.withColumn("pos", F.lit(1)).withColumn("val", F.lit("x"))), "delivery_id", "child", "pos", "val") == sorted(
        [(1, "author", 2, "A"), (1, "author", 3, ""), (1, "reference", 0, "r0"), (1, "reference", 2, "r2"), (1, "word", 3, "w"), (1, "word", 1, "w"), (1, "landing_page", 0, "page"), (1, "venue", 0, "V")], key=repr
    )
    assert nested.flat_leaves(works.limit(0)).count() == 0
    assert {k: v.count() for k, v in nested.child_tables(works).items()} == {"work": 3, "authorship": 4, "reference": 3, "word": 3, "location": 2}


def test_nested_leaves_come_from_one_generator(spark):
    plan = nested.flat_leaves(spark.read.parquet(str(DATA / "oa_works.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and "Exchange" not in plan and "Join" not in plan


def test_very_long_author_list(make):
    n = 20_000
    works = make("oa_works", {"delivery_id": 5, "authorships": [((f"A{i}",), None) for i in range(n)]})
    assert nested.flat_leaves(works).count() == n


def test_latest_verdict_is_by_log_order_not_clock(make):
    rows = [{"seq": 1, "source": "S1", "reviewer": "pass1", "verdict": "include"}, {"seq": 3, "source": "S1", "reviewer": "pass1", "verdict": " EXCLUDE\n", "reason": "retracted"}, {"seq": 2, "source": "S1", "reviewer": "pass1", "verdict": "defer"}, {"seq": 4, "reviewer": "pass1", "verdict": "include"}]
    got = review.latest_verdicts(make("screening", *rows))
    assert values(got, "source", "reviewer", "verdict", "seq") == [("S1", "pass1", "exclude", 3)]
    assert review.latest_verdicts(make("screening")).count() == 0


def test_funnel_of_empty_tables(make):
    row = review.funnel(make("sources"), review.latest_verdicts(make("screening"))).first()
    assert row["identified"] == row["screened"] == row["unscreened"] == 0


def test_like_any_equals_brute_force(spark):
    r = random.Random(8)
    sets = lambda n: [sorted({f"w{r.randrange(14)}" for _ in range(r.randrange(0, 9))}) for _ in range(n)]
    new, stored = sets(80), sets(60)
    got = similarity.like_any(spark.createDataFrame(list(enumerate(new)), "id long, words array<string>"), spark.createDataFrame([(x,) for x in stored], "words array<string>"), 0.6)
    expect = [(i,) for i, x in enumerate(new) if x and any(y and len(set(x) & set(y)) >= 0.6 * len(set(x) | set(y)) - 1e-9 for y in stored)]
    assert values(got) == sorted(expect, key=repr) and 0 < len(expect) < 80


@pytest.mark.parametrize("hot_rows", [10**6, 3])
def test_similarity_join_equals_brute_force(spark, hot_rows):
    r = random.Random(3)
    base = [[f"w{r.randrange(40)}" for _ in range(r.randrange(3, 14))] for _ in range(60)]
    texts = base + [b + [f"w{r.randrange(40)}"] for b in base[:30]] + base[:10] + [[], ["a"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = similarity.linked(spark.createDataFrame(rows, "id long, text string"), tokens(F.regexp_replace("text", "w", "wxy")), 0.8, hot_rows)
    sets = {i: frozenset(t) for i, t in enumerate(texts) if any(len("wxy" + x) > 2 for x in t) and [x for x in t if x.startswith("w")]}
    expect = []
    for i, s in sets.items():
        links = sum(1 for j, o in sets.items() if j != i and len(s & o) >= 0.8 * len(s | o) - 1e-9)
        expect.append((i, min(j for j, o in sets.items() if o == s), links))
    assert values(got, "id", "class_id", "links") == sorted(expect, key=repr)


def test_stream_equals_batch(spark):
    log = spark.read.parquet(str(DATA / "screening.parquet"))
    stream = latest.drain(latest.latest_stream(latest.read_log(spark, str(DATA / "screening.parquet*"), log.schema)))
    assert values(stream, "source", "reviewer", "verdict", "seq") == values(review.latest_verdicts(log), "source", "reviewer", "verdict", "seq")


def test_page_source(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"results": [{"id": "W1", "title": "A"}, {"id": "W2", "display_name": "B"}]}))
    (tmp_path / "p2.json").write_text(json.dumps([{"id": "W3"}]))
    (tmp_path / "p3.json").write_text("{broken")
    spark.dataSource.register(CataloguePages)
    df = spark.read.format("catalogue_pages").option("path", str(tmp_path)).load()
    expect = [("p1.json", 0, "W1", "A"), ("p1.json", 1, "W2", "B"), ("p2.json", 0, "W3", "")]
    assert values(df, "page", "place", "id", "title") == expect
    assert values(read_pages(spark, str(tmp_path)), "page", "place", "id", "title") == expect


def test_batch_files(spark):
    files = [
        ("a", '\n# note\n{"source": "S1", "scope_note": "x", "score": 8, "evidence": ["E1", "E2"], "criteria": {"peer": "yes", "n": 3}, "gone": null, "flag": true}\r\n// x\n{broken\n[1]\n'),
        ("b", ' [{"a_b": 1.5}, 7, {"a-b": 1, "a_b": 2}] '), ("c", "[]"), ("d", "  \n# only\n"), ("e", None), ("f", "[{]"), ("g", ""),
    ]
    got = values(ingest.batch_records(spark.createDataFrame(files, "file string, text string")).select("file", "line", "status", F.expr("array_join(array_sort(transform(map_entries(flags), e -> concat(e.key, '=', e.value))), ' ')").alias("f")))
    assert got == sorted([
        ("a", 3, "parsed", "criteria=n:3,peer:yes evidence=E1,E2 flag=true scope-note=x score=8 source=S1"), ("a", 5, "failed", None), ("a", 6, "failed", None),
        ("b", 1, "parsed", "a-b=1.5"), ("b", 2, "failed", None), ("b", 3, "parsed", "a-b=2"), ("c", 0, "empty", None), ("d", 0, "empty", None), ("e", 0, "empty", None), ("f", 1, "failed", None), ("g", 0, "empty", None),
    ], key=repr)


def test_hot_keys_are_bounded_by_the_partitions(spark):
    from vellum.operators.skew import PART, hot_keys

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    even = spark.range(10_000).select(F.col("id").alias("k"), F.lit(20).alias("_n"))
    assert hot_keys(even, ["k"], 10) is None or hot_keys(even, ["k"], 10).count() <= parts / PART
    one = even.unionByName(spark.createDataFrame([(-1, 300_000)], "k long, _n int"))
    assert [r["k"] for r in hot_keys(one, ["k"], 10).collect()] == [-1]
    rows = spark.range(200_000).select("id", (F.col("id") % 10_000).alias("k"))
    assert salted_lookup(rows, even.select("k"), ["k"], "id", hot_rows=10).count() == 200_000


def test_kept_tables_know_their_rows_and_can_be_cleared(spark):
    from vellum.sources import shared

    scratch = shared.Scratch(spark, "t")
    kept = scratch.keep(spark.range(100).filter("id > 9"), top=F.max("id"))
    assert shared.rows(kept) == 90 and shared.measure(kept, "top") == 99 and kept.count() == 90
    assert shared.rows(scratch.keep(spark.range(3).filter("id > 9"))) == 0
    shared.clear()
    assert not shared._ROOTS
