"""Copies hidden by formatting, connected groups and surviving records."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vellum.llm import components, formatting_dups, survivor

from ..conftest import DATA, values

TITLE = "Late tool wear after guided coaching: a cluster study in Semavoona"


def test_copies_by_formatting(make):
    recs = make(
        "recs",
        {"rec_id": 5, "title": TITLE, "year": 2020},
        {"rec_id": 2, "title": "  LATE TOOL-WEAR after_guided　coaching (a cluster study in Semavoona).\n", "year": 2020},
        {"rec_id": 7, "title": TITLE.replace("cluster", "pilot"), "year": 2020},
        {"rec_id": 8, "title": TITLE, "year": 2021},
        {"rec_id": 9, "title": TITLE},
        {"rec_id": 10, "title": TITLE.lower()},
        {"rec_id": 11, "title": "Maßnahmen", "year": 1}, {"rec_id": 12, "title": "MASSNAHMEN", "year": 1},
        {"rec_id": 13}, {"rec_id": 14}, {"rec_id": 15, "title": "  .-"}, {"rec_id": 16, "title": "..."},
        {"rec_id": 17, "title": "Listen, silent one", "year": 3}, {"rec_id": 18, "title": "Silent, listen one", "year": 3},
    )
    lines = make(
        "rec_lines",
        {"line_id": 1, "raw": '{"title": "%s", "year": "2020", "x": [1]}' % TITLE},
        {"line_id": 2, "raw": f"YEAR=2020\tTitle=  {TITLE.upper()}\titem=a=b"},
        {"line_id": 3, "raw": '{"Year": 2020.0, "TITLE": "%s"}' % TITLE},
        {"line_id": 4, "raw": '{"title": "%s", "year": 2020' % TITLE}, {"line_id": 5, "raw": f"# title={TITLE}\tyear=2020"}, {"line_id": 6, "raw": ""}, {"line_id": 7},
        {"line_id": 8, "raw": f"title={TITLE}\tyear=2020\tbro"}, {"line_id": 9, "raw": "no record at all"}, {"line_id": 10, "raw": f"// {TITLE}"},
    )
    expect = sorted([("rec_lines", 1, 2), ("rec_lines", 1, 3), ("recs", 2, 5), ("recs", 9, 10), ("recs", 11, 12)], key=repr)
    assert values(formatting_dups.found(recs.withColumn("keep_id", F.lit(1)).withColumn("n", F.lit(1)), lines)) == expect
    assert values(formatting_dups.found(recs, lines, hot_rows=1)) == expect  # every class counts as hot
    copies = {(r["tab"], r["keep_id"]): r["copies"] for r in formatting_dups.one_each(recs, lines).collect()}
    assert copies[("rec_lines", 1)] == 3 and copies[("recs", 2)] == 2 and copies[("recs", 7)] == 1 and ("recs", 13) not in copies


def test_copies_of_a_hot_title_and_of_empty_tables(make):
    many = make("recs", *[{"rec_id": i, "title": TITLE if i % 3 else TITLE.upper(), "year": 2000} for i in range(500)])
    got = values(formatting_dups.found(many, make("rec_lines"), hot_rows=50))
    assert got == sorted([("recs", 0, i) for i in range(1, 500)], key=repr)
    assert formatting_dups.found(make("recs"), make("rec_lines")).count() == 0


def test_long_titles(make):
    long = "word " * 20_000
    assert values(formatting_dups.found(make("recs", {"rec_id": 1, "title": long}, {"rec_id": 2, "title": long.upper()}, {"rec_id": 3, "title": long + "x"}), make("rec_lines"))) == [("recs", 1, 2)]


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return sorted([(x, find(x)) for x in parent], key=repr)


@pytest.mark.parametrize("seed, n, m, hot", [(1, 60, 40, 10**6), (2, 200, 220, 5), (3, 30, 200, 2)])
def test_connect_equals_union_find(spark, seed, n, m, hot):
    r = random.Random(seed)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(0, x) for x in range(n // 3)] + [(None, 3), (4, None), (5, 5)]
    assert values(components.connect(spark.createDataFrame(edges, "a long, b long"), hot)) == brute(edges)


def test_connect_long_chain_and_nothing(spark):
    chain = [(i + 1, i) for i in range(150)]
    assert values(components.connect(spark.createDataFrame(chain, "a long, b long"))) == brute(chain)
    assert components.connect(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_by_identifiers(make):
    recs = make(
        "recs",
        {"rec_id": 9, "doi": "https://resolver.example/10.91234/AB.1\n"}, {"rec_id": 4, "doi": "10.91234/ab.1", "pmid": "PMID: 90000001"}, {"rec_id": 6, "pmid": "90000001.0", "arxiv": "0000.00000"},
        {"rec_id": 7, "arxiv": "arXiv: 2012.12345v3"}, {"rec_id": 8, "doi": "DOI: 10.48550/ARXIV.2012.12345"}, {"rec_id": 10, "openalex": "https://works.example/works/W77 "}, {"rec_id": 11, "openalex": "w77"},
        {"rec_id": 12, "doi": "10.0000/none", "pmid": "0", "openalex": "W0", "arxiv": "n/a"}, {"rec_id": 13, "doi": "10.0000/none", "pmid": "00000000", "openalex": "null", "arxiv": "none"}, {"rec_id": 14}, {"doi": "10.91234/ab.1"},
        {"rec_id": 15, "title": "same"}, {"rec_id": 16, "title": "same", "pmcid": "x"}, {"rec_id": 17, "pmcid": "x"},
    )
    assert values(components.groups(recs.withColumn("key", F.lit("k")).withColumn("group_id", F.lit(0))), "rec_id", "group_id") == sorted([(4, 4), (6, 4), (9, 4), (7, 7), (8, 7), (10, 10), (11, 10)], key=repr)
    assert components.groups(make("recs")).count() == 0


WHOLE = "We enrolled 419 nurses at 11 sites between 2004 and 2010. Dropout reached 34% in the control group, mainly because of shift changes."


def test_survivors(make):
    rows = [
        {"rec_id": 1, "abstract": WHOLE[:70] + "…", "source_api": "s2", "citations": -1},
        {"rec_id": 2, "abstract": f"<jats:p>{WHOLE.replace('%', '&#37;')}</jats:p>", "source_api": " OpenAlex +S2", "citations": 12, "found_by": ["b", None, "a"]},
        {"rec_id": 3, "abstract": WHOLE.replace(" ", "\n "), "source_api": "crossref", "citations": 30, "found_by": ["a"]},
        {"rec_id": 4, "abstract": "Abstract not available.", "source_api": None, "citations": None},
        {"rec_id": 5, "abstract": None, "source_api": "", "citations": 0},
    ]
    recs = make("recs", *[r | {"pmid": "90000005"} for r in rows], {"rec_id": 20, "pmid": "90000020"}, {"rec_id": 21, "pmid": "90000020"}, {"rec_id": 30, "abstract": WHOLE, "citations": 5})
    got = values(survivor.found(recs.withColumn("n", F.lit(1)).withColumn("value", F.lit("x"))))
    expect = [(1, "abstract", "2"), (1, "citations", "30"), (1, "source_api", "openalex"), (1, "source_api", "s2"), (1, "source_api", "crossref"), (1, "found_by", "a"), (1, "found_by", "b")]
    assert got == sorted(expect, key=repr)
    one = {r["group_id"]: r for r in survivor.survivors(recs).collect()}
    assert one[1]["rows"] == 5 and one[1]["abstract_from"] == 2 and one[1]["found_by"] == ["a", "b"] and one[20]["abstract"] is None
    assert survivor.found(make("recs")).count() == 0


def test_better_supported_text_wins(make):
    other = WHOLE.replace("419", "420").replace("nurses", "welders and some other people who were added later")
    rows = [{"rec_id": 1, "abstract": other, "source_api": "bad"}, {"rec_id": 2, "abstract": WHOLE, "source_api": "a"}, {"rec_id": 3, "abstract": WHOLE, "source_api": "b"}, {"rec_id": 4, "abstract": WHOLE[:60] + "...", "source_api": "c"}]
    got = values(survivor.found(make("recs", *[r | {"pmid": "90000001"} for r in rows])).filter("field = 'abstract'"))
    assert got == [(1, "abstract", "2")]


def test_cut_texts_vote_only_for_what_they_begin(make):
    """Three cut texts that share 24 letters with the doubly supported text and then differ from it don't overturn it."""
    other = WHOLE.replace("between 2004 and 2010", "from 2004 on in the whole of the northern district")
    rows = [{"rec_id": 1, "abstract": other, "source_api": "a"}, {"rec_id": 2, "abstract": WHOLE, "source_api": "b"}, {"rec_id": 3, "abstract": WHOLE, "source_api": "c"}]
    cuts = [WHOLE[:38] + f" of the kind {x} that were seen by all of the" for x in ("one", "two", "three")]
    rows += [{"rec_id": 4 + k, "abstract": c, "source_api": "de"[k % 2]} for k, c in enumerate(cuts)]
    got = values(survivor.found(make("recs", *[r | {"pmid": "90000001"} for r in rows])).filter("field = 'abstract'"))
    assert got == [(1, "abstract", "2")]
    more = [{"rec_id": 10 + k, "abstract": other[:90] + "<jats", "source_api": x} for k, x in enumerate("fgh")]
    got = values(survivor.found(make("recs", *[r | {"pmid": "90000001"} for r in rows + more])).filter("field = 'abstract'"))
    assert got == [(1, "abstract", "1")]  # now four begin the other one


def test_reliability_decides_between_single_claims(make):
    """Two texts with one claim each: the catalogue that is right elsewhere wins, though its text is shorter and its row later."""
    texts = [WHOLE.replace("419", str(100 + g)) for g in range(9)]
    rows = []
    for g in range(8):
        wrong = texts[g].replace("34%", "35%") + " This sentence was added by a catalogue that is wrong."
        rows += [{"rec_id": 10 * g + 1, "abstract": wrong, "source_api": "bad"}, {"rec_id": 10 * g + 2, "abstract": texts[g], "source_api": "good"}]
        rows += [{"rec_id": 10 * g + 3, "abstract": texts[g], "source_api": "third"}] if g < 7 else []
        for r in rows[-3 if g < 7 else -2 :]:
            r["pmid"] = f"9000001{g}"
            r["title"] = f"Title {g}"
    groups = components.groups(make("recs", *rows))
    out = survivor.discover(survivor.members(make("recs", *rows), groups))
    got = {r["group_id"]: r["rec_id"] for r in out.chosen.filter("field = 'abstract'").collect()}
    weight = {r["catalogue"]: r["weight"] for r in out.weights.collect()}
    assert got == {10 * g + 1: 10 * g + 2 for g in range(8)} and weight["bad"] < weight["good"] and out.converged


def test_competing_counts_and_members_of_sets(make):
    rows = [{"rec_id": 1, "citations": 7, "source_api": "a+b", "found_by": ["x"]}, {"rec_id": 2, "citations": 7, "source_api": "B"}, {"rec_id": 3, "citations": 9, "source_api": "c", "found_by": ["y", "x", ""]}, {"rec_id": 4, "citations": -1, "found_by": ["z"]}]
    out = survivor.discover(survivor.members(make("recs", *[r | {"pmid": "90000001"} for r in rows])))
    got = {(r["field"], r["value"]) for r in out.chosen.collect()}
    assert got == {("citations", "9"), ("source_api", "a"), ("source_api", "b"), ("source_api", "c"), ("found_by", "x"), ("found_by", "y"), ("found_by", "z")}
    weight = {r["catalogue"]: r["weight"] for r in out.weights.collect()}
    assert weight["c"] > weight["a"] > 0.5  # its count is the newest


def test_an_abstract_in_many_unlinked_groups_is_kept_and_a_notice_in_ten_is_not(make):
    notice = "The text that belongs here was taken down at the wish of its publisher and will be put back as soon as all rights to it are cleared with the heirs of its many authors in all of the countries that are concerned by this."
    rows = [{"rec_id": 10 * g + k, "pmid": f"900000{g:02d}", "title": "One and the same work.", "abstract": WHOLE if k == 0 else None} for g in range(1, 5) for k in range(2)]
    rows += [{"rec_id": 1000 + 10 * g + k, "pmid": f"900001{g:02d}", "title": f"Work number {g}", "abstract": notice if k == 0 else None} for g in range(1, 11) for k in range(2)]
    got = values(survivor.found(make("recs", *rows)).filter("field = 'abstract'"))
    assert got == sorted([(10 * g, "abstract", str(10 * g)) for g in range(1, 5)], key=repr)


def test_notices_are_no_abstracts(make):
    notice = "An abstract is not available for this content. Please use the link above to order a copy from the desk of the publisher."
    rows = [{"rec_id": 10 * g + k, "pmid": f"9000000{g}", "abstract": notice if k == 0 else None} for g in range(1, 6) for k in range(2)]
    assert survivor.found(make("recs", *rows)).filter("field = 'abstract'").count() == 0


def test_whole_tables_survivors_name_rows_of_their_group(spark):
    recs = spark.read.parquet(str(DATA / "recs.parquet"))
    groups = {r["rec_id"]: r["group_id"] for r in components.groups(recs).collect()}
    for r in survivor.found(recs).filter("field = 'abstract'").collect():
        assert groups[int(r["val"])] == r["group_id"]
