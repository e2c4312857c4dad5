"""Literal outcomes of the text and identity functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vellum.functions import identity, text
from vellum.operators import catalogue


@pytest.fixture
def one(spark):
    def get(f, *values):
        df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
        return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]

    return get


@pytest.mark.parametrize(
    "summary, quote, missing",
    [
        ("Adoption reached 47% of teams", "many teams adopted it", ["47%"]),
        ("87% improved", "a ratio of 0.87", ["87%"]),
        ("see section 3.2 [S004]", "no numbers here", []),
        ("45 teams", "45% of teams", []),
        ("45% of teams", "45 teams", ["45%"]),
        ("1,234,567 records", "1234567 records", []),
        ("GPT-4 and COVID-19", "nothing", []),
        ("12 percent", "12 %", []),
        ("", "5", []),
    ],
)
def test_numbers_missing(one, summary, quote, missing):
    assert one(text.numbers_missing, summary, quote) == missing


def test_numbers_of_itself_are_never_missing(one):
    s = "From 12.5% to 40 in 2019, p. 7, n = 1,024"
    assert one(text.numbers_missing, s, s) == []
    assert one(text.numbers_in, s) == ["12.5%", "40", "2019", "1024"]


@pytest.mark.parametrize(
    "s, figures",
    [("see §5.2 and § 7", ["5.2", "7"]), ("as x§5.2 says", []), ("in section 5.2, figure 3 and p. 9", []), ("about 3 of (fig. 4)", ["3"]), ("chapters 5", ["5"])],
)
def test_numbers_of_places(one, s, figures):
    """A sign § counts as the name of a place only right behind a word character."""
    assert one(text.numbers_in, s) == [f for f in figures]


def test_null_text_has_no_numbers(one):
    assert one(text.numbers_in, None) == []


def test_inverted_index(spark):
    df = spark.createDataFrame([({"b": [1], "a": [0]},), ({},), (None,), ({"a": [2, 0], "b": None},)], "m map<string,array<int>>")
    assert [r[0] for r in df.select(text.from_inverted_index(F.col("m"))).collect()] == ["a b", None, None, "a a"]


@pytest.mark.parametrize("doi, clean", [("https://doi.org/10.1/AB", "10.1/ab"), ("doi:10.1/Ab ", "10.1/ab"), ("", None), (None, None)])
def test_clean_doi(one, doi, clean):
    assert one(identity.clean_doi, doi) == clean


@pytest.mark.parametrize("arxiv, clean", [("arXiv:2312.10997v5", "2312.10997"), ("https://arxiv.org/abs/2312.10997", "2312.10997"), ("", None)])
def test_clean_arxiv(one, arxiv, clean):
    assert one(identity.clean_arxiv, arxiv) == clean


def test_title_keys_differ_in_accents(one):
    a, b = "Évaluation des réseaux: étude", "evaluation des reseaux  etude"
    assert one(identity.title_key, a, "2020") == one(identity.title_key, b, "2020") == "evaluation des reseaux etude|2020"
    assert one(identity.ledger_title_key, a, "2020") != one(identity.ledger_title_key, b, "2020")
    assert one(identity.title_key, "too short", "2020") is None


@pytest.mark.parametrize("name, key", [("Rasanen, T.", "rasanen,t"), ("T. Rasanen", "rasanen,t"), ("Jean-Luc  Dé Mo", "mo,j"), ("X", None), (None, None)])
def test_author_key(one, name, key):
    assert one(identity.author_key, name) == key


@pytest.mark.parametrize(
    "url, normal",
    [("HTTPS://A.example/B/?utm_source=x&b=1#top", "https://a.example/b?b=1"), ("https://a.example//", "https://a.example"), (" not a url ", "not a url"), ("https://a.example?ref=1", "https://a.example")],
)
def test_normal_url(one, url, normal):
    assert one(identity.normal_url, url) == normal


def test_plain_markup(one):
    assert one(text.plain_markup, "<p>A &amp; B</p><script>x<y</script><p>C&#37;  D</p>") == "A & B\n C% D".replace("\n ", "\n")


def test_article_text_keeps_titles_and_drops_references(one):
    xml = "<article><body><sec><title>Results</title><p>Good.</p></sec><ref-list><ref>x</ref></ref-list></body><back>y</back></article>"
    got = one(text.article_text, xml)
    assert "## Results" in got and "Good." in got and "x" not in got.replace("x", "", 0).split() and "y" not in got.split()


def test_refusals(one):
    assert one(text.memory_refusal, "nah") and one(text.memory_refusal, "don't bother.") and one(text.memory_refusal, "thôi khỏi")
    assert not one(text.memory_refusal, "Not every catalogue returns abstracts for older works")


def test_redacted(one):
    assert one(text.redacted, "https://a.example/?api_key=S3&x=1") == "https://a.example/?api_key=<redacted>&x=1"


def test_preprint_venues(one):
    assert one(catalogue.is_preprint, "bioRxiv (Cold Spring)") and not one(catalogue.is_preprint, "Journal of Work") and one(catalogue.is_preprint, None) is False


def test_anomalies(make):
    df = make("recs", {"rec_id": 1}, {"rec_id": 2, "title": "T", "authors": ["A"], "url": "u", "retracted": True, "year": 2026, "citations": 301}, {"rec_id": 3, "title": "T", "authors": ["A"], "doi": "d", "year": 2091})
    got = {r["rec_id"]: r["a"] for r in df.select("rec_id", catalogue.anomalies(2026).alias("a")).collect()}
    assert got == {1: ["no-title", "no-authors", "no-locator"], 2: ["RETRACTED", "citations-year-mismatch:301@2026"], 3: ["implausible-year:2091"]}


@pytest.mark.parametrize(
    "dialect, both, lower, upper",
    [
        ("openalex", "publication_year:2015-2020", "publication_year:>2014", "publication_year:<2021"), ("s2", "2015-2020", "2015-", "-2020"),
        ("crossref", "from-pub-date:2015-01-01,until-pub-date:2020-12-31", "from-pub-date:2015-01-01", "until-pub-date:2020-12-31"),
        ("europepmc", "(PUB_YEAR:[2015 TO 2020])", "(PUB_YEAR:[2015 TO 2100])", "(PUB_YEAR:[1800 TO 2020])"),
    ],
)
def test_year_clauses(dialect, both, lower, upper):
    clause = catalogue.year_clause
    assert (clause(dialect, 2015, 2020), clause(dialect, 2015, None), clause(dialect, None, 2020), clause(dialect, None, None)) == (both, lower, upper, "")
