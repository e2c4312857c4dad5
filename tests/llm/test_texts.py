"""Cut texts, packing, leaked evaluation texts and stuffed pages."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vellum.llm import leakage, packing, stuffing, truncation

from ..conftest import DATA, values

SENT = "Half of the nurses said they would keep using paired feedback after the study closed."


@pytest.mark.parametrize(
    "text, kind",
    [
        (SENT, "whole"), (f"<p>{SENT}</p>", "whole"), (f"“{SENT}”", "whole"), (SENT + " [p. 4]", "whole"), ("The agreement was 0.34.", "whole"), ("Did it really change?\n\n", "whole"), (SENT + " (n = 12).", "whole"),
        (SENT[:40], "cut"), (SENT + " Two revi", "cut"), (SENT + " Two reviewers coded […]", "cut"), (SENT + " Two (...)", "cut"), (SENT + " Two…", "cut"), (SENT + " Two...", "cut"), (SENT + " Two&hellip;", "cut"),
        (SENT + " skill &l", "cut"), (SENT + " del&#82", "cut"), (SENT + " study cl <su", "cut"), (SENT + " review</jats", "cut"), (SENT + " el ent�", "cut"), (SENT + " agreement was 0.", "cut"), (SENT + " although the gap (p = 0.1)", "cut"),
        (SENT + " Keywords: paired feedback, late note quality, retired nurses", "open"), (SENT + " Registered as Dibuk-3920", "open"), (SENT + " Data: data.x.example/set/2301", "open"), (SENT + " n = 456", "open"),
        (SENT + " (Funded by the Kegil fund, grant 79580)", "open"), ("Table 3: 0.40 [0.42, 1.51]", "open"), ("190 of 893 (4%)", "open"), ("\"198 of 848 (29%)\"", "open"),
        ("n/a", None), ("-", None), ("[object Object]", None), ("", None), ("  ", None), ("No abstract.", None), (None, None),
    ],
)
def test_endings(spark, text, kind):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(truncation.ending(F.col("t"))).first()[0] == kind


def test_lengths(spark):
    s = 'é "x" <b>&\n😀\\'
    got = spark.createDataFrame([(s,)], "t string").select(*[v.alias(k) for k, v in truncation.lengths(F.col("t")).items()]).first().asDict()
    assert got == {"characters": len(s), "utf8": len(s.encode()), "utf16": len(s) + 1, "markup": len(s) + 4 + 6 + 10, "json": len(s) + 4, "crlf": len(s) + 1}


def test_hidden_limit_marks_lists_that_were_cut(make):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9)))
    prose = lambda n: (" ".join(word() for _ in range(60)).capitalize())[:n]
    rows = [{"rec_id": i, "source_api": "s2", "abstract": prose(200)} for i in range(30)]
    keywords = lambda n: ("The end. Keywords: " + ", ".join(word() for _ in range(60)))[:n]
    rows += [{"rec_id": 100, "source_api": " S2", "abstract": keywords(200)}, {"rec_id": 101, "source_api": "s2", "abstract": keywords(190)}, {"rec_id": 102, "source_api": "x", "abstract": keywords(200)}]
    rows += [{"rec_id": 200 + i, "source_api": "x", "abstract": prose(r.randrange(60, 300)) + "."} for i in range(60)]
    got = {int(k) for t, k in values(truncation.found(make("recs", *rows).withColumn("tab", F.lit("q")).withColumn("size", F.lit(1)), make("evidence"), make("sources")))}
    assert got >= set(range(30)) | {100} and 101 not in got and not got & set(range(200, 260))


def test_repeated_keys_and_sources(make):
    evidence = make("evidence", {"id": "E1", "quote": SENT, "source": "S1"}, {"id": "E1", "quote": SENT[:30] + "…", "source": "S1"}, {"id": "E2", "quote": SENT, "source": "S9"}, {"id": None, "quote": SENT[:30]}, {"id": "E3"})
    sources = make("sources", {"id": "S1", "source_api": "s2+OpenAlex"}, {"id": "S1", "source_api": "s2+OpenAlex"})
    assert values(truncation.found(make("recs"), evidence, sources)) == [("evidence", "E1")]
    assert values(truncation.shares(make("recs"), evidence, sources)) == sorted([("evidence", "openalex", 1, 1, 1.0, None), ("evidence", "s2", 1, 1, 1.0, None), ("evidence", "unknown", 1, 0, 0.0, None)], key=repr)
    assert truncation.found(make("recs"), make("evidence"), make("sources")).count() == 0


def planted(make):
    """Texts of one source cut at 200 characters in mid-sentence, some of them exactly at a full stop, beside whole texts of all lengths; and the keys cut at a full stop."""
    r = random.Random(5)
    word = lambda n=0: "".join(r.choice("abcdefghij") for _ in range(n or r.randrange(3, 9)))
    prose = lambda: " ".join(word() for _ in range(90)).capitalize()
    rows = [{"rec_id": i, "source_api": "s2", "abstract": prose()[:195] + word(5)} for i in range(60)]
    rows += [{"rec_id": 100 + i, "source_api": "s2", "abstract": prose()[:193] + word(6) + "."} for i in range(12)]
    rows += [{"rec_id": 1000 + i, "source_api": "s2", "abstract": prose()[: r.randrange(60, 400)].strip() + "."} for i in range(400)]
    rows += [{"rec_id": 2000 + i, "source_api": "x", "abstract": prose()[:193] + word(6) + "."} for i in range(12)]
    return make("recs", *rows), set(range(60)), set(range(100, 112))


def test_limits_decide_where_endings_cannot(make):
    recs, stopped, at_stop = planted(make)
    texts = truncation.texts_of(recs, make("evidence"), make("sources"))
    rows = truncation.measured(texts)
    limit = truncation.limits(rows)
    found = {int(k) for _, k in values(truncation.cut_keys(rows, limit))}
    without = {int(k) for _, k in values(truncation.cut_keys(rows, limit.limit(0)))}
    assert stopped | at_stop <= found and without & at_stop == set() and stopped <= without
    natural = found - stopped - at_stop
    assert len(natural) <= 4 and not {k for k in natural if k >= 2000}  # whole texts of just that length can't be told from cut ones
    got = {(r["tab"], r["catalogue"]): r for r in truncation.shares(recs, make("evidence"), make("sources")).collect()}
    assert got[("recs", "s2")]["limits"] == "characters 200" and got[("recs", "x")]["limits"] is None
    assert got[("recs", "s2")]["cut_texts"] == len(found) and got[("recs", "s2")]["texts"] == 472 and got[("recs", "x")]["cut_texts"] == 0


def test_shares_against_brute_force(spark):
    recs, evidence, sources = (spark.read.parquet(str(DATA / f"{t}.parquet")) for t in ("recs", "evidence", "sources"))
    found = {(r["tab"], r["row_key"]) for r in truncation.found(recs, evidence, sources).collect()}
    api = {}
    for r in sources.select("id", "source_api").collect():
        api.setdefault(r["id"], []).append(r["source_api"])
    clean = lambda x: sorted({p.strip() for p in x.lower().split("+")}) if x else ["unknown"]
    keys = {("recs", str(r["rec_id"])): (clean(r["source_api"]), r["abstract"]) for r in recs.collect()}
    held, cut = {}, {}
    endings = {(r["tab"], r["row_key"]) for r in truncation.measured(truncation.texts_of(recs, evidence, sources)).filter("ending is not null").collect()}
    for (tab, key), (names, _) in keys.items():
        if (tab, key) in endings:
            for n in names:
                held[n] = held.get(n, 0) + 1
                cut[n] = cut.get(n, 0) + ((tab, key) in found)
    got = {r["catalogue"]: (r["texts"], r["cut_texts"]) for r in truncation.shares(recs, evidence, sources).filter("tab = 'recs'").collect()}
    assert got == {n: (held[n], cut[n]) for n in held}


def check_packing(rows, sizes, capacity):
    parts, fill = {}, {}
    for r in rows:
        parts.setdefault(r["doc_id"], []).append(r["tokens"])
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
    assert sorted(parts) == sorted(sizes) and all(sum(parts[d]) == sizes[d] for d in sizes)
    assert all(len(parts[d]) == 1 for d in sizes if sizes[d] <= capacity)
    assert max(fill.values()) <= capacity and all(fill[r["container"]] == r["container_fill"] for r in rows)
    return len(fill)


@pytest.mark.parametrize("block", [10**6, 40])
def test_packing(spark, block):
    r = random.Random(4)
    sizes = {i: r.choice([r.randrange(1, 60), r.randrange(1, 900), 1000, 1001, 2500]) for i in range(400)} | {999: 0}
    rows = packing.pack(spark.createDataFrame(list(sizes.items()), "doc_id long, tokens long"), 1000, block=block, fan=4).collect()
    used = check_packing(rows, sizes, 1000)
    assert used <= -(-sum(sizes.values()) // 1000) * 1.02 + 1


def test_items_that_fill_no_bin_stay_in_bounded_blocks(spark):
    """Each item takes 0.6 of a bin, so that no round can close one: no block may grow beyond twice its size, whatever the number of rounds."""
    n, block, rounds = 20_000, 100, []
    rows = packing.pack(spark.range(n).select(F.col("id").alias("doc_id"), F.lit(600).cast("bigint").alias("tokens")), 1000, block=block, fan=4, rounds=rounds).collect()
    assert check_packing(rows, {i: 600 for i in range(n)}, 1000) == n
    for items, packed in rounds:
        sizes = [r["count"] for r in packed.groupBy("block").count().collect()]
        assert max(sizes) <= 2 * block and sum(sizes) == items and len(sizes) >= items // (2 * block)
    assert all(later <= items // 2 for (items, _), (later, _) in zip(rounds, rounds[1:]))


def test_full_pieces_have_containers_of_their_own(spark):
    sized = spark.range(500).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit(3000).cast("bigint").alias("tokens")).repartition(7)
    got = packing.pack(sized, 1000, block=50).groupBy("container").agg(F.count(F.lit(1)).alias("n"), F.first("container_fill").alias("fill")).collect()
    assert len(got) == 1500 and all(r["n"] == 1 and r["fill"] == 1000 for r in got)


def test_packing_of_texts_nulls_and_nothing(make):
    docs = make("documents", {"doc_id": 1, "text": "one two three"}, {"doc_id": 2, "text": None}, {"doc_id": 3, "text": ""}, {"doc_id": 4, "text": "word " * 5000}, {"doc_id": 5, "text": "<|endoftext|>"}, {"text": "x"}).withColumn("tokens", F.lit(0)).withColumn("part", F.lit(0))
    rows = packing.containers(docs, capacity=100).collect()
    assert {r["doc_id"] for r in rows} == {1, 3, 4, 5} and max(r["container_fill"] for r in rows) <= 100
    assert packing.containers(make("documents")).count() == 0
    assert packing.unused(make("documents")).first()["documents"] == 0


def test_local_search_raises_the_squared_fill():
    r = random.Random(9)
    sizes = np.array([r.randrange(5, 70) for _ in range(120)])
    start = [[i, i + 1] for i in range(0, 120, 2)]
    start = [b for b in start if sizes[b].sum() <= 100] + [[i] for b in start if sizes[b].sum() > 100 for i in b]
    end = packing.local_search([list(b) for b in start], sizes, 100)
    assert sorted(i for b in end for i in b) == list(range(120)) and max(sizes[b].sum() for b in end) <= 100
    assert sum(sizes[b].sum() ** 2 for b in end) > sum(sizes[b].sum() ** 2 for b in start) and len(end) < len(start)
    assert len(end) <= -(-sizes.sum() // 100) + 2


@pytest.fixture(scope="module")
def items():
    return pd.read_parquet(DATA / "eval_items.parquet")


def test_leaks_in_many_forms(make, items):
    a, b, c = items.iloc[0], items.iloc[5], items.iloc[9]
    p, first = a["passage"], a["passage"].split(". ")[0] + "."
    typo = first[:50] + first[51:90] + "x" + first[90:]
    docs = {
        1: SENT + " " + p, 2: "Note. " + first.upper(), 3: "<p>" + first.replace(" ", "&nbsp;") + "</p>", 4: "\n> ".join(p.split(" ")), 5: typo, 6: "Q: " + b["question"], 7: b["answer"], 8: SENT, 9: None, 10: "",
        11: f"As reported (see {first.split(' ')[6]}), this is a different matter.", 12: (SENT + " ") * 700 + c["passage"], 13: p.encode().decode("latin-1"),
    }
    frame = make("documents", *[{"doc_id": k, "text": v} for k, v in docs.items()]).withColumn("item_id", F.lit(0)).withColumn("passage", F.lit(""))
    table = make("eval_items", *items.to_dict("records"))
    got = set(values(leakage.found(frame, table)))
    ia, ib, ic = (int(x["item_id"]) for x in (a, b, c))
    assert got == {(1, ia), (2, ia), (3, ia), (4, ia), (5, ia), (6, ib), (12, ic), (13, ia)}
    assert set(values(leakage.found(frame, table, block=20_000))) == got  # the same in several blocks
    assert leakage.found(make("documents"), table).count() == 0 and leakage.found(frame, make("eval_items", {"item_id": 1})).count() == 0


def test_same_phrases_about_other_names_and_figures_are_no_leaks(items):
    index = leakage.Index([(int(i), t) for i, p, q in zip(items.item_id, items.passage, items.question) for t in (p, q)])
    text = " ".join(items.passage[:120])
    for k, name in enumerate(sorted(index.names, key=len, reverse=True)):
        text = __import__("re").sub(rf"(?i)\b{name}\b", f"Qoxu{k:03d}bel".translate(str.maketrans("0123456789", "abcdefghij")).capitalize(), text)
    text = __import__("re").sub(r"\d+", lambda m: str(int(m[0]) * 3 + 7), text)
    assert index.scan([s for s in text.split(". ")]) == []


def test_lemma_bound_holds(items):
    """A window with EDITS edits keeps at least NEED of its q-grams."""
    r = random.Random(1)
    s = items.passage[0][: leakage.WINDOW]
    for _ in range(200):
        t = list(s)
        for _ in range(leakage.EDITS):
            t[r.randrange(len(t))] = r.choice("abcxyz")
        g = lambda x: {(i, x[i : i + leakage.Q]) for i in range(len(x) - leakage.Q + 1)}
        assert len(g(s) & g("".join(t))) >= leakage.NEED


def test_banded_distance_equals_the_full_table():
    r = np.random.default_rng(3)
    for _ in range(40):
        a, b = r.integers(1, 4, r.integers(1, 30)).astype(np.uint8), r.integers(1, 4, r.integers(1, 40)).astype(np.uint8)
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert leakage.banded_distance(a, b, 0, 80) == min(row)


def test_stuffed_pages(spark, make):
    prose = [r["text"] for r in spark.read.parquet(str(DATA / "documents.parquet")).filter("doc_kind in ('abstract', 'fulltext') and lang = 'en' and length(text) > 500 and text like '%. %'").select("text").collect()]
    prose = [t for t in prose if "https://" not in t and "the" in t and ". " in t[:300]]
    r = random.Random(6)
    words = ["cheap essay", "best thesis", "free trial", "paired audit feedback", "download", "review writing"]
    spam = {
        9001: ", ".join(r.choice(words) for _ in range(80)), 9002: "\n".join(f"https://a{i}.example/buy?id={i}" for i in range(40)), 9003: " ".join("#" + w.replace(" ", "") for w in r.choices(words, k=70)),
        9004: " ".join(f"{w} ({r.randrange(400)})" for w in r.choices(words, k=90)), 9005: "\n".join(f'<a href="https://x.example/{w[:4]}">{w}</a>' for w in r.choices(words, k=60)),
    }
    rows = [{"doc_id": i, "text": t, "lang": "en"} for i, t in enumerate(prose)] + [{"doc_id": k, "text": v, "lang": "en" if k % 2 else None} for k, v in spam.items()]
    rows += [{"doc_id": 8001, "text": prose[0] + "\n\nTags: " + ", ".join(words), "lang": "en"}, {"doc_id": 8002, "text": None}, {"doc_id": 8003, "text": ""}, {"doc_id": 8004, "text": "See attachment."}, {"text": spam[9001]}]
    docs = make("documents", *rows).withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).withColumn("f", F.lit(1))
    got = {d for (d,) in values(stuffing.found(docs))}
    assert got >= set(spam) and not got & {8001, 8002, 8003, 8004}
    assert len(got - set(spam)) <= 0.03 * len(prose)
    assert stuffing.found(make("documents")).count() == 0


def test_rank_frequency_fit(make):
    """Counting, ranks with ties, the fit and the curves against a plain computation."""
    text = " ".join(w for k, w in enumerate("abcdefghij") for _ in range(1 + 40 // (k + 1))) + " tail <b>end</b>"
    counts = sorted([1 + 40 // (k + 1) for k in range(10)] + [1, 1], reverse=True)
    rows = stuffing.counted(make("documents", {"doc_id": 1, "text": text, "lang": "en"}))
    one = rows.first()
    assert sorted(one["counts"], reverse=True) == counts and one["n"] == sum(counts) and len(set(one["words"])) == 12
    row = stuffing.pages(rows).first()
    rank = np.array([np.mean([i + 1 for i, g in enumerate(counts) if g == f]) for f in counts])
    x, y = np.log(rank), np.log(counts)
    slope, cut = np.polyfit(x, y, 1)
    assert row["v"] == 12 and abs(row["slope"] - slope) < 1e-9 and abs(row["residual"] - np.sqrt(((y - cut - slope * x) ** 2).mean())) < 1e-9
    assert all(abs(row[f"own{r}"] - sum(counts[:r]) / sum(counts)) < 1e-12 for r in stuffing.RANKS)


def test_pages_without_text_shuffle(spark):
    """Only numbers cross an exchange: nothing after the counting reads a text, and the counting has no exchange."""
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    assert "Exchange" not in stuffing.counted(docs)._jdf.queryExecution().executedPlan().toString()


def test_repeated_rows_and_unlabelled_pages(make):
    spam = ", ".join(["cheap essay", "best thesis"] * 40)
    rows = [{"doc_id": 1, "text": spam}, {"doc_id": 1, "text": SENT}, {"doc_id": 2, "text": spam, "lang": "en"}, {"doc_id": 2, "text": spam, "lang": "en"}]
    got = values(stuffing.judged(make("documents", *rows)), "doc_id", "n")
    assert got == [(1, 15), (1, 160), (2, 160), (2, 160)] and stuffing.judged(make("documents")).count() == 0
