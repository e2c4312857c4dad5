"""Leaks of passages that several items share (problem 8)."""

from __future__ import annotations

import pandas as pd
import pytest
from vellum.llm import leakage

from ..conftest import DATA, values

PLAIN = "The visitors walked slowly along the quiet river until they reached the old wooden bridge where the children were waiting for the evening boat to come back."


@pytest.mark.parametrize("block", [leakage.BLOCK, 20_000])
def test_every_item_of_a_shared_passage_is_reported(make, block):
    items = pd.read_parquet(DATA / "eval_items.parquet")
    rows = items.to_dict("records")
    shared = [r | {"item_id": 9000 + k, "passage": rows[0]["passage"]} for k, r in enumerate(rows[20:27])]
    plain = [{"item_id": 9100 + k, "passage": PLAIN} for k in range(4)]
    overlap = [{"item_id": 9200 + k, "passage": PLAIN.replace("visitors", "workers") + " " + rows[30 + k]["passage"]} for k in range(6)]
    first = rows[0]["passage"].split(". ")[0] + "."
    docs = make("documents", {"doc_id": 1, "text": rows[0]["passage"]}, {"doc_id": 2, "text": "Note. " + first}, {"doc_id": 3, "text": "Before. " + PLAIN.replace("visitors", "workers") + " After."})
    docs = docs.select("doc_id", "text")
    got = set(values(leakage.found(docs, make("eval_items", *rows, *shared, *plain, *overlap), block)))
    own = {int(rows[0]["item_id"])} | {9000 + k for k in range(7)}
    assert {(d, i) for d in (1, 2) for i in own} <= got
    assert {i for d, i in got if d == 3} >= {9200 + k for k in range(6)}
    assert {i for d, i in got if d in (1, 2)} == own


def test_a_run_up_to_another_figure_is_no_leak(make):
    item = "In the Vepivoso records, a blank field stands for unplanned rework rate that was seen but not timed, a habit that confused later coders for 5 years."
    names = ("Vepivoso", "Dikosupu", "Dizezafa", "Turobaso", "Rifosuli", "Pizokume")
    items = [{"item_id": k, "passage": item.replace("Vepivoso", n).replace("5 years", f"{5 + k} years")} for k, n in enumerate(names)]
    other = item.replace("Vepivoso", "Gasobire").replace("5 years", "18 years")
    docs = make("documents", {"doc_id": 1, "text": other[3:]}, {"doc_id": 2, "text": items[3]["passage"]}).select("doc_id", "text")
    assert values(leakage.found(docs, make("eval_items", *items))) == [(2, 3)]


@pytest.mark.parametrize("figures", [True, False])
@pytest.mark.parametrize("shared", [2, 5, 50, 1000])
def test_recall_of_shared_passages_against_brute_force(make, shared, figures):
    """Every item of a shared passage, whatever their number: all (document, item) pairs whose text is in the document."""
    text = PLAIN + (" They counted 417 boats and 39 riders in 1987." if figures else "")
    items = [{"item_id": k, "passage": text, "question": f"Which of the {k} boats that were seen on the river by the visitors came back to the old wooden bridge after the evening of the day?"} for k in range(shared)]
    docs = [{"doc_id": 1, "text": "Before. " + text + " After."}, {"doc_id": 2, "text": text.upper()}, {"doc_id": 3, "text": "Another text about other things that nobody has asked anything about so far in any of the items."}]
    got = set(values(leakage.found(make("documents", *docs).select("doc_id", "text"), make("eval_items", *items))))
    truth = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["passage"].lower() in d["text"].lower()}
    assert got == truth and len(truth) == 2 * shared


@pytest.mark.parametrize("shared", [3, 5, 40])
def test_an_edited_passage_of_overlapping_items_is_found_for_all(make, shared):
    """No q-gram of the run is rare and no window of it has fewer than two edits; still every item with these figures is looked at."""
    text = PLAIN + " They counted 417 boats and 39 riders in 1987 before the gates were closed again for the long winter that was to follow."
    rows = pd.read_parquet(DATA / "eval_items.parquet").to_dict("records")[:shared]
    items = [{"item_id": k, "passage": text + " " + r["passage"]} for k, r in enumerate(rows)]
    edited = "".join("x" if n % 34 == 20 and c.isalpha() else c for n, c in enumerate(text))
    other = edited.replace("417", "418").replace("39", "38").replace("1987", "1988")
    got = values(leakage.found(make("documents", {"doc_id": 1, "text": "Before. " + edited}, {"doc_id": 2, "text": other}).select("doc_id", "text"), make("eval_items", *items)))
    assert sorted(got) == [(1, k) for k in range(shared)]


def test_texts_scanned_together_do_not_matter():
    items = pd.read_parquet(DATA / "eval_items.parquet")
    index = leakage.Index([(int(i), t) for i, p, q in zip(items.item_id, items.passage, items.question) for t in (p, q)])
    texts = [t for t in pd.read_parquet(DATA / "documents.parquet").text if t is not None]
    alone = {(k, i) for k, t in enumerate(texts) for _, i in index.scan([t])}
    assert alone and set(index.scan(texts)) == alone == {(k, i) for k, i in ((d - 1, i) for d, i in index.scan(["x" * 7, *texts]))}
