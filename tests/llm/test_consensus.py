"""The community confusion model on simulated reviewers and on edge cases."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellum.llm import consensus

from ..conftest import values


def simulated(make, seed=5, items=400, reviewers=24, per_item=5):
    r = random.Random(seed)
    labels = consensus.LABELS
    kind = {f"r{k}": ("good" if k % 4 < 2 else "guess" if k % 4 == 2 else "leans") for k in range(reviewers)}
    truth, rows, votes = {}, [], {}
    for i in range(items):
        s = f"S{i}"
        truth[s] = r.choices(labels, (3, 6, 1))[0]
        for w in r.sample(sorted(kind), per_item):
            k = kind[w]
            ok = r.random() < {"good": 0.9, "guess": 0.35, "leans": 0.3}[k]
            v = truth[s] if ok else ("include" if k == "leans" else r.choice(labels))
            rows.append({"seq": len(rows), "source": s, "reviewer": w, "verdict": v.upper() + " " if len(rows) % 5 == 0 else v})
            votes.setdefault(s, []).append(v)
    return make("screening", *rows), truth, votes, kind


@pytest.mark.parametrize("broadcast", [10**5, 0])
def test_beats_the_majority_and_finds_the_types(make, broadcast):
    screening, truth, votes, kind = simulated(make)
    fitted = consensus.fit(consensus.last_votes(screening), max_broadcast=broadcast, iterations=8)
    got = {r["source"]: r["verdict"] for r in fitted.consensus().collect()}
    right = sum(got[s] == t for s, t in truth.items()) / len(truth)
    majority = sum(Counter(votes[s]).most_common(1)[0][0] == t for s, t in truth.items()) / len(truth)
    assert right > majority + 0.03 and right > 0.85
    rel = {r["reviewer"]: r["reliability"] for r in fitted.reliability().collect()}
    assert min(rel[w] for w in kind if kind[w] == "good") > max(rel[w] for w in kind if kind[w] != "good")


def test_last_vote_counts_and_nulls_do_not(make):
    rows = [
        {"seq": 1, "source": "A", "reviewer": "x", "verdict": "include"}, {"seq": 5, "source": "A", "reviewer": "x", "verdict": None}, {"seq": 3, "source": "A", "reviewer": "x", "verdict": " Exclude\n"},
        {"seq": 2, "source": "A", "reviewer": "y", "verdict": "exclude"}, {"seq": 4, "source": "A", "reviewer": "y", "verdict": "exclude"}, {"seq": 6, "source": "A", "reviewer": "z", "verdict": "exclude"},
        {"seq": 7, "source": "B", "reviewer": "x", "verdict": "include"}, {"seq": 8, "source": "B", "reviewer": "y", "verdict": "maybe"}, {"seq": 9, "reviewer": "x", "verdict": "include"}, {"seq": 10, "source": "A", "verdict": "include"},
    ]
    screening = make("screening", *rows).withColumn("n", F.lit(0)).withColumn("y", F.lit(0))
    assert values(consensus.last_votes(screening)) == sorted([("A", "x", "exclude"), ("A", "y", "exclude"), ("A", "z", "exclude"), ("B", "x", "include")], key=repr)
    assert values(consensus.found(screening)) == [("A", "exclude")]
    assert values(consensus.agreement(screening)) == [("A", 3, 1.0), ("B", 1, None)]


def test_empty_table(make):
    assert consensus.found(make("screening")).count() == 0
    assert consensus.reliability(make("screening")).count() == 0
    assert consensus.agreement(make("screening")).count() == 0


def test_few_labels_stay_near_their_type(make):
    screening, *_ = simulated(make)
    extra = make("screening", {"seq": 10**6, "source": "S1", "reviewer": "new", "verdict": "defer"})
    rel = {r["reviewer"]: r["reliability"] for r in consensus.reliability(screening.unionByName(extra), iterations=6).collect()}
    assert 0.2 < rel["new"] < 0.95


def test_both_plans_agree(make):
    """Annotators sent to every task or joined: the same posteriors and reliabilities."""
    screening, *_ = simulated(make, items=120, reviewers=12)
    small, large = (consensus.fit(consensus.last_votes(screening), max_broadcast=m, iterations=6) for m in (100, 0))
    a, b = ({r["source"]: (r["verdict"], round(r["certainty"], 6), r["reviewers"]) for r in f.consensus().collect()} for f in (small, large))
    assert a == b
    a, b = ({r["reviewer"]: (r["votes"], round(r["reliability"], 6), r["likely_type"]) for r in f.reliability().collect()} for f in (small, large))
    assert a == b and small.iterations == large.iterations


def test_settled_or_not_is_reported(make):
    screening, *_ = simulated(make, items=120, reviewers=12)
    assert not consensus.fit(consensus.last_votes(screening), iterations=2).converged
    done = consensus.fit(consensus.last_votes(screening), iterations=200)
    assert done.converged and done.iterations < 200


def test_reviewers_against_a_plain_fit(make):
    """Reliability against the same updates written out over dictionaries, two iterations."""
    import numpy as np

    screening, *_ = simulated(make, items=40, reviewers=8, per_item=4)
    votes = [(r["source"], r["reviewer"], consensus.LABELS.index(r["verdict"])) for r in consensus.last_votes(screening).collect()]
    people, n = sorted({w for _, w, _ in votes}), 3
    digamma = lambda x: consensus._digamma(np.asarray(x, float))
    protos = consensus.type_prototypes(n)
    types, weights = 1 + 20 * protos, np.full(len(protos), 2.0)
    log, begin, own, prior = {w: 1.1 * np.eye(n) for w in people}, np.zeros(n), {}, None
    for _ in range(2):
        score = {}
        for s, w, y in votes:
            score[s] = score.get(s, begin) + log[w][:, y]
        q = {s: np.exp(x - x.max()) / np.exp(x - x.max()).sum() for s, x in score.items()}
        prior = 1 + sum(q.values())
        counts = {w: np.zeros((n, n)) for w in people}
        for s, w, y in votes:
            counts[w][:, y] += q[s]
        mean, elog = types / types.sum(-1, keepdims=True), digamma(types) - digamma(types.sum(-1, keepdims=True))
        moved, held = np.zeros_like(types), np.zeros(len(types))
        for w in people:
            z = digamma(weights) - digamma(weights.sum()) + np.array([(counts[w] * e).sum() for e in elog])
            r = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            own[w] = consensus.STRENGTH * np.tensordot(r, mean, 1) + counts[w]
            log[w] = digamma(own[w]) - digamma(own[w].sum(-1, keepdims=True))
            moved, held = moved + r[:, None, None] * counts[w], held + r
        begin = digamma(prior) - digamma(prior.sum())
        types, weights = 1 + 4 * protos + moved, 2.0 + held
    expect = {w: float((prior / prior.sum() * np.diag(own[w] / own[w].sum(-1, keepdims=True))).sum()) for w in people}
    got = {r["reviewer"]: r["reliability"] for r in consensus.fit(consensus.last_votes(screening), iterations=2).reliability().collect()}
    assert got.keys() == expect.keys() and all(abs(got[w] - expect[w]) < 1e-9 for w in people)
