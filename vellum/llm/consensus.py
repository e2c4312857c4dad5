"""Consensus of several annotators' labels (problem 2): a community confusion model fitted by variational updates.

Annotators belong to types; each type has a confusion matrix shared by its members, and each annotator's own matrix is
drawn around the matrix of its type with a strength of ``STRENGTH`` pseudo-votes per true label.  An annotator with few
labels therefore keeps close to its type, one with many is judged by its own record.  The updates alternate between the
items (posterior of the true label), the annotators (posterior of type and matrix) and the types (shared matrices).

While the counted number of annotators is at most ``MAX_BROADCAST``, their parameters (some 72 bytes each) go to the tasks and the votes of an item stand in one
row, as an array of at most one number per annotator.  An iteration is then one job without any exchange but for the expected counts, which each task sums
before it hands them on: three by three per annotator.  Beyond that number, parameters and votes are joined with salts instead, which exchanges the
votes by annotator and by item in every iteration.  Whether the fit settled within ``iterations`` is reported as ``converged``.

Defined results: null items, reviewers and verdicts are left out, as are verdicts outside the labels; a row written twice
counts once; an annotator's last vote on an item by ``seq`` counts (of equal ``seq``, the alphabetically last verdict);
a tie in the posterior falls to the label named first; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.skew import salted_lookup
from ..sources import shared
from ..sources.shared import Scratch

LABELS = ("include", "exclude", "defer")
STRENGTH = 12.0
MAX_BROADCAST = 100_000


def clean_verdict(verdict: Column) -> Column:
    return F.lower(F.regexp_replace(verdict, "^[\\s\\p{IsWhite_Space}]+|[\\s\\p{IsWhite_Space}]+$", ""))


def last_votes(screening: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """``(source, reviewer, verdict)``: each reviewer's last non-null verdict on each source."""
    verdict = clean_verdict(F.col("verdict"))
    rows = screening.select("source", "reviewer", F.struct("seq", verdict.alias("verdict")).alias("x")).filter("source is not null and reviewer is not null and x.verdict is not null")
    last = rows.groupBy("source", "reviewer").agg(F.max("x").alias("x"))
    return last.select("source", "reviewer", F.col("x.verdict").alias("verdict")).filter(F.col("verdict").isin(*labels))


def _digamma(x: np.ndarray) -> np.ndarray:
    x, less = x.copy(), np.zeros_like(x)
    for _ in range(6):
        less += 1 / x
        x += 1
    y = 1 / (x * x)
    return np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252)) - less


def type_prototypes(n: int) -> np.ndarray:
    """Starting matrices [type, true, given]: reliable, middling, guessing, and one leaning to each label."""
    eye, flat = np.eye(n), np.full((n, n), 1 / n)
    leaning = [0.45 * eye + 0.15 * flat + 0.4 * np.eye(n)[[k] * n] for k in range(n)]
    return np.stack([0.9 * eye + 0.1 * flat, 0.6 * eye + 0.4 * flat, 0.15 * eye + 0.85 * flat, *leaning])


def _annotators(types: np.ndarray, weights: np.ndarray, prior: np.ndarray, strength: float, n: int):
    """Row-wise update of annotators: type posterior and own matrix from the expected counts c0..c{n*n-1} [true, given]."""
    k = len(types)
    mean = types / types.sum(-1, keepdims=True)
    elog = _digamma(types) - _digamma(types.sum(-1, keepdims=True))
    etype = _digamma(weights) - _digamma(weights.sum(keepdims=True))
    eprior = _digamma(prior) - _digamma(prior.sum(keepdims=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = pdf[[f"c{i}" for i in range(n * n)]].to_numpy().reshape(-1, n, n)
            score = etype + np.einsum("rjl,kjl->rk", counts, elog)
            resp = np.exp(score - score.max(1, keepdims=True))
            resp /= resp.sum(1, keepdims=True)
            own = strength * np.einsum("rk,kjl->rjl", resp, mean) + counts
            logs = _digamma(own) - _digamma(own.sum(-1, keepdims=True))
            out = {"reviewer": pdf["reviewer"]} | {f"c{i}": counts.reshape(-1, n * n)[:, i] for i in range(n * n)}
            out |= {f"t{i}": resp[:, i] for i in range(k)}
            out |= {f"m{i}": (own / own.sum(-1, keepdims=True)).reshape(-1, n * n)[:, i] for i in range(n * n)}
            out |= {f"e{i}": logs.reshape(-1, n * n)[:, i] for i in range(n * n)}
            out |= {f"p{i}": np.full(len(pdf), eprior[i]) for i in range(n)}
            yield pd.DataFrame(out)

    fields = [f"{c}{i}" for c, m in (("c", n * n), ("t", k), ("m", n * n), ("e", n * n), ("p", n)) for i in range(m)]
    return run, "reviewer string, " + ", ".join(f"{f} double" for f in fields)


def _posterior(flat: np.ndarray, starts: np.ndarray, logs: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The posterior of each item; ``flat`` are its votes (annotator times labels, plus label), ``logs`` (annotator * labels + given, true)."""
    s = np.add.reduceat(logs[flat], starts, axis=0) + begin
    q = np.exp(s - s.max(1, keepdims=True))
    return q / q.sum(1, keepdims=True)


def _batches(batches: Iterator[pa.RecordBatch]):
    """``(sources, votes of all items one after another, where each item's begin, how many it has)`` of each batch."""
    for batch in batches:
        if batch.num_rows:
            lists = batch.column("votes")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            yield batch.column("source"), flat, ends[:-1] - ends[0], np.diff(ends)


def _expected(logs: np.ndarray, begin: np.ndarray, n: int):
    """Each task's expected counts: a row per annotator and given label that occurs, ``(at, c0..)``; the sums of the posterior stand at -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total, some = np.zeros((len(logs), n)), np.zeros(n), False
        for _, flat, starts, sizes in _batches(batches):
            q, some = _posterior(flat, starts, logs, begin), True
            each = np.repeat(q, sizes, axis=0)
            for j in range(n):
                counts[:, j] += np.bincount(flat, each[:, j], len(logs))
            total += q.sum(0)
        if some:
            at = np.flatnonzero(counts.any(1))
            rows = np.vstack([total, counts[at]])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at)), *[pa.array(rows[:, j]) for j in range(n)]], ["at", *[f"c{j}" for j in range(n)]])

    return run, "at bigint, " + ", ".join(f"c{j} double" for j in range(n))


def _items(logs: np.ndarray, begin: np.ndarray, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source, flat, starts, sizes in _batches(batches):
            q = _posterior(flat, starts, logs, begin)
            yield pa.RecordBatch.from_arrays([source, *[pa.array(q[:, j]) for j in range(n)], pa.array(sizes.astype(np.int64))], ["source", *[f"q{j}" for j in range(n)], "n"])

    return run, "source string, " + ", ".join(f"q{j} double" for j in range(n)) + ", n bigint"


class Fit:
    """A fitted model: ``items (source, q0.., n)`` and ``annotators (reviewer, c*, t*, m*, e*)``."""

    def __init__(self, items: DataFrame, annotators: DataFrame, prior: np.ndarray, labels: Sequence[str], iterations: int, converged: bool):
        self.items, self.annotators, self.prior, self.labels, self.iterations, self.converged = items, annotators, prior, tuple(labels), iterations, converged

    def consensus(self) -> DataFrame:
        """``(source, verdict, certainty, reviewers)`` for every item with a vote."""
        n = len(self.labels)
        q = [F.round(f"q{j}", 9) for j in range(n)]
        best = F.greatest(*q)
        pick = F.coalesce(*[F.when(x == best, F.lit(label)) for x, label in zip(q, self.labels)])
        return self.items.select("source", pick.alias("verdict"), best.alias("certainty"), F.col("n").alias("reviewers"))

    def reliability(self) -> DataFrame:
        """``(reviewer, votes, reliability, likely_type)``: the chance of the right label, averaged over the labels' prior."""
        n = len(self.labels)
        k = n + 3
        votes = sum(F.col(f"c{i}") for i in range(n * n))
        right = sum(float(self.prior[j]) * F.col(f"m{j * n + j}") for j in range(n))
        top = F.greatest(*[F.col(f"t{i}") for i in range(k)])
        names = ["reliable", "middling", "guessing", *(f"leans to {x}" for x in self.labels)]
        kind = F.coalesce(*[F.when(F.col(f"t{i}") == top, F.lit(x)) for i, x in enumerate(names)])
        return self.annotators.select("reviewer", F.round(votes).cast("bigint").alias("votes"), right.alias("reliability"), kind.alias("likely_type"))


class _Types:
    """The shared part of the model: types' matrices and weights, and the labels' prior, as pseudo-counts."""

    def __init__(self, n: int):
        self.n, self.types = n, 1 + 20 * type_prototypes(n)
        self.weights, self.prior = np.full(len(self.types), 2.0), np.full(n, 1.0)

    def update(self, moved: np.ndarray, held_by: np.ndarray) -> float:
        """Take in the annotators' counts by type; how far a matrix moved."""
        before = self.types / self.types.sum(-1, keepdims=True)
        self.types, self.weights = 1 + 4 * type_prototypes(self.n) + moved, 2.0 + held_by
        return float(np.abs(self.types / self.types.sum(-1, keepdims=True) - before).max())


def fit(votes: DataFrame, labels: Sequence[str] = LABELS, strength: float = STRENGTH, iterations: int = 25, tolerance: float = 1e-3, max_broadcast: int = MAX_BROADCAST) -> Fit:
    """Fit the model to ``votes (source, reviewer, verdict)`` with one vote per source and reviewer."""
    scratch = Scratch(votes.sparkSession, "consensus")
    label = F.coalesce(*[F.when(F.col("verdict") == x, F.lit(i)) for i, x in enumerate(labels)])
    votes = scratch.keep(votes.select("source", "reviewer", label.cast("tinyint").alias("y")))
    reviewers = scratch.keep(votes.select("reviewer").distinct())
    fitting = _fit_small if shared.rows(reviewers) <= max_broadcast else _fit_large
    return fitting(votes, reviewers, tuple(labels), strength, iterations, tolerance, scratch)


def _fit_small(votes: DataFrame, reviewers: DataFrame, labels: tuple[str, ...], strength: float, iterations: int, tolerance: float, scratch: Scratch) -> Fit:
    """``reviewers`` are counted: at most ``MAX_BROADCAST``."""
    spark, n = votes.sparkSession, len(labels)
    names = sorted(r["reviewer"] for r in reviewers.collect())
    table = spark.createDataFrame(pd.DataFrame({"reviewer": pd.Series(names, dtype=object), "k": np.arange(len(names))}), "reviewer string, k int")
    coded = votes.join(table, "reviewer").select("source", (F.col("k") * n + F.col("y")).alias("vote"))
    items = scratch.keep(coded.groupBy("source").agg(F.sort_array(F.collect_list("vote")).alias("votes")))  # at most one vote per annotator
    model, people = _Types(n), None
    # shares of the votes, smoothed, to begin with
    logs, begin = 1.1 * np.tile(np.eye(n), (max(1, len(names)), 1)), np.zeros(n)
    converged, step = not names, 0
    schema = _annotators(model.types, model.weights, model.prior, strength, n)[1]
    while step < iterations and names:
        step += 1
        run, kind = _expected(logs, begin, n)
        sums = items.mapInArrow(run, kind).groupBy("at").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(n)]).toPandas().sort_values("at", ignore_index=True)
        at, c = sums["at"].to_numpy(), sums[[f"c{j}" for j in range(n)]].to_numpy()
        model.prior = 1.0 + c[at < 0].sum(0)
        counts = np.zeros((len(names) * n, n))
        counts[at[at >= 0]] = c[at >= 0]
        counts = counts.reshape(-1, n, n).transpose(0, 2, 1).reshape(-1, n * n)  # [true, given]
        run, _ = _annotators(model.types, model.weights, model.prior, strength, n)
        people = next(run(iter([pd.DataFrame({"reviewer": names} | {f"c{i}": counts[:, i] for i in range(n * n)})])))
        logs = people[[f"e{i}" for i in range(n * n)]].to_numpy().reshape(-1, n, n).transpose(0, 2, 1).reshape(-1, n)
        begin = people[[f"p{j}" for j in range(n)]].to_numpy()[0]
        resp = people[[f"t{a}" for a in range(len(model.types))]].to_numpy()
        moved = model.update((resp.T @ counts).reshape(-1, n, n), resp.sum(0))
        if converged := step > 3 and moved < tolerance:
            break
    run, kind = _items(logs, begin, n)
    told = spark.createDataFrame(people, schema) if people is not None else spark.createDataFrame([], schema)
    return Fit(items.mapInArrow(run, kind), told, model.prior / model.prior.sum(), labels, step, converged)


def _fit_large(votes: DataFrame, reviewers: DataFrame, labels: tuple[str, ...], strength: float, iterations: int, tolerance: float, scratch: Scratch) -> Fit:
    """The same updates where the annotators are too many to be sent to every task."""
    n = len(labels)
    same = W.partitionBy("source")
    model, k = _Types(n), n + 3
    people: DataFrame | None = None
    step, converged = 0, False
    while True:
        if people is None:
            rows, logs, begin = votes, [F.when(F.col("y") == j, F.lit(1.1)).otherwise(F.lit(0.0)) for j in range(n)], [F.lit(0.0)] * n
        else:
            told = people.select("reviewer", *[f"e{i}" for i in range(n * n)], *[f"p{j}" for j in range(n)])
            rows = salted_lookup(votes, told, ["reviewer"], "source")
            logs = [F.coalesce(*[F.when(F.col("y") == i, F.col(f"e{j * n + i}")) for i in range(n)]) for j in range(n)]
            begin = [F.col(f"p{j}") for j in range(n)]
        rows = rows.select("source", "reviewer", "y", *[(F.sum(x).over(same) + begin[j]).alias(f"s{j}") for j, x in enumerate(logs)], F.count(F.lit(1)).over(same).alias("n"))
        top = F.greatest(*[F.col(f"s{j}") for j in range(n)])
        rows = rows.select("source", "reviewer", "y", "n", *[F.exp(F.col(f"s{j}") - top).alias(f"s{j}") for j in range(n)])
        total = sum(F.col(f"s{j}") for j in range(n))
        rows = rows.select("source", "reviewer", "y", "n", *[(F.col(f"s{j}") / total).alias(f"q{j}") for j in range(n)])
        if converged or step == iterations:
            break
        step += 1
        counts = rows.groupBy("reviewer").agg(
            *[F.sum(F.when(F.col("y") == i, F.col(f"q{j}")).otherwise(0.0)).alias(f"c{j * n + i}") for j in range(n) for i in range(n)],
            *[F.sum(F.col(f"q{j}") / F.col("n")).alias(f"w{j}") for j in range(n)],
        )
        counts = scratch.keep(counts, **{f"w{j}": F.sum(f"w{j}") for j in range(n)})
        model.prior = 1.0 + np.array([shared.measure(counts, f"w{j}") or 0.0 for j in range(n)])
        run, schema = _annotators(model.types, model.weights, model.prior, strength, n)
        people = scratch.keep(counts.mapInPandas(run, schema))
        sums = people.agg(*[F.sum(F.col(f"t{a}") * F.col(f"c{i}")) for a in range(k) for i in range(n * n)], *[F.sum(f"t{a}") for a in range(k)]).first()
        moved = model.update(np.array(sums[: k * n * n], dtype=float).reshape(k, n, n), np.array(sums[k * n * n :], dtype=float))
        converged = step > 3 and moved < tolerance
    items = rows.groupBy("source").agg(*[F.first(f"q{j}").alias(f"q{j}") for j in range(n)], F.first("n").alias("n"))
    return Fit(items, people, model.prior / model.prior.sum(), labels, step, converged)


def found(screening: DataFrame, least: int = 3, **options) -> DataFrame:
    """``(source, verdict)`` for every source with verdicts of at least ``least`` reviewers."""
    fitted = fit(last_votes(screening), **options)
    return fitted.consensus().filter(F.col("reviewers") >= least).select("source", "verdict")


def reliability(screening: DataFrame, **options) -> DataFrame:
    """``(reviewer, votes, reliability, likely_type)``."""
    return fit(last_votes(screening), **options).reliability()


def agreement(screening: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """``(source, reviewers, agreement)``: the share of pairs of reviewers with the same last verdict; null for one reviewer."""
    votes = last_votes(screening, labels)
    counts = votes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("verdict") == x).alias(f"n{i}") for i, x in enumerate(labels)])
    same = sum(F.col(f"n{i}") * (F.col(f"n{i}") - 1) for i in range(len(labels)))
    return counts.select("source", F.col("n").alias("reviewers"), F.round(F.try_divide(same, F.col("n") * (F.col("n") - 1)), 6).alias("agreement"))
