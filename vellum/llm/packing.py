"""Filling fixed-capacity containers with documents (problem 7): swap-based local search.

Sizes are counts of a public tokenizer's tokens, taken from whole texts in Arrow batches.  A document larger than the
capacity fills containers of its own, and its rest is packed like any other document; no other document is split.

The rest is packed in blocks of about BLOCK items, which keeps each task's memory bounded whatever the corpus.  In a block,
items first fill bins best-fit in falling size; then a local search takes the emptiest bins and exchanges one item for one,
two for one, or moves one to another underfull bin whenever that raises the sum of squared fills, until bins run empty.
A block's emptiest underfull bins, with at most one FAN-th of its items (or else the emptiest one, if that holds at most half of them), are
opened again and their items packed with those of other blocks; all other bins stay as they are.  So a round has at most half of the items of the
round before, whatever the sizes, and always one block for each BLOCK items.

Defined results: null texts are left out, empty texts have no tokens and go into the first container of their block; rows
with the same ``doc_id`` are separate items; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared
from ..sources.shared import Scratch

TOKENIZER = os.environ.get("VELLUM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The published split pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CAPACITY, BLOCK, FAN = 8192, 20_000, 64
#: Only a bin filled to less than this share is opened again in the next round.
FULL = 0.995
#: Takers in a row that may have nothing for a bin before the local search leaves it.
TRIES = 256


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, tokens)`` of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(tokenizer).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": np.array([len(encode(t)) for t in pdf["text"]], np.int64)})

    return documents.filter("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(run, "doc_id bigint, tokens bigint")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: items in falling size, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # free space and bin, sorted
    for i in np.lexsort((np.arange(len(sizes)), -sizes)):
        s = int(sizes[i])
        at = bisect_left(room, (s, -1))
        if at == len(room):
            bins.append([int(i)])
            insort(room, (capacity - s, len(bins) - 1))
        else:
            free, b = room.pop(at)
            bins[b].append(int(i))
            insort(room, (free - s, b))
    return bins


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int, passes: int = 4, tries: int = TRIES) -> list[list[int]]:
    """Raise the sum of squared fills by moves and one-for-one and two-for-one exchanges between underfull bins.

    Taking d tokens from a bin of fill a to one of fill b changes the sum by 2 d (b - a + d), so an exchange pays if
    d > a - b and d fits.  The emptiest bin gives, the fuller ones take; a bin that runs empty is gone.  A giver that ``tries`` takers one after another
    have nothing for is left as it is, which bounds the effort where no sizes fit together.
    """
    fill = [int(sizes[b].sum()) for b in map(np.array, bins)]
    held = [sorted((int(sizes[i]), i) for i in b) for b in bins]
    for _ in range(passes):
        order = [k for k in sorted(range(len(bins)), key=lambda k: (fill[k], k)) if held[k] and fill[k] < capacity]
        changed = False
        for at, giver in enumerate(order):
            if not held[giver]:
                continue
            failed = 0
            for taker in reversed(order[at + 1 :]):
                before = fill[taker]
                while held[giver] and fill[taker] < capacity:
                    step = _exchange(held[giver], held[taker], capacity - fill[taker], fill[giver] - fill[taker])
                    if step is None:
                        break
                    out, back = step
                    moved = sum(x[0] for x in out) - sum(x[0] for x in back)
                    held[giver] = sorted([x for x in held[giver] if x not in out] + back)
                    held[taker] = sorted([x for x in held[taker] if x not in back] + out)
                    fill[giver] -= moved
                    fill[taker] += moved
                    changed = True
                failed = 0 if fill[taker] > before else failed + 1
                if not held[giver] or failed >= tries:
                    break
        if not changed:
            break
    return [[i for _, i in b] for b in held if b]


def _exchange(g: list[tuple[int, int]], t: list[tuple[int, int]], room: int, lead: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]] | None:
    """The exchange between a giver's and a taker's sorted items that brings most to the taker: at most ``room``, more than 0 and more than ``lead`` tokens."""
    most, out, back = max(0, lead), [], []
    k = bisect_left(g, (room + 1,)) - 1
    if k >= 0 and g[k][0] > most:
        most, out = g[k][0], [g[k]]
    for x in t:  # one for one: the largest that still fits once the other has left
        if most == room:
            break
        k = bisect_left(g, (x[0] + room + 1,)) - 1
        if k >= 0 and g[k][0] - x[0] > most:
            most, out, back = g[k][0] - x[0], [g[k]], [x]
    if most < room and len(g) > 1:
        for x in t:  # two for one, by two pointers
            lo, hi = 0, len(g) - 1
            while lo < hi and most < room:
                gain = g[lo][0] + g[hi][0] - x[0]
                if gain > room:
                    hi -= 1
                else:
                    if gain > most:
                        most, out, back = gain, [g[lo], g[hi]], [x]
                    lo += 1
    return (out, back) if out else None


def _pack(capacity: int, last: bool, salt: int, fan: int):
    """Packs a partition, which is one block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        pdf = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if not len(pdf):
            return
        pdf = pdf.sort_values(["size", "doc_id", "part", "copy"], ascending=[False, True, True, True], ignore_index=True)
        sizes = pdf["size"].to_numpy()
        bins = local_search(best_fit(sizes, capacity), sizes, capacity)
        bins.sort(key=lambda b: min(b))
        number, fill, again = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
        for k, b in enumerate(bins):
            number[b], fill[b] = k, int(sizes[b].sum())
        left, first = len(pdf) // fan, True
        for b in sorted((b for b in bins if fill[b[0]] < FULL * capacity and not last), key=lambda b: (fill[b[0]], b[0])):
            if len(b) > left and not (first and len(b) <= len(pdf) // 2):
                break
            again[b] = True
            left, first = left - len(b), False
        block = int(pdf["block"].iloc[0])
        pdf["container"] = (np.int64(salt) << 56) + (np.int64(block) << 20) + number
        pdf["fill"], pdf["done"] = fill, ~again
        yield pdf

    return run


def pack(sized: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, fan: int = FAN, rounds: list | None = None) -> DataFrame:
    """``(doc_id, part, tokens, container, container_fill)`` for ``sized (doc_id, tokens)``.

    ``part`` is 0, or counts the pieces of a document that exceeds the capacity; ``container`` is a number.  ``rounds`` receives the items and the
    packed table of each round.
    """
    scratch = Scratch(sized.sparkSession, "packing")
    whole = F.floor(F.greatest(F.col("tokens") - 1, F.lit(0)) / capacity).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), whole), lambda i: F.struct(i.alias("part"), F.when(i < whole, F.lit(capacity)).otherwise(F.col("tokens") - whole * capacity).cast("bigint").alias("size")))
    items = sized.select("doc_id", F.monotonically_increasing_id().alias("copy"), F.explode(pieces).alias("x")).select("doc_id", "copy", "x.*")
    items = scratch.keep(items)
    full = items.filter(F.col("size") == capacity)
    open_ = items.filter(F.col("size") < capacity)
    number = F.lit(1 << 62) + F.monotonically_increasing_id()  # above all numbers of blocks; kept, so that it is given once
    full = scratch.keep(full.select("doc_id", "part", "size", number.alias("container"), F.col("size").alias("fill")))
    done = [full]
    n, salt = shared.rows(items) - shared.rows(full), 0
    kind = "doc_id bigint, copy bigint, part int, size bigint, block int, container bigint, fill bigint, done boolean"
    while n:
        count = -(-n // block)
        open_ = open_.select("doc_id", "copy", "part", "size", F.pmod(F.xxhash64("doc_id", "part", "copy", F.lit(salt)), F.lit(count)).cast("int").alias("block"))
        packed = scratch.keep(open_.repartitionById(count, F.col("block")).mapInPandas(_pack(capacity, count == 1, salt, fan), kind), open=F.count_if(~F.col("done")))
        done.append(packed.filter("done").select("doc_id", "part", "size", "container", "fill"))
        open_ = packed.filter("not done")
        if rounds is not None:
            rounds.append((n, packed))
        n, salt = shared.measure(packed, "open") or 0, salt + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "part", F.col("size").alias("tokens"), "container", F.col("fill").alias("container_fill"))


def containers(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """The container of each document (or of each piece of a document that exceeds the capacity)."""
    return pack(token_counts(documents, tokenizer), capacity)


def unused(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row: documents, tokens, containers, the fewest containers the tokens could fill, and the unused share."""
    placed = containers(documents, capacity, tokenizer)
    used = placed.agg(F.countDistinct("doc_id").alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.countDistinct("container").alias("containers"))
    return used.select("documents", "tokens", "containers", F.ceil(F.col("tokens") / capacity).alias("fewest"), F.round(1 - F.try_divide(F.col("tokens"), F.col("containers") * capacity), 6).alias("unused"))
