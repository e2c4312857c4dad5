"""Evaluation texts that leaked into a corpus (problem 8): q-gram lemma filtering and banded verification.

The evaluation items are a stated query set, taken in blocks of at most BLOCK characters; each block's index of character
q-grams is what the tasks receive.  Every document is scanned whole:

1. Text is folded to 37 symbols (letters without marks, digits, a gap), so a q-gram is an exact 32-bit number.
2. A window of WINDOW symbols with at most EDITS edits keeps at least WINDOW + 1 - q - q * EDITS of its q-grams (the lemma).
   Windows in which fewer q-grams occur in the index at all are dropped; this leaves few regions.  In a region all parts are looked at
   that step 4 can confirm there, however many share its words: those with a name that stands in or beside it, and those with enough q-grams on
   neighbouring diagonals in a run that either holds figures, enough of which stand nearby, or is long enough without any.  In regions that hold
   a window with at most one edit all parts that share such a window are compared as well.  Equal parts are one part, with all
   their items; names are counted over the distinct parts of all blocks.
3. In the regions each shared q-gram of these parts gives a diagonal (place in the document less place in the item).  Shared q-grams are
   counted in overlapping bands of BAND diagonals; an item's band is kept where some window of it meets the bound.
4. Each kept region is verified by an alignment restricted to its band: at most RATE of the symbols may differ, and the
   words that tell items apart (names that at most NAME_ITEMS items have, and figures) have to agree.  Sentences with the same turns of phrase
   about other names and figures fail there.  A run without a name has to be a whole sentence or RUN_WORDS words with the same figures; one without
   figures, too, a whole part or RUN_WORDS words, all but unchanged.

No shuffle is needed besides removing repeated pairs.  Nothing of the documents is sent to the driver.

Defined results: null and empty texts match nothing; an item part shorter than WINDOW symbols matches nothing; repeated
documents each get their rows; items with equal text are each reported; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q, WINDOW, EDITS, BAND, RATE, NAME_ITEMS = 6, 84, 4, 16, 0.22, 2
#: How far beside a run its names and figures may stand.
REACH = 80
#: The rate for a run without a name, and how far around it another name in the name's place is looked for.
STRICT, SENTENCE = 0.08, 200
#: The rate for a run with neither names nor figures that tell it apart, and the words that it has to hold unless it is a whole part.
EXACT, RUN_WORDS = 0.02, 20
#: Characters of items handled at once, and symbols of documents scanned at once.
BLOCK, SCAN = 4_000_000, 4_000_000
NEED = WINDOW + 1 - Q - Q * EDITS
#: The same for a window with one edit.
CLOSE = WINDOW + 1 - Q - Q
#: A window holds five whole runs of STRIDE q-grams, and one edit touches at most two neighbours of them; two of the rest lie on one diagonal.
STRIDE = (WINDOW + 1 - Q) // 6
#: A window holds 15 whole runs of CELL q-grams; an edit touches at most two of them, so FEWEST are kept whole.
CELL = 5
FEWEST = (WINDOW + 1 - Q - (CELL - 1)) // CELL - 2 * EDITS
#: Hits, and cells of a table of regions and parts, that are held at once.
HITS, TABLE = 250_000, 1_000_000
GAP, STOP = 0, 37
#: Stops between texts: more than a region and its surroundings span, so that no text affects what is found in its neighbours.
PAD = WINDOW + REACH + Q + 6
_BITS = (19, 22)
_LETTERS = b" abcdefghijklmnopqrstuvwxyz0123456789".ljust(256)
_FIGURE = re.compile(r"(?<!\S)\d+(?!\S)")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,8});")
_BROKEN = re.compile("[ÂÃ][\u0080-¿]|â€[‘-™\u0090-¿]")


@lru_cache(1)
def fold_table() -> np.ndarray:
    """Symbol of each character: 1-26 letters, 27-36 digits, 0 for anything else; 38 for marks, which are left out."""
    table = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind[0] == "M" or ch == "­" or kind == "Cf":
            table[c] = 38
        elif kind[0] in "LN":
            plain = unicodedata.normalize("NFKD", ch.lower())[0]
            plain = {"ß": "s", "æ": "a", "œ": "o", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "t", "ı": "i"}.get(plain, plain)
            if "a" <= plain <= "z":
                table[c] = ord(plain) - 96
            elif "0" <= plain <= "9":
                table[c] = ord(plain) - 21
            else:
                table[c] = 1 + c % 26  # other scripts: any fixed letter
    table[0xE000] = STOP  # stands between texts, see repair
    return table


def repair(text: str) -> str:
    """Without tags and entities, and with the commonest wrong decodings of UTF-8 undone."""
    if "\ue000" in text:  # stands for a stop in fold
        text = text.replace("\ue000", " ")
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]).replace("\ue000", " "), text)
    if "Ã" in text or "Â" in text or "â€" in text:
        text = _BROKEN.sub(lambda m: m[0].encode("latin-1").decode("utf-8", "replace") if ord(m[0][0]) < 0xE2 else "'", text)
    return text


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, one after another with PAD stops between, and where each text begins (with the end)."""
    table = fold_table()
    joined = ("" * PAD).join(["", *map(repair, texts), ""])
    try:
        codes = np.frombuffer(joined.encode("utf-16-le"), np.uint16)
        far = codes & 0xF800 == 0xD800  # halves of characters beyond 16 bits: the first is a gap, the second left out
        sym = table[codes]
        if far.any():
            sym[far] = np.where(codes[far] < 0xDC00, GAP, 38)
    except UnicodeEncodeError:
        codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        sym = table[np.minimum(codes, 0xFFFF)]
        sym[codes > 0xFFFF] = GAP
    if (marks := sym == 38).any():
        sym = sym[~marks]
    gap = sym == GAP
    keep = np.ones(len(sym), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    sym = sym[keep]
    at = np.flatnonzero(sym == STOP).reshape(-1, PAD)  # every text lies between two runs of stops
    return sym, np.append(at[:-1, -1] + 1, at[-1, 0] + PAD if len(at) else 0)


def grams(sym: np.ndarray) -> np.ndarray:
    """The q-gram that begins at each symbol, as a number below 38 ** 6."""
    s = sym.astype(np.uint32)
    n = max(0, len(s) - Q + 1)
    two = s[: n + 4] * 38 + s[1 : n + 5]
    return two[:n] * np.uint32(38**4) + two[2 : n + 2] * np.uint32(38**2) + two[4 : n + 4]


def _slot(g: np.ndarray, bits: int) -> np.ndarray:
    return (g * np.uint32(2654435761)) >> np.uint32(32 - bits)


def _starts(at: np.ndarray, count: int, span: int) -> np.ndarray:
    """The places ``at`` from which ``count`` of them lie within ``span``."""
    n = max(0, len(at) - count + 1)
    return at[:n][at[count - 1 :] - at[:n] < span]


def _in_bands(pair: np.ndarray, diagonal: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of two overlapping sets of bands: the order of hits by pair and band, the number of each one's band, and its pair."""
    for shift in (0, BAND // 2):
        band = (diagonal + shift) // BAND
        band -= band.min(initial=0)
        width = int(band.max(initial=0)) + 1
        key, bits = pair.astype(np.int64) * width + band, len(pair).bit_length()
        if int(key.max(initial=0)) >> (62 - bits):
            order = np.argsort(key, kind="stable")
            key = key[order]
        else:  # sorted with their places, which is much faster
            key = np.sort((key << bits) | np.arange(len(key)))
            order, key = key & ((1 << bits) - 1), key >> bits
        yield order, key, pair[order]


def _touches_stop(sym: np.ndarray, n: int) -> np.ndarray:
    bad = np.concatenate([[0], np.cumsum(sym == STOP)])
    return (bad[Q : n + Q] - bad[:n]) > 0


def distinct(parts: list[tuple[int, str]] | list[tuple[tuple[int, ...], str]]) -> list[tuple[tuple[int, ...], str]]:
    """Parts that fold to the same symbols as one, with all their items."""
    sym, begin = fold([t for _, t in parts])
    held: dict[bytes, tuple[set[int], str]] = {}
    for k, (items, text) in enumerate(parts):
        held.setdefault(sym[begin[k] : begin[k + 1] - PAD].tobytes(), (set(), text))[0].update(items if isinstance(items, tuple) else (int(items),))
    return [(tuple(sorted(items)), text) for items, text in held.values()]


def telling(parts: list[tuple[tuple[int, ...], str]]) -> set[str]:
    """The names that at most NAME_ITEMS items have, over the distinct ``parts``.

    Items with the same longest part, as several questions on one passage, count as one.
    """
    longest: dict[int, int] = {}
    for k, (items, text) in enumerate(parts):
        for i in items:
            if i not in longest or len(text) > len(parts[longest[i]][1]):
                longest[i] = k
    sym, begin = fold([t for _, t in parts])
    owners: dict[str, set[int]] = {}
    for k, (items, _) in enumerate(parts):
        for w in set(Index.text(sym, begin[k], begin[k + 1] - PAD).split()):
            if len(w) >= 4 and not any(c.isdigit() for c in w):
                owners.setdefault(w, set()).update(longest[i] for i in items)
    return {w for w, o in owners.items() if len(o) <= NAME_ITEMS}


class Index:
    """The q-grams of the distinct parts (passage, question) of a block of items; ``told`` is what ``telling`` says of all blocks."""

    def __init__(self, parts: list[tuple[int, str]] | list[tuple[tuple[int, ...], str]], told: set[str] | None = None):
        parts = distinct(parts)
        names = telling(parts) if told is None else told
        self.items = [items for items, _ in parts]
        self.sym, self.begin = fold([t for _, t in parts])
        g = grams(self.sym)
        part = np.searchsorted(self.begin, np.arange(len(g)), "right") - 1
        inside = (part >= 0) & ~_touches_stop(self.sym, len(g))
        pos = np.flatnonzero(inside)
        order = np.argsort(g[pos], kind="stable")
        self.pos, self.part = pos[order].astype(np.int64), part[pos][order].astype(np.int32)
        self.within = self.pos - self.begin[self.part]
        self.gram, self.first, self.count = np.unique(g[pos][order], return_index=True, return_counts=True)
        self.size = min(_BITS[1], max(_BITS[0], len(self.gram).bit_length() + 4))
        self.bits = np.zeros(1 << self.size, bool)
        self.bits[_slot(self.gram, self.size)] = True
        self.words = [self.text(self.sym, self.begin[k], self.begin[k + 1] - PAD).split() for k in range(len(parts))]
        self.names = names
        self.sentence = [np.repeat(np.arange(len(n)), n) for n in (_words_by_sentence(t) for _, t in parts)]
        self._tell()

    def _tell(self) -> None:
        """Where names, figures, words and sentences of the parts stand, and what the q-grams of runs without figures have to show."""
        inner = (self.sym != GAP) & (self.sym != STOP)
        starts = inner & ~np.append(False, inner[:-1])
        self.begun = np.append(0, np.cumsum(starts))  # words that begin before each place
        place = np.arange(len(self.sym))
        self.back = np.maximum.accumulate(np.where(np.append(True, ~inner[:-1]), place, 0))  # to whole words, as in _verify
        self.on = np.append(np.minimum.accumulate(np.where(inner, len(inner), place)[::-1])[::-1], len(inner))
        first = [int(self.begun[b]) for b in self.begin[:-1]]
        self.sentence_from = np.array([f + x for f, of in zip(first, self.sentence) for x in np.searchsorted(of, np.unique(of))], np.int64)
        self.sentence_to = np.array([f + x for f, of in zip(first, self.sentence) for x in np.searchsorted(of, np.unique(of), "right")], np.int64)
        self.called: dict[str, list[int]] = {}
        self.figure: dict[str, int] = {}
        part, place, figure, free, need, span = [], [], [], np.full(len(self.sym), -1, np.int32), [], []
        for k, words in enumerate(self.words):
            low, high = int(self.begin[k]), int(self.begin[k + 1]) - PAD
            begins = [low + m.start() for m in re.finditer(r"\S+", self.text(self.sym, low, high))]
            for w in set(words) & self.names:
                self.called.setdefault(w, []).append(k)
            at = [i for i, w in enumerate(words) if w.isdigit()]
            for i in at:
                part.append(k), place.append(begins[i]), figure.append(self.figure.setdefault(words[i], len(self.figure)))
            for i, j in zip([0, *(x + 1 for x in at)], [*at, len(words)]):
                least = min(RUN_WORDS, len(words))
                if j - i < max(1, least):
                    continue
                close = [begins[x] + len(words[x]) for x in range(i, j)]
                size = min(close[x + least - 1] - begins[i + x] for x in range(j - i - least + 1))
                # a run of at least this size has a window of the size with no more edits than these
                edits = int(min(EXACT * (close[-1] - begins[i]), 2 * EXACT * size))
                free[begins[i] : close[-1]] = len(need)
                need.append(max(1, (size + 1 - Q - edits - (CELL - 1)) // CELL - 2 * edits)), span.append(size + edits - Q)
        self.figure_part, self.figure_at, self.figure_of = (np.array(x, np.int64) for x in (part, place, figure))
        order = np.argsort(self.figure_of, kind="stable")
        edge = np.searchsorted(self.figure_of[order], np.arange(len(self.figure) + 1))
        self.figure_parts = [np.unique(self.figure_part[order[a:b]]) for a, b in zip(edge[:-1], edge[1:])]
        self.free, self.need, self.span = free[self.pos], np.array(need, np.int64), np.array(span, np.int64)
        self.ends: dict[str, list[str]] = {}
        for w in self.called:
            if len(w) >= 5:
                for key in {"<" + w[:3], ">" + w[-3:]}:
                    self.ends.setdefault(key, []).append(w)
        self.heard: dict[str, tuple[int, ...]] = {}

    def _whole_sentence(self, first, last):
        """Whether the words from ``first`` to before ``last``, counted over all parts, hold a whole sentence."""
        k = np.minimum(np.searchsorted(self.sentence_from, first), len(self.sentence_from) - 1)
        return (self.sentence_from[k] >= first) & (self.sentence_to[k] <= last)

    def _hears(self, word: str) -> tuple[int, ...]:
        """The parts with a name that ``word`` is, or nearly is."""
        got = self.heard.get(word)
        if got is None:
            names = {w for key in ("<" + word[:3], ">" + word[-3:]) for w in self.ends.get(key, ()) if _near(w, word)} | ({word} & self.called.keys())
            if len(self.heard) > 200_000:
                self.heard.clear()
            got = self.heard[word] = tuple(sorted({k for w in names for k in self.called[w]}))
        return got

    @staticmethod
    def text(sym: np.ndarray, a: int, b: int) -> str:
        return sym[max(0, a) : max(0, b)].tobytes().translate(_LETTERS).decode()

    @staticmethod
    def whole_words(sym: np.ndarray, a: int, b: int) -> tuple[int, int]:
        """``a`` and ``b`` moved outwards to the ends of words."""
        a, b = max(0, a), min(len(sym), b)
        while a > 0 and sym[a - 1] != GAP and sym[a - 1] != STOP:
            a -= 1
        while b < len(sym) and sym[b] != GAP and sym[b] != STOP:
            b += 1
        return a, b

    def scan(self, texts: list[str]) -> list[tuple[int, int]]:
        """``(place in texts, item)`` of each text that holds part of an item."""
        if not len(self.gram):
            return []
        sym, begin = fold(texts)
        g = grams(sym)
        if len(g) < WINDOW:
            return []
        at = self._in_dense_parts(g)
        k = np.searchsorted(self.gram, g[at])
        k[k == len(self.gram)] = 0
        sure = self.gram[k] == g[at]
        at, k = at[sure], k[sure]
        span = WINDOW - Q + 1
        # a dense window stays dense when it is moved on to its first known q-gram
        dense = _starts(at, NEED, span)
        if not len(dense):
            return []
        cut = np.flatnonzero(np.diff(dense) > span) + 1
        begins, ends = dense[np.append(0, cut)], dense[np.append(cut - 1, len(dense) - 1)] + span
        inside = (at >= begins[0]) & (at < ends[np.maximum(0, np.searchsorted(begins, at, "right") - 1)])
        at, k = at[inside], k[inside]
        close = _starts(at, CLOSE, span)
        whole = np.searchsorted(close, ends) > np.searchsorted(close, begins)  # only then can a run be compared straight
        parts = self._looked_at(sym, at, k, begins, ends)  # of each region by a name, otherwise, and figures with their places
        out = self._bands(sym, begin, at, k, begins, parts)
        least_at, least_k = self._least(at, k, begins, STRIDE)
        first, last = np.searchsorted(least_at, begins), np.searchsorted(least_at, ends)
        low, high = np.searchsorted(at, begins), np.searchsorted(at, ends) - 1
        for r in np.flatnonzero(whole):
            out |= self._same(sym, begin, least_at[first[r] : last[r]], least_k[first[r] : last[r]], int(at[low[r]]), int(at[high[r]]) + Q, out)
        return sorted({(d, i) for d, which in out for i in self.items[which]})

    def _in_dense_parts(self, g: np.ndarray) -> np.ndarray:
        """Where q-grams that may be known begin, wherever enough of them for a dense window lie in eights side by side."""
        maybe = np.zeros(-(-len(g) // 8) * 8, bool)
        np.take(self.bits, _slot(g, self.size), out=maybe[: len(g)], mode="clip")
        eights = maybe.view(np.uint64)
        total = np.append(0, np.cumsum(((eights * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)))
        width = (WINDOW - Q + 1 + 7 + 7) // 8  # so many a window touches at most
        n = len(eights)
        dense = np.flatnonzero(total[np.minimum(np.arange(n) + width, n)] - total[:-1] >= NEED)
        edge = np.zeros(n + width + 1, np.int32)
        edge[dense] += 1
        edge[dense + width] -= 1
        eights[np.cumsum(edge[:n]) == 0] = 0
        return np.flatnonzero(maybe)

    def _least(self, at: np.ndarray, k: np.ndarray, begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The least frequent of the q-grams ``k`` in each run of ``size`` places, from the beginning of each region, so that texts scanned together don't matter."""
        region = np.searchsorted(begins, at, "right") - 1
        new = np.append(True, (np.diff((at - begins[region]) // size) != 0) | (np.diff(region) > 0))
        least = np.minimum.reduceat((self.count[k].astype(np.int64) << 32) + np.arange(len(k)), np.flatnonzero(new)) & 0xFFFFFFFF
        return at[least], k[least]

    def _looked_at(self, sym: np.ndarray, at: np.ndarray, k: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """The parts of which a run may be confirmed in each region: by a name, and by figures or without either; the figures in and beside regions with their places, sorted."""
        named, others = [], [np.zeros(0, np.int64)] * len(begins)
        region, figure, place = [], [], []
        for r, (x, y) in enumerate(zip(begins.tolist(), ends.tolist())):
            x, y = self.whole_words(sym, x - BAND - REACH, y + Q + BAND + REACH)
            text = self.text(sym, x, y)
            named.append(np.array(sorted({p for w in set(text.split()) for p in self._hears(w)}), np.int64))
            for m in _FIGURE.finditer(text):
                f = self.figure.get(m[0])
                if f is not None:
                    region.append(r), figure.append(f), place.append(x + m.start())
        cell_at, cell_k = self._least(at, k, begins, CELL)
        for r0, r1, a, b in self._chunks(cell_at, cell_k, begins):
            f0, f1 = np.searchsorted(region, [r0, r1])
            r, p = self._by_cells(cell_at[a:b], cell_k[a:b], begins[r0:r1], [x - r0 for x in region[f0:f1]], figure[f0:f1])
            edge = np.searchsorted(r, np.arange(r1 - r0 + 1))
            others[r0:r1] = [p[x:y] for x, y in zip(edge[:-1], edge[1:])]
        return named, others, np.unique((np.array(figure, np.int64) << 32) + np.array(place, np.int64))

    def _chunks(self, at: np.ndarray, k: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Regions ``r0..r1`` with their q-grams ``a..b``, so many at once as HITS and TABLE allow (and at least one)."""
        edge = np.append(np.searchsorted(at, begins), len(at))
        hits = np.append(0, np.cumsum(self.count[k]))[edge]
        few, r0 = max(1, TABLE // len(self.items)), 0
        while r0 < len(begins):
            r1 = min(len(begins), r0 + few, max(r0 + 1, int(np.searchsorted(hits, hits[r0] + HITS, "right")) - 1))
            yield r0, r1, int(edge[r0]), int(edge[r1])
            r0 = r1

    def _entries(self, at: np.ndarray, k: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places in the index of all parts' q-grams ``k``, and of each the number of its region and part, and its place in the region."""
        n = self.count[k]
        entry = np.repeat((self.first[k] - np.cumsum(n) + n).astype(np.int32), n)
        entry += np.arange(len(entry), dtype=np.int32)
        region = np.searchsorted(begins, at, "right") - 1
        pair = np.repeat((region * len(self.items)).astype(np.int32), n)
        pair += self.part[entry]
        return entry, pair, np.repeat((at - begins[region]).astype(np.int32), n)

    def _by_cells(self, at: np.ndarray, k: np.ndarray, begins: np.ndarray, region: list[int], figure: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The regions and parts where enough of the cells' q-grams lie on neighbouring diagonals, and a figure of the part stands there or the run is long without any.

        ``figure`` are the figures in and beside each ``region``.
        """
        parts = len(self.items)
        table = np.zeros((len(begins), parts), bool)
        for r, f in zip(region, figure):
            table[r, self.figure_parts[f]] = True
        entry, pair, at = self._entries(at, k, begins)
        table = table.ravel()
        hit = np.flatnonzero(table[pair])
        told, other = pair[hit], np.flatnonzero(self.free[entry] >= 0)
        told = hit[np.bincount(told, minlength=len(table))[told] >= FEWEST]
        free = pair[other]
        free = other[np.bincount(free, minlength=len(table))[free] >= self.need.min(initial=FEWEST)]
        got = [np.zeros(0, np.int64)]
        for order, ks, pairs in _in_bands(pair[told], at[told] - self.within[entry[told]]):
            ps, m = at[told[order]], max(0, len(told) - FEWEST + 1)
            got.append(pairs[:m][(ks[FEWEST - 1 :] == ks[:m]) & (ps[FEWEST - 1 :] - ps[:m] <= WINDOW - Q)])
        for order, ks, pairs in _in_bands(pair[free], at[free] - self.within[entry[free]]):
            ps, run = at[free[order]], self.free[entry[free[order]]]
            to = np.arange(len(ks)) + self.need[run] - 1
            by = np.flatnonzero(to < len(ks))
            to = to[by]
            got.append(pairs[by[(ks[to] == ks[by]) & (run[to] == run[by]) & (ps[to] - ps[by] <= self.span[run[by]])]])
        return np.divmod(np.unique(np.concatenate(got)), parts)

    def _bands(self, sym: np.ndarray, begin: np.ndarray, at: np.ndarray, k: np.ndarray, begins: np.ndarray, looked: tuple[list[np.ndarray], list[np.ndarray], np.ndarray]) -> set[tuple[int, int]]:
        """``(text, part)`` confirmed among the parts that are looked at in each region, whose known q-grams ``k`` are at ``at``."""
        named, others, figures = looked
        some = np.array([len(x) + len(y) > 0 for x, y in zip(named, others)])
        inside = some[np.searchsorted(begins, at, "right") - 1]
        at, k, begins = at[inside], k[inside], begins[some]
        named, others = [x for x, y in zip(named, some) if y], [x for x, y in zip(others, some) if y]
        out: set[tuple[int, int]] = set()
        for r0, r1, a, b in self._chunks(at, k, begins):
            table = np.zeros((r1 - r0, len(self.items)), np.int8)
            for r in range(r0, r1):
                table[r - r0, others[r]] = 1
                table[r - r0, named[r]] = 2
            table = table.ravel()
            entry, pair, p = self._entries(at[a:b], k[a:b], begins[r0:r1])
            hit = np.flatnonzero(table[pair])
            hit = hit[np.bincount(pair[hit], minlength=len(table))[pair[hit]] >= NEED]
            p, pair, ipos, diagonal = p[hit], pair[hit], self.pos[entry[hit]], p[hit] - self.within[entry[hit]]
            p = p + begins[r0:r1][pair // len(self.items)]
            for order, ks, pairs in _in_bands(pair, diagonal):
                ps, ip = p[order], ipos[order]
                first = np.append(True, (ks[1:] != ks[:-1]) | (ps[1:] != ps[:-1]))[: len(ks)]
                ks, ps, ip, pairs = ks[first], ps[first], ip[first], pairs[first]
                # the NEED-th next shared q-gram has to end within WINDOW symbols
                n = max(0, len(ks) - NEED + 1)
                ok = np.flatnonzero((ks[NEED - 1 :] == ks[:n]) & (ps[NEED - 1 :] - ps[:n] <= WINDOW - Q))
                if not len(ok):
                    continue
                cut = np.flatnonzero((np.diff(ok) > 1) | (ks[ok[1:]] != ks[ok[:-1]])) + 1
                s, t = ok[np.append(0, cut)], ok[np.append(cut - 1, len(ok) - 1)] + NEED - 1
                which = pairs[s] % len(self.items)
                may = self._may_agree(which, table[pairs[s]] == 2, ps[s], ps[t], s, t, ip, figures)
                for x, y, w in zip(s[may].tolist(), t[may].tolist(), which[may].tolist()):
                    found = int(np.searchsorted(begin, ps[x], "right") - 1), w
                    if found not in out and self._verify(sym, begin, w, int(ps[x]), int(ps[y]) + Q, ip[x : y + 1], ps[x : y + 1]):
                        out.add(found)
        return out

    def _may_agree(self, which: np.ndarray, named: np.ndarray, left: np.ndarray, right: np.ndarray, s: np.ndarray, t: np.ndarray, ip: np.ndarray, figures: np.ndarray) -> np.ndarray:
        """Which runs ``s..t`` of the parts ``which`` _verify can confirm, as far as names, figures, words and the number of shared q-grams tell."""
        edge = np.column_stack([s, t + 1]).ravel()
        low = np.minimum.reduceat(np.append(ip, 0), edge)[::2]
        high = np.maximum.reduceat(np.append(ip, 0), edge)[::2] + Q
        i, j = self.back[low], np.minimum(self.on[high], self.begin[which + 1] - PAD)
        words, all_words = self.begun[j] - self.begun[i], self.begun[self.begin[which + 1] - PAD] - self.begun[self.begin[which]]
        a, n = np.searchsorted(self.figure_at, i), np.searchsorted(self.figure_at, j)
        n -= a
        own, at = np.repeat(np.arange(len(s)), n), np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)
        figure, beside = self.figure_of[at] << 32, BAND + REACH + WINDOW
        there = np.searchsorted(figures, figure + np.maximum(0, left - beside)[own]) < np.searchsorted(figures, figure + (right + Q + beside)[own], "right")
        agree = np.bincount(own[there], minlength=len(s)) * 3 >= 2 * n
        enough = (words >= RUN_WORDS) | np.where(n > 0, self._whole_sentence(self.begun[i], self.begun[j]), words == all_words)
        # an edit takes Q q-grams at most, while the band holds all diagonals of so few edits
        least = EXACT * (j - i)
        near = (high - low - Q + 1 - (t - s + 1) <= Q * least) | (least > BAND // 2)
        return named | (enough & np.where(n > 0, agree, near))

    def _same(self, sym: np.ndarray, begin: np.ndarray, at: np.ndarray, k: np.ndarray, left: int, right: int, known: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """``(text, part)`` confirmed in one region among all parts that run along it on one diagonal, whether or not their q-grams are rare.

        Parts are found by the least frequent q-gram of each STRIDE symbols, two of which a window with one edit keeps; ``at`` and ``k`` are these, between ``left`` and ``right``.
        """
        out: set[tuple[int, int]] = set()
        n = self.count[k]
        entry = np.arange(n.sum()) + np.repeat(self.first[k] - np.cumsum(n) + n, n)
        key = np.sort((self.part[entry].astype(np.int64) << 42) + np.repeat(at, n) - self.pos[entry] + (1 << 41))
        twice = key[1:][key[1:] == key[:-1]]
        if not len(twice):
            return out
        twice = twice[np.append(True, twice[1:] != twice[:-1])]
        parts, diagonals = twice >> 42, (twice & ((1 << 42) - 1)) - (1 << 41)
        lows, highs = np.maximum(self.begin[parts], left - diagonals), np.minimum(self.begin[parts + 1] - PAD, right - diagonals)
        long = highs - lows >= WINDOW
        for which, diagonal, i, full, ok in self._straight(sym, parts[long], diagonals[long], lows[long], highs[long]):
            low, high = int(self.begin[which]), int(self.begin[which + 1]) - PAD
            cut = np.flatnonzero(np.diff(ok) > 1) + 1
            for s, t in zip(ok[np.append(0, cut)], ok[np.append(cut - 1, len(ok) - 1)] + CLOSE - 1):
                a, b = i + int(full[s]), i + int(full[t]) + Q
                while a < b and a > low and self.sym[a - 1] != GAP:  # to whole words, all of them shared
                    a += 1
                while b > a and b < high and self.sym[b] != GAP:
                    b -= 1
                run = self.sym[a:b]
                if np.count_nonzero(run == GAP) < RUN_WORDS - 1 and b - a < high - low - BAND:
                    continue
                pair = int(np.searchsorted(begin, a + diagonal, "right") - 1), which
                place = full[(full + i >= a) & (full + i + Q <= b)] + i
                if len(place) and pair not in known and pair not in out and self._verify(sym, begin, which, a + diagonal, b + diagonal, place, place + diagonal):
                    out.add(pair)
        return out

    def _straight(self, sym: np.ndarray, parts: np.ndarray, diagonals: np.ndarray, lows: np.ndarray, highs: np.ndarray, size: int = 1 << 22):
        """Of each stretch ``lows..highs`` of an item part laid along its diagonal: ``(part, diagonal, low, full, ok)`` where a window has at most one edit.

        ``full`` are the places in the stretch at which shared q-grams begin, ``ok`` those of them with CLOSE in a window.  All stretches are compared at once,
        at most about ``size`` symbols at a time, with one unequal symbol after each.
        """
        sizes = highs - lows + 1
        ends = np.cumsum(sizes)
        cut = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, size)), len(ends)))
        for first, last in zip(cut[:-1], cut[1:]):
            n = sizes[first:last]
            begins = np.cumsum(n) - n
            item = np.arange(n.sum()) + np.repeat(lows[first:last] - begins, n)
            same = self.sym[item] == sym[item + np.repeat(diagonals[first:last], n)]
            same[begins + n - 1] = False
            same = np.append(0, np.cumsum(same))
            full = np.flatnonzero(same[Q:] - same[:-Q] == Q)
            if len(full) < CLOSE:
                continue
            of = np.searchsorted(begins, full, "right") - 1
            near = np.flatnonzero((full[CLOSE - 1 :] - full[: len(full) - CLOSE + 1] <= WINDOW - Q) & (of[CLOSE - 1 :] == of[: len(of) - CLOSE + 1]))
            owner = of[near]
            for k in np.unique(owner):
                a, b = np.searchsorted(of, [k, k + 1])
                x, y = np.searchsorted(owner, [k, k + 1])
                yield int(parts[first + k]), int(diagonals[first + k]), int(lows[first + k]), full[a:b] - begins[k], near[x:y] - a

    def _verify(self, sym: np.ndarray, begin: np.ndarray, which: int, a: int, b: int, ipos: np.ndarray, place: np.ndarray) -> bool:
        """Banded alignment of the document's symbols a..b with the item's part at the same diagonals, then the telling words."""
        doc = int(np.searchsorted(begin, a, "right") - 1)
        start, end = int(begin[doc]), int(begin[doc + 1]) - PAD
        low, high = int(self.begin[which]), int(self.begin[which + 1]) - PAD
        i, j = max(low, int(ipos.min())), min(high, int(ipos.max()) + Q)
        while i > low and self.sym[i - 1] != GAP:  # to whole words
            i -= 1
        while j < high and self.sym[j] != GAP:
            j += 1
        a, b = max(start, a - BAND), min(end, b + BAND)
        theirs = self.text(sym, *self.whole_words(sym, max(start, a - REACH), min(end, b + REACH)))
        around = self.text(sym, max(start, a - SENTENCE), min(end, b + SENTENCE))
        bag = Counter(theirs.split())
        first = len(self.text(self.sym, low, i).split())
        words, sentence = self.words[which], self.sentence[which]
        last = first + len(self.text(self.sym, i, j).split())
        own = words[first:last]
        figures = [w for w in own if w.isdigit()]
        counted = sum(bag[w] > 0 for w in figures)
        if counted * 2 < len(figures):
            return False
        # the names of the sentences that the run covers to a third or more
        inside = np.bincount(sentence[first:last], minlength=sentence[-1] + 1) * 3 >= np.bincount(sentence)
        named = 0
        for at in np.flatnonzero(inside[sentence]):
            if words[at] in self.names:
                if bag[words[at]] > 0 or any(_near(words[at], x) for x in bag):
                    named += 1
                elif _taken(around, words, sentence, at):
                    return False
        rate = RATE
        if not named:
            if counted * 3 < 2 * len(figures):
                return False
            rate = STRICT
            if figures and last - first < RUN_WORDS and not self._whole_sentence(int(self.begun[i]), int(self.begun[j])):
                return False
            if not figures:
                # nothing in the run tells it apart: the figures of its sentences, if they have any, have to stand beside it
                if any(words[at].isdigit() and not bag[words[at]] for at in np.flatnonzero(inside[sentence])):
                    return False
                if last - first < RUN_WORDS and last - first < len(words):
                    return False
                rate = EXACT
        diagonal = int(np.median(place - ipos))
        if start <= i + diagonal and j + diagonal <= end and np.count_nonzero(self.sym[i:j] != sym[i + diagonal : j + diagonal]) <= rate * (j - i):
            return True  # the straight path is good enough already
        shift = diagonal + i - a
        return banded_distance(self.sym[i:j], sym[a:b], shift, 2 * BAND) <= rate * (j - i)


def _words_by_sentence(text: str) -> list[int]:
    """How many folded words each sentence of a text has."""
    sentences = re.split(r"(?<=[.?!])\s+(?=[^\W\d_a-z]|[¿¡«“\"])", text)
    sym, begin = fold(sentences)
    counts = [len(Index.text(sym, begin[k], begin[k + 1] - PAD).split()) for k in range(len(sentences))]
    return [n for n in counts if n] or [0]


def _taken(theirs: str, words: list[str], sentence: np.ndarray, at: int) -> bool:
    """Whether another word stands in the place of the name ``words[at]``, between the words beside it (of the next one four letters are enough)."""
    left = [r"\w*\d\w*" if w.isdigit() else w for k, w in enumerate(words[max(0, at - 2) : at], max(0, at - 2)) if sentence[k] == sentence[at]]
    right = [w for k, w in enumerate(words[at + 1 : at + 2], at + 1) if sentence[k] == sentence[at]]
    if not left or not right:
        return False
    return bool(re.search(rf"\b{' '.join(left)} \w+ {right[0][:4]}" + r"\b" * (len(right[0]) <= 4), theirs))


def _near(w: str, x: str) -> bool:
    """At most one edit apart, for names of five letters and more; two for eight and more; the first or last three letters agree."""
    allowed = 2 if len(w) >= 8 else 1
    if abs(len(w) - len(x)) > allowed or len(w) < 5 or w[:3] != x[:3] and w[-3:] != x[-3:]:
        return False
    row = list(range(len(x) + 1))
    for i, c in enumerate(w, 1):
        prev, row[0] = row[0], i
        for j, d in enumerate(x, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (c != d))
    return row[-1] <= allowed


def banded_distance(item: np.ndarray, doc: np.ndarray, shift: int, band: int) -> int:
    """Fewest edits that turn ``item`` into some part of ``doc``, on paths within ``band`` diagonals of ``shift``."""
    n, m = len(item), len(doc)
    if not n or not m:
        return n
    width = 2 * band + 1
    offsets = np.arange(-band, band + 1) + shift  # a cell of row i stands for place i + offset of doc
    far = n + m
    padded = np.full(n + m + 2 * width + 2 * abs(shift) + 2, 255, np.uint8)
    origin = width + abs(shift)
    padded[origin : origin + m] = doc
    row = np.where((offsets >= 0) & (offsets <= m), 0, far)
    steps = np.arange(width)
    down = np.full(width, far)
    for i in range(1, n + 1):
        at = origin + i + shift - band - 1
        down[:-1] = row[1:]
        row = np.minimum(row + (padded[at : at + width] != item[i - 1]), down + 1) - steps
        row = np.minimum.accumulate(row) + steps  # symbols of doc that item lacks
        if i + offsets[0] < 0:
            row[: -(i + offsets[0])] = far
    return int(row[(n + offsets >= 0) & (n + offsets <= m)].min(initial=far))


def blocks(items: DataFrame, size: int = BLOCK) -> list[list[tuple[int, str]]]:
    """The parts of the items in blocks of at most ``size`` characters (and at least one part), read a block at a time; equal texts share one."""
    parts = items.filter("item_id is not null").select("item_id", F.explode(F.array("passage", "question")).alias("text")).filter(F.length("text") >= WINDOW)
    total = parts.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // size)
    out = []
    for k in range(n):
        rows = (parts if n == 1 else parts.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k)).orderBy("item_id", "text").collect()
        if rows:
            out.append([(r["item_id"], r["text"]) for r in rows])
    return out


def found(documents: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(doc_id, item_id)``: the document holds the item's passage, question, or a sentence or more of the passage."""
    texts = documents.filter("doc_id is not null and text is not null").filter(F.length("text") >= WINDOW).select("doc_id", "text")
    out = None
    held = blocks(items, block)
    told = telling(distinct([part for parts in held for part in parts]))
    for parts in held:
        hits = texts.mapInPandas(_scanner(parts, told), "doc_id bigint, item_id bigint")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return texts.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
    return out.distinct()


def _scanner(parts: list[tuple[int, str]], told: tuple[set[str], np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(parts, told)
        for pdf in batches:
            ids, texts, held, size = [], [], [], 0
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                held.append((i, t))
                size += len(t)
                if size >= SCAN:
                    yield _scan(index, held)
                    held, size = [], 0
            del ids, texts
            if held:
                yield _scan(index, held)

    return run


def _scan(index: Index, held: list[tuple[int, str]]) -> pd.DataFrame:
    pairs = index.scan([t for _, t in held])
    return pd.DataFrame({"doc_id": np.array([held[d][0] for d, _ in pairs], np.int64), "item_id": np.array([i for _, i in pairs], np.int64)})


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, documents)``: how many documents hold each leaked item."""
    return found(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
