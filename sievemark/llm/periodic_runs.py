"""Periodic runs of words, by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words with smallest period q that neither neighbour extends. The steps, over integers in numpy:

1. Only stretches in which every five-word window occurs again in its text can hold a run of max(6, 4q) words or more
   (each window within one returns q words further or earlier); they are found by hashes, which can only add stretches.
2. `Index` has the suffix array, the names of all factors of 2**k words (equal factors, equal names), and the minima of
   common prefixes: together the suffix tree's answers. Stretches of different texts share no word in it.
3. `covering`: the Lempel-Ziv blocks, and for each block and period the square around its border, by longest common
   extensions to both sides: a square of every leftmost-covering family, O(n) in all.
4. `vocabulary`: from each square the walk along suffix links. Where it stays in one occurrence, a common extension gives
   all its rotations at once; where that ends, the tree is asked for a branch by which the next rotation occurs
   elsewhere. What is no power of a shorter word is kept, so every square that occurs is in the vocabulary.
5. `runs`: all occurrences of the vocabulary (the leaves below each square's place in the tree), sorted by period and
   place; neighbouring squares of one period are one run.

Defined results: a null or empty text has no words and no runs; words are runs of anything but the six ASCII white-space
characters; repeated rows get equal rows, a null id too; only the two named columns are read, so other columns can have
any name; an empty table gives an empty result. Texts are taken whole, one after the other in batches of bounded bytes;
no rows are shuffled. A text takes memory in proportion to its own length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from . import common

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
WINDOW = 5
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, n_dropped long"
)
#: From id and number of words to the place of the word that stands at each place, or None for the text as it is.
Reorder = Callable[[int | None, int], np.ndarray | None]


class Index:
    """Suffix array and factor names of an array whose last value occurs once."""

    def __init__(self, s: np.ndarray):
        n = self.n = len(s)
        order = np.argsort(s, kind="stable")
        slots = np.arange(n)
        key, act, width = s[order], order, 1
        self.sa = order.astype(np.int32)
        self.names: list[np.ndarray] = []
        name = np.empty(n, np.int32)
        while True:
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            head = np.maximum.accumulate(np.where(first, slots, 0))
            name[act] = head
            self.names.append(name)
            alone = first.copy()
            alone[:-1] &= first[1:]
            slots, act = slots[~alone], act[~alone]
            if not len(slots):
                break
            key = name[act].astype(np.int64) * (n + 1) + name[act + width]
            order = np.argsort(key, kind="stable")
            key, act = key[order], act[order]
            self.sa[slots] = act
            name, width = name.copy(), width * 2
        self.rank = self.names[-1]
        self.common = np.zeros(n, np.int32)  # of a slot and the one before it
        self.common[1:] = self.forward(self.sa[:-1], self.sa[1:])
        self.least = [self.common]
        while 2 << len(self.least) - 1 <= n:
            half, last = 1 << len(self.least) - 1, self.least[-1]
            self.least.append(np.minimum(last[: len(last) - half], last[half:]))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words from a and b on that are equal, for different places."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        start = a.copy()
        for k in range(len(self.names) - 1, -1, -1):
            step = (self.names[k][a] == self.names[k][b]).astype(np.int64) << k
            a += step
            b += step
        return a - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words up to a and b that are equal, for different places; none before the start."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        start = a.copy()
        for k in range(len(self.names) - 1, -1, -1):
            x, y = a - (1 << k) + 1, b - (1 << k) + 1
            held = (x >= 0) & (y >= 0)
            x[~held], y[~held] = 0, 0
            step = (held & (self.names[k][x] == self.names[k][y])).astype(np.int64) << k
            a -= step
            b -= step
        return start - a

    def leaves(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last slot of the suffixes that begin with the `length` words at `at`."""
        low = self.rank[at].astype(np.int64)
        high = low.copy()
        for k in range(len(self.least) - 1, -1, -1):
            row, w = self.least[k], 1 << k
            x = low - w + 1
            ok = (x >= 1) & (row[np.clip(x, 0, len(row) - 1)] >= length)
            low -= np.where(ok, w, 0)
            x = high + 1
            ok = (x < len(row)) & (row[np.clip(x, 0, len(row) - 1)] >= length)
            high += np.where(ok, w, 0)
        return low, high

    def branch(self, at: np.ndarray, length: np.ndarray, word: np.ndarray) -> np.ndarray:
        """A place of the `length` words at `at` followed by `word` (a name of one word), or -1."""
        low, high = self.leaves(at, length)
        end = high + 1
        letter = self.names[0]
        after = lambda slot: letter[np.minimum(self.sa[slot].astype(np.int64) + length, self.n - 1)]
        while (open_ := low < end).any():
            mid = np.where(open_, (low + end) // 2, 0)
            less = open_ & (after(mid) < word)
            low, end = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, end)
        found = np.minimum(low, self.n - 1)
        return np.where((low <= high) & (after(found) == word), self.sa[found], -1)

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks: each is the longest factor that begins earlier too, or one new word."""
        n, sa = self.n, self.sa.tolist()
        before, after, stack = [-1] * n, [-1] * n, []
        for slot, at in enumerate(sa):
            while stack and sa[stack[-1]] > at:
                after[stack.pop()] = slot
            if stack:
                before[slot] = stack[-1]
            stack.append(slot)
        size = np.zeros(n, np.int64)
        for near in (np.array(before), np.array(after)):
            held = np.flatnonzero(near >= 0)
            size[held] = np.maximum(size[held], self.forward(self.sa[held], self.sa[near[held]]))
        length = np.empty(n, np.int64)
        length[self.sa] = np.maximum(size, 1)
        steps, starts, at = length.tolist(), [], 0
        while at < n:
            starts.append(at)
            at += steps[at]
        return np.array(starts)


def counted(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of sizes its number, that many times, and 0, 1, ... within each."""
    who = np.repeat(np.arange(len(sizes)), sizes)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def covering(index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares around the borders of the Lempel-Ziv blocks; every family's leftmost is among them."""
    starts = index.blocks()
    ends = np.append(starts[1:], index.n)
    size = ends - starts
    found = []
    who, k = counted(np.where(ends < index.n, size, 0))  # from the next block back into this one
    found.append((ends[who] - k - 1, ends[who], k + 1))
    who, k = counted(np.minimum(size + np.append(size[1:], 0), index.n - 1 - starts))  # from this block's start on
    found.append((starts[who], starts[who] + k + 1, k + 1))
    at, period = [], []
    for low, high, p in found:
        ahead = index.forward(low, high)
        back = np.zeros(len(low), np.int64)
        inner = np.flatnonzero((low > 0) & (ahead > 0))
        back[inner] = np.minimum(index.backward(low[inner] - 1, high[inner] - 1), p[inner] - 1)
        square = (ahead > 0) & (ahead + back >= p)
        at.append((low - back)[square])
        period.append(p[square])
    return np.concatenate(at), np.concatenate(period)


def primitive(index: Index, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the word whose square stands at `at` is no power of a shorter one."""
    out, left = np.ones(len(at), bool), period.copy()
    factor = 2
    while (left > 1).any():
        if factor * factor > left.max():
            divides = left > 1  # what is left is prime
            prime = left.copy()
        else:
            divides, prime = left % factor == 0, np.full(len(left), factor)
        if len(held := np.flatnonzero(divides)):
            shorter = period[held] // prime[held]
            out[held] &= index.forward(at[held], at[held] + shorter) < 2 * period[held] - shorter
            while len(held):
                left[held] //= prime[held]
                held = held[left[held] % prime[held] == 0]
        factor += 1
    return out


def vocabulary(index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares of primitive words; each square that occurs anywhere is equal to one of them."""
    at, period = covering(index)
    walked: dict[tuple[int, int], int] = {}  # the first square known of each run of squares, by its period and end
    out = [], []
    while len(at):
        end = at + period + index.forward(at, at + period)
        order = np.lexsort((at, end, period))
        at, period, end = at[order], period[order], end[order]
        first = np.ones(len(at), bool)
        first[1:] = (end[1:] != end[:-1]) | (period[1:] != period[:-1])
        at, period, end = at[first], period[first], end[first]
        good = primitive(index, at, period)
        at, period, end = at[good], period[good], end[good]
        new, upto = [], []
        for i, (a, p, e) in enumerate(zip(at.tolist(), period.tolist(), end.tolist(), strict=True)):
            known = walked.get((p, e))
            if known is None or a < known:
                walked[p, e] = a
                new.append(i)
                upto.append(e - 2 * p + 1 if known is None else known)
        at, period, end, upto = at[new], period[new], end[new], np.array(upto, np.int64)
        who, step = counted(upto - at)
        out[0].append(at[who] + step)
        out[1].append(period[who])
        last = upto - 1
        fresh = last + 2 * period == end  # else the walk goes on where it has been
        last, period = last[fresh], period[fresh]
        at = index.branch(last + 1, 2 * period - 1, index.names[0][last])
        at, period = at[at >= 0].astype(np.int64), period[at >= 0]
    if not out[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out[0]), np.concatenate(out[1])


def runs(s: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> np.ndarray:
    """(start, length, period) rows of the runs of at least `least` values and `times` >= 2 periods; s ends in a value that occurs once."""
    if len(s) < 2:
        return np.zeros((0, 3), np.int64)
    index = Index(s)
    at, period = vocabulary(index)
    low, high = index.leaves(at, 2 * period)
    kinds = np.unique(np.stack([period, low, high], 1), axis=0) if len(at) else np.zeros((0, 3), np.int64)
    who, step = counted(kinds[:, 2] - kinds[:, 1] + 1)
    place, period = index.sa[kinds[who, 1] + step].astype(np.int64), kinds[who, 0]
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    first = np.ones(len(place), bool)
    first[1:] = (place[1:] != place[:-1] + 1) | (period[1:] != period[:-1])
    last = np.append(first[1:], True)[: len(first)]
    start, q = place[first], period[first]
    length = place[last] - start + 2 * q
    held = length >= np.maximum(least, times * q)
    return np.stack([start[held], length[held], q[held]], 1)


def stretches(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the stretches that can hold runs, over texts that lie between bounds; hashes are of single words."""
    n = len(hashes) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none, none
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    mixed = hashes.view(np.uint64)
    window = doc[:n].astype(np.uint64) * np.uint64(MIX[0])
    for k in range(WINDOW):
        window = (window ^ mixed[k : k + n]) * np.uint64(MIX[k])
        window ^= window >> np.uint64(29)
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    order = inside[np.argsort(window[inside])]
    equal = np.zeros(len(order) + 1, bool)
    equal[1:-1] = window[order[1:]] == window[order[:-1]]
    again = np.zeros(n + 2, np.int8)
    again[order[equal[1:] | equal[:-1]] + 1] = 1
    cut = np.zeros(n + 2, bool)  # a text's first window begins a stretch
    cut[bounds[(bounds > 0) & (bounds < n)] + 1] = True
    begin = np.flatnonzero((again[1:] == 1) & ((again[:-1] == 0) | cut[1:]))
    end = np.flatnonzero((again[:-1] == 1) & ((again[1:] == 0) | cut[1:])) + WINDOW - 1
    long = end - begin >= LEAST_WORDS
    return begin[long], end[long]


def found(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each text's words its runs (start, length, period), by start, then period."""
    bounds = np.cumsum([0, *map(len, texts)])
    hashes = np.fromiter((hash(w) for words in texts for w in words), np.int64, bounds[-1])
    begin, end = stretches(hashes, bounds)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(begin):
        return out
    doc = np.searchsorted(bounds, begin, "right") - 1
    values: list[int] = []
    starts, known, of = [], {}, -1
    for b, e, d in zip((begin - bounds[doc]).tolist(), (end - bounds[doc]).tolist(), doc.tolist(), strict=True):
        if d != of:
            known, of = {}, d  # words of different texts are different
            base = len(values)
        starts.append(len(values))
        values += [base + known.setdefault(w, len(known)) for w in texts[d][b:e]]
        values.append(-len(values) - 1)
    starts = np.array(starts)
    table = runs(np.array(values, np.int64))
    which = np.searchsorted(starts, table[:, 0], "right") - 1
    place = table[:, 0] - starts[which] + begin[which] - bounds[doc[which]]
    for d, *run in zip(doc[which].tolist(), place.tolist(), table[:, 1].tolist(), table[:, 2].tolist(), strict=True):
        out[d].append(tuple(run))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def strongest(table: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared exactly; the first of equal ones."""
    best = None
    for run in table:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], table: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that stand in a run after its first period."""
    if not table:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in table:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reorder: Reorder | None = None) -> DataFrame:
    """One row per row of df: its runs and the strongest of them, and digests of the runs and of the collapsed text."""

    names = StructType.fromDDL(SCHEMA).names

    def rows(ids: list, bodies: list[bytes]) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in names}
        texts = [b.split() for b in bodies]  # on the six ASCII white-space characters
        for i, (doc, words) in enumerate(zip(ids, texts, strict=True)):
            if reorder is not None and (places := reorder(doc, len(words))) is not None:
                texts[i] = [words[k] for k in places.tolist()]
        for doc, words, table in zip(ids, texts, found(texts), strict=True):
            best, left = strongest(table), collapsed(words, table)
            values = (
                doc, len(words), len(table), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
                hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in table).encode()).hexdigest(),
                hashlib.sha256(b" ".join(left)).hexdigest(),
                [dict(start=a, length=b, period=c) for a, b, c in table], len(words) - len(left),
            )
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)
        return out

    return common.map_texts(common.id_and_text(df, id_col, text_col), rows, SCHEMA)


def tails(doc: int | None, n: int) -> np.ndarray | None:
    """The query's own rule: of every tenth id, by crc32, the words from one on repeat in a period."""
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_runs(common.table(spark, sf_dir, "documents"), reorder=tails)
    return out.select("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_dropped")
