"""Benchmark decontamination with an FM-index per shard of training documents.

A shard is a run of whole documents of one task. Its word sequence is indexed by a suffix array's Burrows-Wheeler
transform in a wavelet tree with sampled suffix positions. All test phrases are searched backwards at once, their
occurrences located, and overlapping occurrences merged into removal spans. Words that no phrase holds can't be part
of an occurrence, so a stretch of them is one separator in the indexed sequence; it changes no result.

Test phrases are taken in blocks of a bounded size; each block passes over all documents.

Defined results: null and empty texts have no words and no hits; null or wordless items have no windows; repeated
documents are reported each; items of the same words are all reported, rows with one item_id count as one item; only the named columns are read; an empty
table of documents gives an empty result, and one of items gives no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

WINDOW = 10
#: Words are runs of digits, letters and bytes over 127 after lower-casing A-Z; anything else becomes a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
WORD = re.compile(rb"[^ ]+")
#: Indexed words, documents and bytes of text of a shard; bytes of items in one block. They bound memory only.
SHARD_WORDS, SHARD_DOCS, SHARD_BYTES, BLOCK_BYTES = 1 << 20, 50_000, 16 << 20, 8 << 20
SAMPLE = 8  # every 8th position's suffix is kept


class Phrases:
    """The distinct windows of test items, as word numbers from 2 on, and the items of each window."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 2) for w in text.encode().translate(FOLD).split()]
            for at in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[at : at + window]), set()).add(item)
        self.windows = list(found)
        self.items = [sorted(x) for x in found.values()]
        self.known: set | None = None  # made where texts are cut
        self.shortest = min(map(len, self.windows), default=window)
        self.longest = max(map(len, self.windows), default=0)
        self.matrix = np.zeros((len(self.windows), self.longest), np.int32)
        for row, w in zip(self.matrix, self.windows, strict=True):
            row[len(row) - len(w) :] = w  # searched from the right

    def spans(self, text: bytes) -> list[tuple[int, int]]:
        """Merged spans of words inside occurrences of windows in one text."""
        if self.known is None:
            self.known, self.lengths = set(self.windows), {len(w) for w in self.windows}
        own = [self.numbers.get(w, 0) for w in text.translate(FOLD).split()]
        known = self.known
        return merged([(i, i + n) for n in self.lengths for i in range(len(own) - n + 1) if own[i] and tuple(own[i : i + n]) in known], ())


class Bits:
    """A bit vector with rank in constant time."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(np.r_[bits, np.zeros(-len(bits) % 64 + 64, bool)], bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words))].astype(np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FMIndex:
    """Counts and locates phrases in a sequence of small integers (0 is kept for the end)."""

    def __init__(self, sequence: np.ndarray, symbols: int, sample: int = SAMPLE):
        text = np.r_[sequence, 0].astype(np.int64)
        suffixes = suffix_array(text)
        last = text[suffixes - 1]  # the suffix at 0 is preceded by the end
        self.before = np.searchsorted(np.sort(text), np.arange(symbols + 1)).astype(np.int64)
        self.levels: list[tuple[int, Bits, int]] = []
        row = last
        for shift in range(max(1, int(symbols).bit_length()) - 1, -1, -1):
            bits = (row >> shift & 1).astype(bool)
            zeros = int(len(bits) - bits.sum())
            self.levels.append((shift, Bits(bits), zeros))
            row = np.r_[row[~bits], row[bits]]
        marked = suffixes % sample == 0
        self.marked, self.sampled, self.n = Bits(marked), suffixes[marked], len(text)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        start = np.zeros_like(at)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            a, b = bits.rank(start), bits.rank(at)
            start, at = np.where(one, zeros + a, start - a), np.where(one, zeros + b, at - b)
        return at - start

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for shift, bits, zeros in self.levels:
            one = bits.get(at)
            ones = bits.rank(at)
            out |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of all phrases, rows that are padded with zeros on the left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for column in phrases.T[::-1]:
            live = np.flatnonzero((column > 0) & (low < high))
            symbol = column[live].astype(np.int64)
            low[live] = self.before[symbol] + self.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row: back through the text to the next sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        who = np.arange(len(rows))
        while len(who):
            done = self.marked.get(rows)
            out[who[done]] = self.sampled[self.marked.rank(rows[done])] + steps
            who, rows, steps = who[~done], rows[~done], steps + 1
            symbol = self.symbol(rows)
            rows = self.before[symbol] + self.rank(symbol, rows)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By doubling; the last symbol must be the only 0."""
    n, width = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key)
        new = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


class Shard:
    """Documents gathered for one index."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.words: list[int] = []  # of each document
        self.runs: list[np.ndarray] = []  # per run: document, first word, place in the sequence
        self.parts: list[np.ndarray] = []
        self.size = 1
        self.bytes = 0

    def add(self, body: bytes, kept: int = 0) -> None:
        words = body.translate(FOLD).split()
        doc = len(self.words)
        self.words.append(len(words))
        self.bytes += kept
        if len(words) < self.phrases.shortest or not self.phrases.windows:
            return
        ids = np.fromiter(map(self.phrases.numbers.get, words, repeat(0)), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.r_[False, ids > 0, False]))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.phrases.shortest
        if not long.any():
            return
        starts, ends = starts[long], ends[long]
        lengths = ends - starts
        place = self.size + np.cumsum(lengths + 1) - (lengths + 1)
        part = np.ones(int((lengths + 1).sum()), np.int32)  # a separator after each run
        inner = np.repeat(starts - (place - self.size), lengths) + (at := np.arange(len(part))[self._inner(lengths)])
        part[at] = ids[inner]
        self.runs.append(np.stack([np.full(len(starts), doc), starts, place, lengths]))
        self.parts.append(part)
        self.size += len(part)

    @staticmethod
    def _inner(lengths: np.ndarray) -> np.ndarray:
        mask = np.ones(int((lengths + 1).sum()), bool)
        mask[np.cumsum(lengths + 1) - 1] = False
        return mask

    @property
    def full(self) -> bool:
        return self.size > SHARD_WORDS or len(self.words) >= SHARD_DOCS or self.bytes > SHARD_BYTES

    def hits(self) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """By document: merged spans of words, and the items found."""
        if not self.parts:
            return {}
        phrases = self.phrases
        sequence = np.concatenate([np.ones(1, np.int32), *self.parts])
        docs, firsts, places, _ = np.concatenate(self.runs, axis=1)
        index = FMIndex(sequence, len(phrases.numbers) + 2)
        low, high = index.search(phrases.matrix)
        counts = high - low
        which = np.repeat(np.arange(len(counts)), counts)
        if not len(which):
            return {}
        rows = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]
        at = index.locate(rows)
        run = np.searchsorted(places, at, "right") - 1
        lengths = (phrases.matrix > 0).sum(1)[which]
        start = firsts[run] + at - places[run]
        doc = docs[run]
        out: dict[int, tuple[list, set]] = {}
        for d, w in set(zip(doc.tolist(), which.tolist(), strict=True)):
            out.setdefault(d, ([], set()))[1].update(phrases.items[w])
        order = np.lexsort((start, doc))
        for d, s, e in zip(doc[order].tolist(), start[order].tolist(), (start + lengths)[order].tolist(), strict=True):
            spans = out[d][0]
            if spans and s <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
            else:
                spans.append((s, e))
        return out


FOUND = "id long, text string, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in lists of about block_bytes bytes of text, one at a time."""
    plain = items.select(
        items[id_col].cast("string").alias("item"), F.coalesce(items[text_col], F.lit("")).alias("text")
    ).filter("item is not null")
    total = plain.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = int(total // block_bytes) + 1
    for b in range(n):
        yield [(r.item, r.text) for r in plain.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).collect()]


def find(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    with_text: bool = True,
    carry: tuple[str, ...] = (),
    last: StructType | None = None,
    finish=None,
) -> DataFrame:
    """Per document: id, text (or null), n_words, merged spans of hit words, and the items found.

    `carry` names further columns of docs, which come last as one struct, `row`. `finish(handles)` makes a function that turns batches of
    these columns into ones of the schema `last`; it runs within the last pass, so that no second worker holds the texts.
    """
    more = [F.struct(*[docs[c] for c in carry]).alias("row")] if carry else []
    found = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *more)
    first, schema = True, carrying(FOUND, docs, carry)
    some = blocks(items, item_col, item_text_col, block_bytes)
    fields = common.arrow_schema(docs.sparkSession, schema)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(common.BATCH_BYTES))
    held, handles = next(some), []
    while held is not None:
        coming = next(some, None)
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases(held, window))
        handles.append(phrases)
        over = finish(handles) if finish and coming is None else None
        step = _pass(phrases, fields, with_text or coming is not None, first, over)
        found = found.mapInArrow(step, last if over else schema)
        first = False
        held = coming
    return found


def carrying(schema: str, docs: DataFrame, carry: tuple[str, ...]) -> StructType:
    """schema, and a struct `row` of the columns carried, whatever their names."""
    out = StructType.fromDDL(schema)
    return out.add("row", StructType([docs.schema[c] for c in carry])) if carry else out


def _pass(phrases, fields: pa.Schema, keep: bool, first: bool, finish=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, carried = Shard(phrases.value), [], []

        def flush() -> pa.RecordBatch:
            more = [pa.concat_arrays([b.column(i) for b in carried]) for i in range(len(fields) - 5)]
            hits = shard.hits()
            spans = [merged(old, hits.get(i, ((), ()))[0]) for i, (_, _, old, _) in enumerate(held)]
            items = [sorted(old | hits[i][1]) if i in hits else sorted(old) for i, (*_, old) in enumerate(held)]
            own = [
                [h[0] for h in held], pa.array([h[1] for h in held], pa.binary()).cast(pa.string()), shard.words,
                [[{"start": s, "end": e} for s, e in x] for x in spans], items,
            ]
            out = pa.RecordBatch.from_pydict(dict(zip(fields.names, own + more, strict=True)), schema=fields)
            return finish(out) if finish else out

        for batch in batches:
            ids, bodies = common.texts(batch)
            olds = [()] * len(ids) if first else batch.column(3).to_pylist()
            names = [()] * len(ids) if first else batch.column(4).to_pylist()
            more, start = batch.select(range(2 if first else 5, batch.num_columns)), 0
            for i, (doc, body, old, own) in enumerate(zip(ids, bodies, olds, names, strict=True)):
                shard.add(body, len(body) if keep else 0)
                held.append((doc, body if keep else None, [(x["start"], x["end"]) for x in old], set(own)))
                if shard.full:
                    carried.append(more.slice(start, i + 1 - start))
                    yield flush()
                    shard, held, carried, start = Shard(phrases.value), [], [], i + 1
            if start < len(ids):
                carried.append(more.slice(start))
        if held:
            yield flush()

    return run


def merged(a, b) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def report(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """One row per document: words, hit words, items with occurring windows and their digest."""
    found = find(docs, items, with_text=False, **columns)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def removed(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), **columns
) -> DataFrame:
    """id and text of the documents, hit words cut out of their texts; `contaminated` marks those that lost words.

    `carry` names further columns that go along, as one struct `row`.

    A cut leaves a line break. Where what stands around it is hit again, those words are cut too, until nothing is hit; no
    other words go.
    """
    schema = carrying("id long, text string, contaminated boolean", docs, carry)
    fields = common.arrow_schema(docs.sparkSession, schema)

    def cutter(handles: list):
        def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans = batch.column(3).to_pylist()
            out = []
            for text, own in zip(common.texts(batch)[1], spans, strict=True):
                at = [(x["start"], x["end"]) for x in own]
                while at:
                    text = without(text, at)
                    at = merged([s for h in handles for s in h.value.spans(text)], ())
                out.append(text)
            own = [batch.column(0), pa.array(out, pa.binary()).cast(pa.string()), [bool(s) for s in spans]]
            own += batch.columns[5:]
            return pa.RecordBatch.from_pydict(dict(zip(fields.names, own, strict=True)), schema=fields)

        return cut

    return find(docs, items, id_col, text_col, carry=carry, last=schema, finish=cutter, **columns)


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of spans and what stands between them."""
    if not spans:
        return text
    words = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : words[s][0]])
        at = words[e - 1][1]
    out.append(text[at:])
    return b"\n".join(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
