"""Toxicity: a convolutional text classifier in numpy with hashed word embeddings and thresholds by language.

A word's vector is the sum of the vectors of its hash and of the hashes of its prefixes (of inflected forms the stem
counts). Filters of several widths run over the whole text; each keeps its largest response, and a logistic
layer weighs them. It is trained here, on at most `PER_CLASS` labelled documents of each class and of at most
`LEARN_CHARS` characters (the bounds of what comes to the driver). Hashes seen in fewer than `LEAST` training documents have
no vector. Since there are finitely many words in a
batch, a filter's response is a sum of one looked-up value per word and position, without per-position products.

The score never sees the language. For each language of the training sample a threshold is calibrated that makes F1
largest on rows that the network wasn't fitted on; `flagged` compares with it, and with `THRESHOLD` for other languages.

Defined results: a null text is empty; an empty text has a score (of padding); null languages use the common
threshold; without both classes every score is the share of class 1 (0 without labels); a score depends on the text
alone, to the last bit, so repeated rows get equal scores; only the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Training documents at most: not toxic, toxic.
PER_CLASS = (5_000, 2_500)
LEARN_CHARS = 20_000
#: One in so many of them is kept for the thresholds.
CALIBRATE = 5
SIZE, WIDTHS, FILTERS, PREFIXES = 8, (1, 2, 3), 8, (3, 4, 5)
BUCKETS, LEAST, SHRINK, BATCH, RATE = 1 << 18, 5, 15, 64, 0.015
#: Steps of training at least, passes at least, and the share of word vectors left out of a step.
STEPS, EPOCHS, DROPPED = 300, 6, 0.4
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: Places that a filter reads beyond its own; so many places after a text count for it, and as many more are only read.
PAD = max(WIDTHS) - 1
#: A-Z become lower case; what isn't a letter, a digit or a byte over 127 separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def buckets(word: bytes) -> list[int]:
    """Hash buckets of a word: the whole, then its prefixes (0 where it has no such prefix)."""
    text = word.decode("utf-8", "replace").lower()
    parts = [f"={text}"] + [text[:n] if len(text) > n else "" for n in PREFIXES]
    return [1 + xxhash.xxh3_64_intdigest(p) % (BUCKETS - 1) if p else 0 for p in parts]


def numbered(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of each distinct word; words of all texts with padding after each as numbers, 0 is padding; where the
    places of each text begin and end, alternating)."""
    split = [b.translate(FOLD).split() for b in bodies]
    distinct = list({w for words in split for w in words})
    number = dict(zip(distinct, range(1, len(distinct) + 1), strict=True))
    lengths = np.array([len(w) + 2 * PAD for w in split], np.int64)
    starts = np.cumsum(lengths) - lengths
    flat = np.zeros(int(lengths.sum()) + PAD, np.int64)
    for s, words in zip(starts.tolist(), split, strict=True):
        flat[s : s + len(words)] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    table = np.zeros((len(distinct) + 1, 1 + len(PREFIXES)), np.int64)
    if distinct:
        table[1:] = [buckets(w) for w in distinct]
    return table, flat, np.stack([starts, starts + lengths - PAD], 1).ravel()


def product(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """rows @ weights, added up in the same order for every row, however many there are."""
    out = rows[:, :1] * weights[0]
    for i in range(1, len(weights)):
        out += rows[:, i : i + 1] * weights[i]
    return out


class Network:
    def __init__(self, base: float = 0.0):
        self.rows = np.zeros(BUCKETS, np.int32)  # of a bucket in vectors; row 0 is zero and stays so
        self.base = base
        self.vectors = np.zeros((1, SIZE), np.float32)
        self.filters: list[np.ndarray] = []  # (width, SIZE, FILTERS) each
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.dense = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.offset = np.float32(0)
        self.thresholds: dict[str, float] = {}

    def responses(self, words: np.ndarray, flat: np.ndarray) -> list[np.ndarray]:
        """Of each width, the filters' responses at every position."""
        n, out = len(flat) - PAD, []
        for w, kernel, bias in zip(WIDTHS, self.filters, self.bias, strict=True):
            total = product(words, kernel[0])[flat[:n]] + bias
            for j in range(1, w):
                total += product(words, kernel[j])[flat[j : n + j]]
            out.append(total)
        return out

    def scores(self, bodies: list[bytes]) -> np.ndarray:
        if not self.filters:
            return np.full(len(bodies), self.base)
        table, flat, places = numbered(bodies)
        vectors = self.vectors[self.rows[table]]
        words = vectors[:, 0].copy()
        for i in range(1, vectors.shape[1]):
            words += vectors[:, i]
        pooled = [np.maximum.reduceat(np.maximum(r, 0), places)[::2] for r in self.responses(words, flat)]
        z = product(np.concatenate(pooled, 1), self.dense[:, None])[:, 0] + self.offset
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def sequence_scores(self, documents: list[np.ndarray]) -> np.ndarray:
        """Scores of documents that are given as buckets."""
        out = []
        for doc in documents:
            words = np.concatenate([np.zeros((1, SIZE), np.float32), self.vectors[self.rows[doc]].sum(1)])
            flat = np.r_[np.arange(1, len(words)), np.zeros(2 * PAD, np.int64)]
            h = np.concatenate([np.maximum(r.max(0), 0) for r in self.responses(words, flat)])
            out.append(1 / (1 + np.exp(-np.clip(float(h @ self.dense + self.offset), -30, 30))))
        return np.array(out)

    def fit(self, documents: list[np.ndarray], y: np.ndarray, seed: int = 1) -> None:
        """documents: of each, the buckets of its words in order (words, 1 + prefixes)."""
        rng = np.random.default_rng(seed)
        seen = np.zeros((2, BUCKETS), np.int64)
        for doc, label in zip(documents, y.astype(int), strict=True):
            seen[label, np.unique(doc)] += 1
        seen[:, 0] = 0
        kept = np.flatnonzero(seen.sum(0) >= LEAST)
        self.rows[kept] = np.arange(1, len(kept) + 1)
        neg, pos = seen[:, kept]
        n0, n1 = (y == 0).sum(), (y == 1).sum()
        # The first component starts as the shrunken log-odds of the class.
        odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
        self.vectors = np.zeros((len(kept) + 1, SIZE), np.float32)
        self.vectors[1:] = rng.normal(0, 0.02, (len(kept), SIZE))
        self.vectors[1:, 0] = odds * (pos + neg) / (pos + neg + SHRINK) / 2
        self.filters = [rng.normal(0, 0.1, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        for kernel in self.filters:
            kernel[0, 0, :2] += 1
        self.dense = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.dense.reshape(len(WIDTHS), FILTERS)[:, :2] += 0.5
        self.bias[:] = 0
        self.bias[:, :2] = -0.5
        self.offset = np.float32(np.log(n1 / n0) - 1)
        steps = 0
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in self.parameters()]
        for _ in range(max(EPOCHS, STEPS * BATCH // len(documents))):
            order = rng.permutation(len(documents))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                steps += 1
                left_out = rng.random(len(kept) + 1) < DROPPED
                grads = self.gradients([documents[i] for i in some], y[some].astype(np.float32), left_out)
                for p, g, (m, v) in zip(self.parameters(), grads, state, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-6)
                self.vectors[0] = 0
                self.offset = self._offset[0]

    def parameters(self) -> list[np.ndarray]:
        self._offset = np.array([self.offset], np.float32) if not hasattr(self, "_offset") else self._offset
        return [self.vectors, *self.filters, self.bias, self.dense, self._offset]

    def gradients(self, documents: list[np.ndarray], y: np.ndarray, left_out: np.ndarray | None = None) -> list[np.ndarray]:
        """Of the mean logistic loss plus a small weight decay; a filter passes back to its largest response only."""
        lengths = np.array([len(d) + 2 * PAD for d in documents])
        starts = np.cumsum(lengths) - lengths
        places = np.stack([starts, starts + lengths - PAD], 1).ravel()
        inside = np.ones(int(lengths.sum()), bool)
        inside[(starts + lengths)[:, None] - 1 - np.arange(PAD)] = False
        body = np.zeros((int(lengths.sum()) + PAD, 1 + len(PREFIXES)), np.int64)
        for s, d in zip(starts, documents, strict=True):
            body[s : s + len(d)] = d
        rows = self.rows[body]
        if left_out is not None:
            rows[left_out[rows]] = 0
        x = self.vectors[rows].sum(1)
        n = len(x) - PAD
        pooled, best = [], []
        for w, kernel, bias in zip(WIDTHS, self.filters, self.bias, strict=True):
            r = sum(x[j : n + j] @ kernel[j] for j in range(w)) + bias
            top = np.maximum.reduceat(r, places)[::2]
            whose = np.repeat(np.arange(len(documents)), lengths)
            at = np.empty(top.shape, np.int64)
            for f in range(FILTERS):
                hit = np.flatnonzero((r[:, f] == top[whose, f]) & inside)
                at[whose[hit[::-1]], f] = hit[::-1]  # the first one stays
            pooled.append(top)
            best.append(at)
        h = np.maximum(np.concatenate(pooled, 1), 0)
        z = h @ self.dense + self._offset[0]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g_dense, g_offset = h.T @ d + 1e-4 * self.dense, np.array([d.sum()], np.float32)
        g_h = (d[:, None] * self.dense) * (h > 0)
        g_vectors, g_filters, g_bias = np.zeros_like(self.vectors), [], np.zeros_like(self.bias)
        for i, (w, kernel) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = g_h[:, i * FILTERS : (i + 1) * FILTERS]
            g_bias[i] = g.sum(0)
            g_kernel = 1e-4 * kernel
            for j in range(w):
                inputs = x[best[i] + j]  # (documents, FILTERS, SIZE)
                g_kernel[j] += np.einsum("dfs,df->sf", inputs, g)
                back = np.einsum("df,sf->dfs", g, kernel[j]).reshape(-1, SIZE)
                where = rows[(best[i] + j).ravel()]
                for c in range(where.shape[1]):
                    np.add.at(g_vectors, where[:, c], back)
            g_filters.append(g_kernel)
        g_vectors[0] = 0
        return [g_vectors, *g_filters, g_bias, g_dense, g_offset]

    def calibrate(self, scores: np.ndarray, y: np.ndarray, langs: list) -> None:
        """The threshold of best F1 for every language with both classes."""
        groups: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            if lang is not None:
                groups.setdefault(lang, []).append(i)
        for lang, at in groups.items():
            s, t = scores[at], y[at]
            if 0 < t.sum() < len(t):
                order = np.argsort(-s, kind="stable")
                hits = np.cumsum(t[order])
                f1 = 2 * hits / (np.arange(1, len(t) + 1) + t.sum())
                k = int(f1.argmax())
                after = s[order][k + 1] if k + 1 < len(s) else 0.0
                self.thresholds[lang] = float((s[order][k] + after) / 2)


def trained(docs: DataFrame, labels: DataFrame, lang_col: str | None = "lang", per_class: tuple[int, int] = PER_CLASS) -> Network:
    learn = common.fold_of(F.col("doc_id"), FOLDS) != HELD_OUT
    rows = common.training_rows(docs, labels, "toxic", learn, per_class, lang_col, LEARN_CHARS)
    schema = "id long, y int, words binary, lang string"
    fields = common.arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = common.texts(batch)
            out = []
            for body in bodies:
                table, flat, _ = numbered([body])
                out.append(table[flat[flat > 0]].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_pydict({"id": ids, "y": batch.column(2), "words": out, "lang": batch.column(3)}, schema=fields)

    found = sorted(rows.mapInArrow(run, schema).collect(), key=lambda r: (r.id, r.words))
    y = np.array([r.y for r in found], np.float64)
    network = Network(float(y.mean()) if len(y) else 0.0)
    if not len(y) or y.min() == y.max():
        return network
    shape = (-1, 1 + len(PREFIXES))
    documents = [np.frombuffer(r.words, np.int32).reshape(shape) for r in found]
    apart = np.array([r.id % CALIBRATE == 0 for r in found]) if lang_col else np.zeros(len(y), bool)
    if len(set(y[~apart])) < 2:
        apart[:] = False
    network.fit([d for d, x in zip(documents, apart, strict=True) if not x], y[~apart])
    if apart.any():
        held = [d for d, x in zip(documents, apart, strict=True) if x]
        network.calibrate(network.sequence_scores(held), y[apart], [r.lang for r, x in zip(found, apart, strict=True) if x])
    return network


def score_documents(
    df: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang"
) -> DataFrame:
    """One row per row of df: id, score, and flagged by the threshold of its language."""
    held = df.sparkSession.sparkContext.broadcast(network)
    lang = df[lang_col].cast("string") if lang_col else F.lit(None).cast("string")
    source = df.select(df[id_col].cast("long").alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"), lang.alias("lang"))
    schema = "id long, score double, flagged boolean"
    fields = common.arrow_schema(df.sparkSession, schema)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(common.BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = common.texts(batch)
            if ids:
                scores = held.value.scores(bodies)
                limits = [held.value.thresholds.get(x, THRESHOLD) for x in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_pydict({"id": ids, "score": scores, "flagged": scores >= np.array(limits)}, schema=fields)

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score_documents(docs, trained(docs, common.table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("id").alias("doc_id"),
        (common.fold_of(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "flagged",
    )
