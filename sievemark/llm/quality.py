"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each whole text are computed in numpy; trees are grown on at most 2 * `PER_CLASS` labelled documents (the
bound of what comes to the driver: one row of statistics each), flattened into arrays, and traversed for a batch
of documents and all trees at once.

Defined results: a null text is empty, an empty text has zero statistics and a score like any other; rows without
usable labels are not learned from (without both classes the score is the share of class 1, 0.5 without any);
repeated rows get equal scores; only the id and text columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PER_CLASS = 8_000
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 80, 4, 64, 0.15, 8, 1.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

STATISTICS = (
    "log_bytes log_words word_mean word_spread upper digit punctuation symbol exclamation white other "
    "lines_per_word distinct_words top_word distinct_pairs line_mean distinct_lines stops short_words capitals "
    "all_caps with_symbol letters_only entropy"
).split()
CLASSES = np.zeros((256, 7))
for _b in range(256):
    _c = chr(_b)
    CLASSES[_b] = (
        65 <= _b <= 90, 48 <= _b <= 57, 33 <= _b < 127 and not _c.isalnum(), _c in "#$%&*@^~|<>{}[]\\=+_", _c in "!?",
        _c in " \t\n\r\x0b\x0c", _b > 127,
    )
SYMBOLS = bytes(set(range(33, 127)) - set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:'\"-()"))


def statistics(body: bytes) -> list[float]:
    """The STATISTICS of one UTF-8 text."""
    words = body.split()
    if not words:
        return [0.0] * len(STATISTICS)
    bytes_of = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    share = bytes_of / len(body)
    upper, digit, punctuation, symbol, exclamation, white, other = share @ CLASSES
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = body.split(b"\n")
    some = share[share > 0]
    distinct = list(counts)
    own = np.fromiter(counts.values(), np.int64, len(distinct))
    upper_words = sum(c for w, c in counts.items() if w.isupper())
    capital = sum(c for w, c in counts.items() if w[:1].isupper())
    marked = sum(c for w, c in counts.items() if w.translate(None, SYMBOLS) != w)
    letters = sum(c for w, c in counts.items() if w.isalpha())
    ends = sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines)
    return [
        np.log1p(len(body)), np.log1p(n), lengths.mean(), lengths.std(), upper, digit, punctuation, symbol,
        exclamation, white, other, len(lines) / n, len(distinct) / n, own.max() / n,
        len(set(zip(words, words[1:], strict=False))) / n, len(body) / len(lines), len(set(lines)) / len(lines),
        ends / len(lines), (lengths <= 3).mean(), capital / n, upper_words / n, marked / n, letters / n,
        -(some * np.log2(some)).sum(),
    ]


class Trees:
    """Boosted trees in flat arrays: all trees of all rows go down a level at a time."""

    def __init__(self, base: float, feature, threshold, left, value, roots, depth: int):
        self.base, self.depth = base, depth
        self.feature, self.threshold = np.array(feature, np.int32), np.array(threshold, np.float64)
        self.left, self.value = np.array(left, np.int32), np.array(value, np.float64)
        self.roots = np.array(roots, np.int32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.base)
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            # A leaf leads to itself; the right child follows the left one.
            inner = self.left[node] >= 0
            right = x[rows, np.maximum(self.feature[node], 0)] > self.threshold[node]
            node = np.where(inner, self.left[node] + right, node)
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(1))))


def grown(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Trees for the logistic loss, from histograms of gradients over quantile bins."""
    if not len(y) or y.min() == y.max():
        return Trees(float(y.mean()) if len(y) else 0.5, [], [], [], [], [], 0)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], 1)
    n, width = x.shape
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, base)
    feature, threshold, left, value, roots = [], [], [], [], []
    slots = binned + np.arange(width) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(len(left))
        for array, x0 in ((feature, -1), (threshold, 0.0), (left, -1), (value, 0.0)):
            array.append(x0)
        where = np.full(n, roots[-1])
        level = [roots[-1]]
        for d in range(depth + 1):
            number = np.full(len(left), -1)
            number[level] = np.arange(len(level))
            local = number[where]
            live = local >= 0
            key = (local[live, None] * width * bins + slots[live]).ravel()
            size = len(level) * width * bins
            hist = [np.bincount(key, np.repeat(v[live], width), size).reshape(len(level), width, bins) for v in (g, h)]
            count = np.bincount(key, minlength=size).reshape(len(level), width, bins)
            gl, hl, cl = (np.cumsum(v, 2) for v in (*hist, count))
            gt, ht, ct = (v[:, :1, -1:] for v in (gl, hl, cl))
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(cl < LEAST) | (ct - cl < LEAST)] = -1
            for f in range(width):
                gain[:, f, len(cuts[f]) :] = -1
            following = []
            for i, node in enumerate(level):
                best = int(gain[i].argmax())
                f, b = divmod(best, bins)
                if d == depth or gain[i, f, b] <= 1e-6:
                    value[node] = -RATE * float(gt[i, 0, 0] / (ht[i, 0, 0] + RIDGE))
                    margin[where == node] += value[node]
                    continue
                feature[node], threshold[node], left[node] = f, float(cuts[f][b]), len(left)
                mine = where == node
                where[mine] = left[node] + (binned[mine, f] > b)
                following += [left[node], left[node] + 1]
                for _ in range(2):
                    for array, x0 in ((feature, -1), (threshold, 0.0), (left, -1), (value, 0.0)):
                        array.append(x0)
            level = following
            if not level:
                break
    return Trees(base, feature, threshold, left, value, roots, depth)


def trained(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Trees:
    """Trees from the labelled documents outside the held-out fold."""
    rows = common.training_rows(docs, labels, "quality", common.fold_of(F.col("doc_id"), FOLDS) != HELD_OUT, per_class)
    schema = "id long, y int, x array<double>"
    fields = common.arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = common.texts(batch)
            yield pa.RecordBatch.from_pydict({"id": ids, "y": batch.column(2), "x": [statistics(b) for b in bodies]}, schema=fields)

    found = sorted(rows.mapInArrow(run, schema).collect())
    x = np.array([r.x for r in found]).reshape(-1, len(STATISTICS))
    return grown(x, np.array([r.y for r in found], np.float64))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score_documents(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id and score."""
    held = df.sparkSession.sparkContext.broadcast(trees)

    def rows(ids: list, bodies: list[bytes]) -> dict[str, list]:
        x = np.array([statistics(b) for b in bodies])
        return {"id": ids, "score": held.value.scores(x).tolist()}

    return common.map_texts(common.id_and_text(df, id_col, text_col), rows, "id long, score double")


def keep_good(
    df: DataFrame, trees: Trees, text_col: str = "text", least: float = THRESHOLD
) -> DataFrame:
    """The rows of df, all columns, whose text has a score of at least `least`."""
    held = df.sparkSession.sparkContext.broadcast(trees)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(common.BATCH_BYTES))
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bodies = batch.column(at).cast(pa.large_binary()).to_pylist()
                scores = held.value.scores(np.array([statistics(b or b"") for b in bodies]))
                yield batch.filter(pa.array(scores >= least))

    return df.mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score_documents(docs, trained(docs, common.table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("id").alias("doc_id"),
        (common.fold_of(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
