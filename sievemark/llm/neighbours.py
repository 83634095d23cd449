"""Approximate nearest neighbours by additive quantisation.

Codebooks of full dimension are learned on residuals and refitted together; a beam search encodes every vector's
direction as one word of each codebook. A query's inner products with all words make its lookup table; a candidate's
approximate score is a sum of looked-up values times its stored norm (over that of its decoded direction, so the length
is right). The best `RERANK` of every block of candidates are scored exactly, in double precision on the original vectors,
and the best of all blocks win.

The index is learned on at most `SAMPLE` vectors (lowest hashed ids) and holds every usable vector. Queries are taken
in blocks of a bounded number against all rows. Candidates are blocks of a bounded number in tasks.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; vectors of different
lengths have no inner product, so each length is searched by itself; rows of one id are never each other's neighbours, and one
of them asks; ties go to the smaller id; without candidates there are no rows; only the named columns are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BOOKS, WORDS, BEAM, ROUNDS, SAMPLE = 16, 256, 4, 1, 8_000
RERANK, NEIGHBOURS, EVERY = 400, 20, 20
BLOCK, QUERIES, CHUNK = 16_384, 8_192, 32  # candidates of a block, queries of a block, queries scored together


class Codebooks:
    def __init__(self, x: np.ndarray, seed: int = 0):
        """x: float32 sample (n, d)."""
        rng = np.random.default_rng(seed)
        words = max(1, min(WORDS, len(x)))
        residual, books = x.copy(), []
        for _ in range(BOOKS):
            centres = residual[rng.permutation(len(x))[:words]].copy()
            for _ in range(8):
                near = (residual @ centres.T - (centres**2).sum(1) / 2).argmax(1)
                total = np.zeros_like(centres)
                np.add.at(total, near, residual)
                count = np.bincount(near, minlength=words)
                centres[count > 0] = total[count > 0] / count[count > 0, None]
            near = (residual @ centres.T - (centres**2).sum(1) / 2).argmax(1)
            residual = residual - centres[near]
            books.append(centres)
        self.books = np.stack(books).astype(np.float32)
        for _ in range(ROUNDS):
            self.refit(x, self.encode(x))

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """All words together by ridge least squares, near what they are."""
        m, k, d = self.books.shape
        flat = codes + np.arange(m) * k
        gram = np.zeros((m * k, m * k), np.float32)
        for a in range(m):
            for b in range(m):
                np.add.at(gram, (flat[:, a], flat[:, b]), 1)
        right = np.zeros((m * k, d), np.float32)
        for a in range(m):
            np.add.at(right, flat[:, a], x)
        gram[np.diag_indices(m * k)] += 1
        self.books = np.linalg.solve(gram, right + self.books.reshape(m * k, d)).reshape(m, k, d).astype(np.float32)

    def encode(self, x: np.ndarray, beam: int = BEAM, rows: int = 512) -> np.ndarray:
        """Codes (n, BOOKS): at each codebook the `beam` best partial sums go on."""
        out = []
        half = (self.books**2).sum(2) / 2
        for at in range(0, len(x), rows):
            part = x[at : at + rows]
            n, d = part.shape
            residual, codes = part[:, None, :], np.zeros((n, 1, 0), np.int64)
            for book, norms in zip(self.books, half, strict=True):
                error = ((residual**2).sum(2) / 2)[:, :, None] - residual @ book.T + norms
                flat = error.reshape(n, -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                row, word = best // len(book), best % len(book)
                take = np.arange(n)[:, None]
                residual = residual[take, row] - book[word]
                codes = np.concatenate([codes[take, row], word[:, :, None]], 2)
            last = (residual**2).sum(2).argmin(1)
            out.append(codes[np.arange(n), last])
        return np.concatenate(out) if out else np.zeros((0, len(self.books)), np.int64)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.books))


def best_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; of equal ones the first."""
    if len(scores) <= k:
        return np.arange(len(scores))
    limit = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > limit)
    return np.r_[above, np.flatnonzero(scores == limit)[: k - len(above)]]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vector = df[vector_col]
    if df.schema[vector_col].dataType.simpleString() != "array<float>":
        vector = vector.cast("array<double>")
    some = df.select(df[id_col].cast("long").alias("vec_id"), vector.alias("v")).filter("vec_id is not null")
    finite = "size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return some.filter(f"v is not null and {finite} and exists(v, x -> x != 0)")


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (float32) and norms (double), whatever the size of the components."""
    x = x.astype(np.float64)
    most = np.abs(x).max(1, keepdims=True)
    x = x / most
    norms = np.sqrt((x**2).sum(1, keepdims=True))
    return (x / norms).astype(np.float32), (most * norms)[:, 0]


def search(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = NEIGHBOURS,
    rerank: int = RERANK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by `every`."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(common.BATCH_BYTES))
    rows = usable(df, id_col, vector_col)
    asking = F.pmod("vec_id", F.lit(every)) == 0
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.count_if(asking).alias("asked")).collect()
    found = [_search(rows.filter(F.size("v") == r.size), r.size, r.n, r.asked, asking, k, rerank) for r in sizes if r.asked]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = functools.reduce(DataFrame.union, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, size: int, total: int, n_asked: int, asking, k: int, rerank: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest found in each block, among vectors of one length."""
    spark = rows.sparkSession
    schema = "query_id long, vec_id long, score double"
    fields = common.arrow_schema(spark, schema)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    books = spark.sparkContext.broadcast(Codebooks(directions(matrix(sample["v"].combine_chunks(), size))[0]))
    asked = rows.filter(asking)
    index_schema = f"vec_id long, v {rows.schema['v'].dataType.simpleString()}, codes binary, norm double"
    index_fields = common.arrow_schema(spark, index_schema)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, norms = directions(matrix(batch.column(1), size))
                codes = books.value.encode(x)
                back = books.value.decode(codes)
                norms = norms / np.maximum(np.linalg.norm(back, axis=1), 1e-20)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes.astype(np.uint8)]), pa.array(norms)], schema=index_fields)

    index = rows.mapInArrow(encoded, index_schema).repartition(int(total // BLOCK) + 1, F.xxhash64("vec_id"))
    index = common.written(index, "index")
    blocks, found = int(n_asked // QUERIES) + 1, None
    for b in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        some = some.groupBy("vec_id").agg(F.min("v").alias("v")).toArrow()
        if not some.num_rows:
            continue
        queries = matrix(some["v"].combine_chunks(), size)
        held = spark.sparkContext.broadcast((some["vec_id"].to_numpy(), queries))
        part = index.mapInArrow(_block_search(held, books, size, k, rerank, fields), schema)
        found = part if found is None else found.union(part)
    return found


def _block_search(held, books, size: int, k: int, rerank: int, fields: pa.Schema):
    def block(ids, x, codes, norms) -> Iterator[pa.RecordBatch]:
        order = np.argsort(ids, kind="stable")
        ids, x, codes, norms = ids[order], x[order].astype(np.float64), codes[order], norms[order]
        words = books.value.books
        asked, queries = held.value
        units = directions(queries)[0]
        for at in range(0, len(asked), CHUNK):
            own, q = asked[at : at + CHUNK], units[at : at + CHUNK]
            scores = np.zeros((len(q), len(ids)), np.float32)
            for m, book in enumerate(words):
                scores += (q @ book.T)[:, codes[:, m]]
            scores = scores * norms
            out_q, out_v, out_s = [], [], []
            for query, vector, row in zip(own.tolist(), queries[at : at + CHUNK].astype(np.float64), scores, strict=True):
                row[np.searchsorted(ids, query) : np.searchsorted(ids, query, "right")] = -np.inf
                near = best_rows(row, rerank)
                near = near[ids[near] != query]
                exact = (x[near] * vector).sum(1)
                near = near[(best := np.lexsort((ids[near], -exact))[:k])]
                out_q.append(np.full(len(near), query))
                out_v.append(ids[near])
                out_s.append(exact[best])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (out_q, out_v, out_s)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            if batch.num_rows:
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                parts.append((batch.column(0).to_numpy(), matrix(batch.column(1), size), codes, batch.column(3).to_numpy()))
                n += batch.num_rows
            if n > 2 * BLOCK:
                yield from block(*(np.concatenate(c) for c in zip(*parts, strict=True)))
                parts, n = [], 0
        if parts:
            yield from block(*(np.concatenate(c) for c in zip(*parts, strict=True)))

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"))
