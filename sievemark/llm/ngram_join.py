"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

A document's set is its distinct shingles. Documents of equal sets form a class, and one representative stands for all.
Every set has a prefix under one global order (rare shingles first) such that two sets that link share a shingle of
their prefixes. A tile is the representatives that share a prefix shingle and a size band. Everything in a tile is compared
with one leader of the tile and of the neighbouring bands, and again with further leaders while many pairs of different
components would be left. The rest, representatives outside the main component of their shingle, are compared with those of
neighbouring bands that share the shingle early enough in both prefixes; a pair comes out at about the first shingle that
it shares only. A compared pair is first bounded from above by bit counts of its signatures; the pairs left are
decided by exact intersection. No link between different components is lost, and a large group of near copies costs a
few stars, not all pairs.

The order rests on counts over all documents: each task sends sorted blocks of shingle keys and counts by ranges of
keys, and each range is added up by itself. Counts decide what is compared first and never what links.

Defined results: null, empty and wordless texts have an empty set, link with nothing and are their own
component; repeated rows get equal results, and ids are expected to tell documents apart (of an id with different texts
the one of least digest links, and all its rows get its component); a null id has no component of its own; only the
id and text columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS, PERCENT = 5, 80
#: Shingles of so many documents are ordered by count, others before them by hash; any choice gives the same links.
HOT_LEAST = 6
#: Up to so many of them (8 bytes each) are broadcast; beyond that they reach their documents by a join.
HOT_BROADCAST = 1 << 23
COUNT_SHINGLES = 1 << 21  # counted at once in a task
KEY_BITS = 48  # of a shingle's hash, to count it by
REPEAT_BITS = 27  # log2 of the bits that tell which shingles only one document has; when full, all pass
FILTER_BITS = 23  # log2 of the bits that pre-select documents whose arrays are needed
KNOWN_WORDS = 200_000
AGAIN = 4  # pairs of different components for a row of the tiles, beyond which further leaders come first
BEFORE = 3  # earlier shared shingles by which a pair is known to have come out already


class Shingler:
    """Sorted distinct shingle hashes of texts; words are hashed once."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.known: dict[bytes, int] = {}

    def __call__(self, body: bytes) -> np.ndarray:
        words = body.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        try:
            hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words).difference(known))
            hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(words))
        out = np.full(len(words) - n + 1, n * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
        for i in range(n):
            out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : len(words) - n + 1 + i])
        out.sort()
        return out[np.r_[True, out[1:] != out[:-1]]]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def need(n, percent: int = PERCENT):
    """The least intersection of a set of n with any set that it links with."""
    return (percent * n + 99) // 100


def linked(shared, a, b, percent: int = PERCENT):
    return 100 * shared >= percent * (a + b - shared)


def signature(hashes: np.ndarray) -> bytes:
    """A bit for each hash, in the least power of two of bits (64 at least) that isn't under the set's size."""
    width = max(64, 1 << (max(1, len(hashes)) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(sig_a: bytes, a: int, sig_b: bytes, b: int) -> int:
    """An upper bound of the intersection: each bit that only one set has stands for an element that only it has."""
    x, y = np.frombuffer(sig_a, np.uint64), np.frombuffer(sig_b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(a - int(np.bitwise_count(x & ~y).sum()), b - int(np.bitwise_count(y & ~x).sum()))


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts as 16 bits that keep their order (all but equal ones may tie)."""
    return (np.log2(np.maximum(counts, 1)) * 1000 + 1).astype(np.uint64)


class Order:
    """The global order of shingles: those of few documents first, by hash, then the others by level and hash."""

    def __init__(self, packed: np.ndarray):
        """packed: key and level of each frequent shingle, ascending."""
        self.keys, self.levels = packed >> np.uint64(16), (packed & np.uint64(0xFFFF)).astype(np.int64)
        self.maybe = np.zeros(1 << 22, bool) if len(packed) > 1 << 16 else None
        if self.maybe is not None:
            self.maybe[(self.keys >> np.uint64(KEY_BITS - 22)).astype(np.int64)] = True

    def level(self, own: np.ndarray) -> np.ndarray:
        out = np.zeros(len(own), np.int64)
        if not len(self.keys):
            return out
        hot = slice(None) if self.maybe is None else self.maybe[(own >> np.uint64(42)).astype(np.int64)]
        some = own[hot] >> np.uint64(64 - KEY_BITS)
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        out[hot] = np.where(self.keys[at] == some, self.levels[at], 0)
        return out

    def prefix(self, own: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
        """The prefix of a set, and how many of the whole set aren't frequent."""
        n, level = len(own) - need(len(own), percent) + 1, self.level(own)
        return own[np.argsort(level, kind="stable")[:n]], int((level == 0).sum())


BLOCKS = "part int, keys binary, odd binary"


def key_blocks(held: list[np.ndarray], again: list[np.ndarray], parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, keys, odd) of the shingles of some documents: sorted keys, as steps of 32 bits where they fit; odd has
    place, documents and counted documents of the keys for which these aren't 1 and 1. Those of again aren't counted."""
    shift = np.uint64(64 - KEY_BITS)
    keys = np.concatenate([*((h >> shift << np.uint64(1)) | np.uint64(1) for h in held), *(h >> shift << np.uint64(1) for h in again)])
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] >> np.uint64(1) != keys[:-1] >> np.uint64(1)])
    docs, counted = np.diff(np.r_[first, len(keys)]), np.add.reduceat(keys & np.uint64(1), first).astype(np.int64)
    keys = keys[first] >> np.uint64(1)
    width = 1 << KEY_BITS
    bounds = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) * np.uint64(width // parts))
    for part, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if lo < hi:
            steps = np.diff(keys[lo:hi], prepend=np.uint64(part * (width // parts)))
            body = steps.astype(np.uint32) if int(steps.max()) < 1 << 32 else steps
            odd = np.flatnonzero((docs[lo:hi] != 1) | (counted[lo:hi] != 1))
            yield part, b"48"[body.itemsize == 8 :][:1] + body.tobytes(), np.stack([odd, docs[lo:hi][odd], counted[lo:hi][odd]]).tobytes()


def opened(part: int, keys: bytes, odd: bytes, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, documents and counted documents of a block."""
    steps = np.frombuffer(keys, np.uint32 if keys[:1] == b"4" else np.uint64, offset=1).astype(np.uint64)
    docs, counted = np.ones(len(steps), np.int64), np.ones(len(steps), np.int64)
    place, docs_at, counted_at = np.frombuffer(odd, np.int64).reshape(3, -1)
    docs[place], counted[place] = docs_at, counted_at
    return np.cumsum(steps) + np.uint64(part * ((1 << KEY_BITS) // parts)), docs, counted


def frequent(source: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """The frequent shingles (tables of packed keys and levels by ranges of keys), and bits by leading bits of the key
    that tell which shingles more than one document has; both from all documents.

    Of the documents counted together those with the same two least hashes, mostly copies of each other, count once:
    what should be ordered last is what different texts share.
    """
    spark = source.sparkSession
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, least, width = 1 << max(0, min(16, (2 * deal - 1).bit_length())), HOT_LEAST, REPEAT_BITS
    fields = common.arrow_schema(spark, BLOCKS)
    found = "part int, bits binary, hot binary"
    out = common.arrow_schema(spark, found)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, again, size, shingles = set(), [], [], 0, Shingler(words)

        def flush() -> Iterator[pa.RecordBatch]:
            for block in key_blocks(held, again, parts):
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in block], schema=fields)

        for batch in batches:
            for body in common.texts(batch)[1]:
                own = shingles(body)
                if not len(own):
                    continue
                key = own[:2].tobytes()
                (again if key in keys else held).append(own)
                keys.add(key)
                size += len(own)
                if size > COUNT_SHINGLES:
                    yield from flush()
                    keys, held, again, size = set(), [], [], 0
        if size:
            yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks = None, []

        def total() -> pa.RecordBatch:
            keys, docs, counted = (np.concatenate(x) for x in zip(*blocks, strict=True))
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, docs, counted = keys[first], np.add.reduceat(docs[order], first), np.add.reduceat(counted[order], first)
            bits = np.zeros((1 << width) // parts, bool)
            place = (keys[docs > 1] >> np.uint64(KEY_BITS - width)).astype(np.int64)
            bits[place - part * len(bits)] = True
            hot = counted >= least
            packed = keys[hot] << np.uint64(16) | levels(counted[hot])
            values = [[part], [np.packbits(bits, bitorder="little").tobytes()], [packed.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, out.types, strict=True)], schema=out)

        for batch in batches:
            for at, keys, odd in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != part and blocks:
                    yield total()
                    blocks = []
                part = at
                blocks.append(opened(at, keys, odd, parts))
        if blocks:
            yield total()

    blocks = source.mapInArrow(count, BLOCKS).repartition(deal, "part").sortWithinPartitions("part")
    counts = common.written(blocks.mapInArrow(add, found), "counts")
    bits = np.zeros((1 << width) // 8, np.uint8)
    rows = counts.select("part", "bits").toArrow()  # 2^REPEAT_BITS bits in all, whatever the input
    for part, body in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        own = np.frombuffer(body, np.uint8)
        bits[part * len(own) : (part + 1) * len(own)] = own
    return counts, bits


def with_levels(source: DataFrame, counts: DataFrame, bits, words: int) -> tuple[DataFrame, Order | None]:
    """The order for broadcast, or, if there are too many frequent shingles, source with those of each row (hot)."""
    spark = source.sparkSession
    size = counts.agg(F.sum(F.length("hot"))).first()[0] or 0
    if size <= 8 * HOT_BROADCAST:
        rows = counts.filter(F.length("hot") > 0).select("part", "hot").toArrow().sort_by("part")["hot"].to_pylist()
        return source.withColumn("hot", F.lit(None).cast("array<long>")), Order(np.frombuffer(b"".join(rows), np.uint64))
    key = common.arrow_schema(spark, "key long, packed long")
    held = common.arrow_schema(spark, "id long, key long")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                packed = np.frombuffer(body, np.uint64)
                yield pa.RecordBatch.from_arrays([(packed >> np.uint64(16)).view(np.int64), packed.view(np.int64)], schema=key)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            for doc, body in zip(*common.texts(batch), strict=True):
                own = shingles(body)
                own = own[repeated(own, bits.value)] >> np.uint64(64 - KEY_BITS)
                yield pa.RecordBatch.from_arrays([np.full(len(own), doc, np.int64), own.view(np.int64)], schema=held)

    rows = source.filter("id is not null").mapInArrow(explode, "id long, key long").distinct()
    rows = rows.join(counts.select("hot").mapInArrow(unpack, "key long, packed long"), "key")
    return source.join(rows.groupBy("id").agg(F.collect_list("packed").alias("hot")), "id", "left"), None


def repeated(own: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which shingles more than one document may have."""
    at = (own >> np.uint64(65 - (8 * len(bits)).bit_length())).astype(np.int64)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


SETS = "id long, n long, class binary, cold long, prefix binary, at binary, bits binary"


def sets(source: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row of id_and_text(): the size of its set, its class, and what candidates are found by: the shingles of its
    prefix that other documents may have, and their places in the whole set's order."""
    spark = source.sparkSession
    counts, bits = frequent(source, words)
    bits = spark.sparkContext.broadcast(bits)
    source, order = with_levels(source, counts, bits, words)
    order = spark.sparkContext.broadcast(order)
    fields = common.arrow_schema(spark, SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            out = []
            for doc, body, hot in zip(*common.texts(batch), batch.column(2), strict=True):
                own = shingles(body)
                if not len(own):
                    out.append((doc, 0, None, 0, None, None, None))
                    continue
                rank = order.value or Order(np.sort(np.array(hot.as_py() or [], np.int64).view(np.uint64)))
                prefix, cold = rank.prefix(own, percent)
                at = np.flatnonzero(repeated(prefix, bits.value)).astype(np.int32)
                out.append((doc, len(own), xxhash.xxh3_128_digest(own.tobytes()), cold, prefix[at].tobytes(), at.tobytes(), signature(own)))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(fields.names, zip(*out, strict=True), strict=True)), schema=fields)

    found = common.written(source.select("id", "text", "hot").mapInArrow(run, SETS), "sets")
    common.dropped(spark, counts)
    return found


def tiles(classes: DataFrame, percent: int, label: DataFrame | None = None) -> DataFrame:
    """(token, n, at, cold, rep, component, before, band) of prefix shingles; at is the place in the set's order, before
    the prefix shingles just before it. Components are those of label (node, component), or each rep's own."""
    if label is None:
        classes = classes.withColumn("component", F.col("rep"))
    else:
        classes = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    schema = "token long, n int, at int, cold int, rep long, component long, before array<long>"
    fields = common.arrow_schema(classes.sparkSession, schema)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, n, cold, component = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            prefix = [np.frombuffer(x, np.int64) for x in batch.column(4).to_pylist()]
            at = [np.frombuffer(x, np.int32) for x in batch.column(5).to_pylist()]
            times = [len(x) for x in prefix]
            if not sum(times):
                continue
            tokens = np.concatenate(prefix)
            place = np.concatenate([np.arange(k) for k in times])
            ends = np.cumsum(np.minimum(place, BEFORE))
            starts = ends - np.minimum(place, BEFORE)
            pick = np.arange(ends[-1]) - np.repeat(starts - np.arange(len(tokens)) + np.minimum(place, BEFORE), ends - starts)
            before = pa.ListArray.from_arrays(np.r_[starts, ends[-1]].astype(np.int32), pa.array(tokens[pick]))
            yield pa.RecordBatch.from_arrays([tokens, np.repeat(n, times).astype(np.int32), np.concatenate(at), np.repeat(cold, times).astype(np.int32), np.repeat(reps, times), np.repeat(component, times), before.cast(fields.field("before").type)], schema=fields)

    rows = classes.select("rep", "n", "cold", "component", "prefix", "at").mapInArrow(explode, schema)
    return rows.withColumn("band", size_band(F.col("n"), percent))


def size_band(n, percent: int):
    """Sets that link are in one band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")


def decided(pairs: DataFrame, classes: DataFrame, source: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link: bounded by their signatures, then decided by exact intersection."""
    spark = pairs.sparkSession
    some = classes.select("rep", "n", "bits")
    a, b = (some.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab")
    fields = common.arrow_schema(spark, "a long, b long")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [c.to_pylist() for c in batch.columns]
            keep = [linked(most_shared(p, m, q, n), m, n, percent) for m, n, p, q in zip(*x[2:6], strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], schema=fields).filter(pa.array(keep, pa.bool_()))

    near = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    near = common.written(near.mapInArrow(bounded, "a long, b long"), "near")

    ids = near.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    place = F.pmod(F.xxhash64("rep"), F.lit(1 << FILTER_BITS))
    bits = ids.select((place / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(rep), {1 << FILTER_BITS}) % 64 as int))").alias("v"))
    rows = bits.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()  # bounded by the size of the filter
    image = np.zeros(1 << FILTER_BITS - 6, np.int64)
    image[rows["w"].to_numpy()] = rows["v"].to_numpy()
    held = spark.sparkContext.broadcast(np.unpackbits(image.view(np.uint8), bitorder="little").view(bool))
    arrays = "rep long, class binary, own binary"
    out = common.arrow_schema(spark, arrays)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            keep = held.value[batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)]
            docs, bodies = common.texts(batch.filter(pa.array(keep)))
            own = [shingles(x).tobytes() for x in bodies]
            yield pa.RecordBatch.from_pydict({"rep": docs, "class": [xxhash.xxh3_128_digest(x) for x in own], "own": own}, schema=out)

    with_place = source.filter("id is not null").withColumn("p", F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)))
    own = with_place.mapInArrow(needed, arrays).join(classes.select("rep", "class"), ["rep", "class"]).join(ids, "rep", "left_semi")
    own = common.written(own.groupBy("rep").agg(F.first("own").alias("own")), "arrays")  # equal for all rows of rep

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in batch.column(i).to_pylist()] for i in (2, 3))
            keep = [linked(intersection(p, q), len(p), len(q), percent) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], schema=fields).filter(pa.array(keep, pa.bool_()))

    joined = near.join(own.select(F.col("rep").alias("b"), F.col("own").alias("own_b")), "b")
    joined = joined.join(own.select(F.col("rep").alias("a"), F.col("own").alias("own_a")), "a")
    links = common.written(joined.select("a", "b", "own_a", "own_b").mapInArrow(exact, "a long, b long"), "links")
    common.dropped(spark, near, own)
    return links


def stars(rows: DataFrame, among: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one leader (fewest shingles of its own) of each shingle and band of `among` and all of rows that
    have the shingle, in the same or a neighbouring band."""
    leaders = among.groupBy("token", "band").agg(F.min(F.struct("cold", "rep", "n", "at", "component")).alias("x"))
    nearby = leaders.select("token", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"), "x")
    both = rows.drop("before").join(nearby, ["token", "band"]).filter("rep != x.rep and component != x.component")
    both = both.filter(early("x.n", "x.at", percent))
    return both.select(F.least("x.rep", "rep").alias("a"), F.greatest("x.rep", "rep").alias("b")).distinct()


def early(n: str, at: str, percent: int) -> str:
    """Whether enough is left of both sets from the shingle on: so it is where two sets that link first share one."""
    return f"{100 + percent} * least(n - at, {n} - {at}) >= {percent} * (n + {n})"


def relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """Components of what label tells and of further links: label's stars stand for all links before."""
    return components(label.toDF("a", "b").union(links.select("a", "b")))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, and component_id, the least id that links lead to."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(common.BATCH_BYTES))
    source = common.id_and_text(df, id_col, text_col)
    found = sets(source, words, percent)
    members = common.written(found.select("id", "n", "class"), "members")
    named = members.filter("class is not null and id is not null").groupBy("class").agg(F.min("id").alias("rep"))
    named = common.written(named, "reps")
    reps = named.groupBy("rep").agg(F.min("class").alias("class"))
    same = [F.first(c).alias(c) for c in ("n", "cold", "prefix", "at", "bits")]  # equal in all of a class
    classes = common.written(found.join(reps, "class").groupBy("class", "rep").agg(*same), "classes")
    common.dropped(spark, found)

    alone = tiles(classes, percent)
    tried = common.written(stars(alone, alone, percent), "pairs")
    links = decided(tried, classes, source, words, percent)
    label = components(links)
    while True:
        where = tiles(classes, percent, label)
        apart = where.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("token")
        where = common.written(where.join(apart, "token"), "apart")
        main = where.groupBy("token", "component").count().groupBy("token").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.max("count").alias("most"), F.sum("count").alias("all"))
        outside = where.join(main, "token").filter("component != main").select(*where.columns)
        left, rows = main.agg(F.sum(F.expr("double(all - most) * all")), F.sum("all")).first()
        if not left or left <= AGAIN * rows:
            break
        # Many pairs are left: stars of further leaders join large groups of near copies before pairs are formed.
        more = stars(where, outside, percent).join(tried, ["a", "b"], "left_anti")
        more = common.written(more, "pairs")
        new = decided(more, classes, source, words, percent)
        tried, links = tried.union(more), links.union(new)
        if new.isEmpty():
            break
        common.dropped(spark, where)
        label = relabelled(label, new)

    # What is still apart and shares a shingle: everything outside the shingle's main component, against all.
    x = outside.select("token", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"), F.struct("rep", "n", "at", "component", "before").alias("x"))
    cross = x.join(where, ["token", "band"]).filter(
        f"component != x.component and {early('x.n', 'x.at', percent)} and not arrays_overlap(before, x.before)"
    )
    second = cross.select(F.least("x.rep", "rep").alias("a"), F.greatest("x.rep", "rep").alias("b")).distinct()
    second = common.written(second.join(tried, ["a", "b"], "left_anti"), "pairs")
    common.dropped(spark, where)
    more = decided(second, classes, source, words, percent)
    if not more.isEmpty():
        label = relabelled(label, more)

    named = named.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("class", F.coalesce("component", "rep").alias("component"))
    back = members.join(named, "class", "left")
    out = back.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    common.dropped(spark, classes, tried, second, links, more)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))
