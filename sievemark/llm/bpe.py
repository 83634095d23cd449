"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The most frequent words of the corpus are encoded once and compiled into a minimal acyclic automaton that shares
prefixes and suffixes; numbers on its arcs add up to a word's index, and the index leads to the word's token ids. Tasks
memory-map the compiled arrays and look up all their distinct words at once, byte by byte in numpy. Words
outside the lexicon are merged exactly, also all at once. The lexicon decides speed only, never the result.

Defined results: null and empty texts have no tokens; repeated rows give repeated results; only the id and text
columns are read; an empty table gives an empty result. Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of the lexicon, and how many each partition proposes. Bounds of what is broadcast; they change no result.
LEXICON_WORDS, PROPOSED_WORDS = 40_000, 20_000
LONGEST = 48  # bytes of a lexicon word
CACHE_WORDS = 150_000  # from so many known chunks on, those that the next ones don't need go
LEARNED_WORDS = 50_000  # new chunks that are cut and merged at once
TEXT_BYTES = 1 << 20  # of one Arrow batch

#: A space before white space or at the end: splitting before spaces then isn't what the rule does.
IRREGULAR = re.compile(
    rb" (?=[ \t-\r\x1c-\x1f]|\Z|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
)

#: Stands for such a space; no UTF-8 has this byte.
MARK = b"\xff"

#: Classes of bytes in chunks whose words end where the class changes: letters (of ASCII and U+00C0 to U+023F), digits,
#: white space, others. A chunk with an odd byte, white space behind white space, or U+00D7 or U+00F7 is cut by the full rule.
LETTER, DIGIT, WHITE, OTHER, ODD = range(5)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC2), *range(0xC3, 0xC9)]] = LETTER
KINDS[range(48, 58)] = DIGIT
KINDS[[*range(9, 14), 32]] = WHITE
KINDS[[*range(0x1C, 0x20), ord("'"), 0xC2, *range(0xC9, 256)]] = ODD

#: The file's own rule for words, as published with byte-level BPE.
WORD = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Positions:
    """Where each key stands among sorted distinct ones: a table of slots, and a search where keys share a slot."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.r_[keys, -1]
        self.bits = max(8, int(len(keys)).bit_length() + 3)
        slots = self._slots(keys)
        self.at = np.full(1 << self.bits, len(keys), np.int32)
        self.at[slots] = np.arange(len(keys))
        self.shared = np.bincount(slots, minlength=1 << self.bits) > 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key (none is negative), or the number of keys where it isn't among them."""
        none = len(self.keys) - 1
        slots = self._slots(keys)
        at = self.at[slots].astype(np.int64)
        other = self.keys[at] != keys
        again = np.flatnonzero(other & self.shared[slots])
        at[other] = none
        if len(again):
            found = np.searchsorted(self.keys[:-1], keys[again])
            at[again] = np.where(self.keys[found] == keys[again], found, none)
        return at


class Strings:
    """Many byte strings in one array."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.array([len(x) for x in strings], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, which: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The strings of these numbers one behind the other, and where each ends."""
        lengths = self.lengths[which]
        return self.flat[ranges(self.starts[which], lengths)].tobytes(), np.cumsum(lengths)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one behind the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """Token bytes, merges and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token
        of = {self.token_bytes[i]: i for i in vocab.values()}
        self.byte_ids = np.array([of[bytes([b])] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        if len(np.unique(made)) != len(made):
            raise ValueError("a token has two merges; rounds of equal pairs need one")
        keys, first = np.unique(keys, return_index=True)
        self.pairs, self.ranks, self.made = Positions(keys), np.r_[first, len(keys)], made
        self.decimals = Strings([str(i).encode() + b"," for i in range(size)])
        self.shown = Strings(self.token_bytes)

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the number of merges where it has none."""
        return self.ranks[self.pairs.find(left << 32 | right)]

    def merged(self, body: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, which stand one behind the other in body, and the number of ids of each word.

        In every round each word merges its pairs of lowest rank; only the pairs beside a merge are looked up anew. Every
        token is made by one merge, so what a round makes can only join in pairs of higher rank.
        """
        flat, none = self.byte_ids[body], len(self.made)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        rank = np.full(len(flat), none, np.int64)  # of each token and the next one
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self.ranked(flat[inside], flat[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(flat):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(flat)]))
            over = best == none
            if over.any():
                done.append((owner[over], flat[over]))
                flat, owner, rank, best = flat[~over], owner[~over], rank[~over], best[~over]
            # All the word's pairs of that rank at once, leftmost first: of pairs that overlap, every other one.
            place = np.flatnonzero(rank == best)
            first = np.r_[True, np.diff(place) > 1][: len(place)]
            place = place[(place - place[first][np.cumsum(first) - 1]) % 2 == 0]
            flat[place] = self.made[rank[place]]
            keep = np.ones(len(flat), bool)
            keep[place + 1] = False
            flat, owner, rank = flat[keep], owner[keep], rank[keep]
            place -= np.arange(len(place))
            beside = np.r_[place, place[place > 0] - 1]
            last = np.minimum(beside + 1, len(flat) - 1)
            pair = (last > beside) & (owner[beside] == owner[last])
            rank[beside] = none
            beside, last = beside[pair], last[pair]
            rank[beside] = self.ranked(flat[beside], flat[last])
        if not done:
            return flat, np.zeros(len(lengths), np.int64)
        owner, flat = (np.concatenate(x) for x in zip(*done, strict=True))
        return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(lengths))


def compiled(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The minimal acyclic transducer of distinct words, as the arrays of an .npz-like flat file (see Lexicon)."""
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    below: list[int] = []  # words reachable from each finished state
    arcs: list[tuple[tuple[int, int], ...]] = []
    finals: list[bool] = []

    def finished(children: list, final: bool) -> int:
        key = (final, tuple(children))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(tuple(children))
            finals.append(final)
            below.append(final + sum(below[t] for _, t in children))
        return register[key]

    path: list[list] = [[[], False]]  # open states along the last word: [finished arcs, final]
    last = b""
    for i in order:
        word = words[i]
        shared = len(os.path.commonprefix([word, last]))
        while len(path) > shared + 1:
            children, final = path.pop()
            path[-1][0].append((last[len(path) - 1], finished(children, final)))
        path += [[[], False] for _ in range(len(word) - shared)]
        path[-1][1] = True
        last = word
    while len(path) > 1:
        children, final = path.pop()
        path[-1][0].append((last[len(path) - 1], finished(children, final)))
    root = finished(*path[0])
    keys, target, output = [], [], []
    for state, children in enumerate(arcs):
        before = int(finals[state])
        for byte, to in children:
            keys.append(state << 8 | byte)
            target.append(to)
            output.append(before)
            before += below[to]
    rows = [ids[i] for i in order]
    parts = [
        np.array([root], np.int64),
        np.array(keys, np.int64),
        np.array(target, np.int32),
        np.array(output, np.int32),
        np.array(finals, np.bool_),
        np.cumsum([0, *map(len, rows)]).astype(np.int64),
        np.array([x for r in rows for x in r], np.int32),
    ]
    head = np.array([len(parts), *(x for p in parts for x in (p.dtype.num, len(p)))], np.int64)
    return head.tobytes() + b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)


class Lexicon:
    """A compiled transducer, memory-mapped from an unlinked file of the task's own."""

    def __init__(self, image: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(image)
            f.flush()
            whole = np.memmap(f, np.uint8, "r")
        n = int(whole[:8].view(np.int64)[0])
        head = whole[8 : 8 + 16 * n].view(np.int64).reshape(n, 2)
        at, parts = 8 + 16 * n, []
        by_number = {np.dtype(t).num: np.dtype(t) for t in (np.int64, np.int32, np.bool_)}
        for number, length in head.tolist():
            dtype = by_number[number]
            parts.append(np.asarray(whole[at : at + length * dtype.itemsize].view(dtype)))  # plain arrays slice faster
            at += length * dtype.itemsize + -(length * dtype.itemsize) % 8
        self.root, keys, self.target, self.output, self.finals, self.starts, self.ids = parts
        self.arcs = Positions(keys)

    def indexes(self, body: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each word in the lexicon, or -1; words stand one behind the other and all advance by one byte at a time."""
        starts = np.cumsum(lengths) - lengths
        result = np.full(len(lengths), -1, np.int64)
        if not len(self.target):
            return result
        who = np.flatnonzero((lengths > 0) & (lengths <= LONGEST))
        state = np.full(len(who), self.root[0], np.int64)
        number = np.zeros(len(who), np.int64)
        depth = 0
        while len(who):
            at = self.arcs.find(state << 8 | body[starts[who] + depth])
            ok = at < len(self.target)
            who, at = who[ok], at[ok]
            state, number = self.target[at].astype(np.int64), number[ok] + self.output[at]
            depth += 1
            over = lengths[who] == depth
            accepted = over & self.finals[state]
            result[who[accepted]] = number[accepted]
            who, state, number = who[~over], state[~over], number[~over]
        return result

    def words_ids(self, words: list[bytes]) -> list[list[int] | None]:
        at = self.indexes(*flattened(words)).tolist()
        starts, ids = self.starts, self.ids
        return [ids[starts[i] : starts[i + 1]].tolist() if i >= 0 else None for i in at]


def flattened(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words one behind the other, and their lengths."""
    return np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))


class Encoder:
    """Encodes texts as the tokenizers library does with the same file; decodes ids by their bytes."""

    def __init__(self, path: str, image: bytes | None = None):
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(path)
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.lexicon = Lexicon(image) if image else None
        self.special = re.compile(b"(" + b"|".join(map(re.escape, self.vocabulary.special)) + b")") if self.vocabulary.special else None
        #: Keys of chunks (see keys()) to decimal ids and the bytes that the ids decode to; those of a while ago.
        self.known: dict[bytes, tuple[bytes, bytes]] = {}
        self.before: dict[bytes, tuple[bytes, bytes]] = {}

    def pieces(self, text: bytes) -> list[bytes]:
        """The words of a piece of text by the file's own rule."""
        if text.isalpha() or text[:1] == b" " and text[1:].isalpha():  # ASCII letters
            return [text]
        whole = text.decode()
        if max(whole) < "ɐ":  # Latin: no doubt about what is a letter
            if (whole[1:] if whole[0] == " " else whole).isalpha():
                return [text]
            return [x.encode() for x in WORD.findall(whole)]
        return [whole[s:e].encode() for _, (s, e) in self.cut(whole)]

    def cuts(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chunks one behind the other, the lengths of their words, and the number of words of each.

        Words of plain chunks end where the class of the bytes changes; the others are cut by the full rule.
        """
        body, lengths = flattened(chunks)
        starts = np.cumsum(lengths) - lengths
        kind = KINDS[body]
        begins = np.zeros(len(body), bool)
        begins[starts] = True
        space = starts[(body[starts] == 32) & (lengths > 1)]
        odd = kind == ODD
        odd[1:] |= ~begins[1:] & ((kind[1:] == WHITE) & (kind[:-1] == WHITE) | (body[:-1] == 0xC3) & ((body[1:] == 0x97) | (body[1:] == 0xB7)))
        kind[space] = kind[space + 1]
        begins[1:] |= kind[1:] != kind[:-1]
        for i in np.flatnonzero(np.logical_or.reduceat(odd, starts)).tolist():
            at, end = starts[i], starts[i] + lengths[i]
            begins[at:end] = False
            begins[at + np.cumsum([0, *map(len, self.pieces(chunks[i].replace(MARK, b" "))[:-1])])] = True
        words = np.flatnonzero(begins)
        body = np.where(body == MARK[0], 32, body).astype(np.uint8)
        return body, np.diff(np.r_[words, len(body)]), np.diff(np.r_[np.searchsorted(words, starts), len(words)])

    def words_ids(self, body: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, which stand one behind the other in body, and the number of ids of each word."""
        if self.lexicon is None:
            return self.vocabulary.merged(body, lengths)
        at = self.lexicon.indexes(body, lengths)
        new = at < 0
        ids, some = self.vocabulary.merged(body[np.repeat(new, lengths)], lengths[new])
        starts = self.lexicon.starts[at[~new]]
        counts = np.zeros(len(lengths), np.int64)
        counts[new], counts[~new] = some, self.lexicon.starts[at[~new] + 1] - starts
        merged = np.repeat(new, counts)
        out = np.empty(len(merged), np.int64)
        out[merged], out[~merged] = ids, self.lexicon.ids[ranges(starts, counts[~new])]
        return out, counts

    def encoded_words(self, words: list[bytes]) -> list[list[int]]:
        ids, counts = self.words_ids(*flattened(words))
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if words else []

    def decoded(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.token_bytes.__getitem__, ids))

    def learn(self, keys: Iterable[bytes]) -> None:
        """Make the chunk of every key known."""
        known, before = self.known, self.before
        new = [k for k in keys if k not in known]
        known.update({k: before[k] for k in new if k in before})
        new = [k for k in new if k not in before]
        for at in range(0, len(new), LEARNED_WORDS):
            some = new[at : at + LEARNED_WORDS]
            body, lengths, words = self.cuts([chunk_of(k) for k in some])
            ids, counts = self.words_ids(body, lengths)
            last = np.cumsum(counts)[np.cumsum(words) - 1] - 1  # the last token of each chunk
            columns = []
            for strings, comma in ((self.vocabulary.decimals, 1), (self.vocabulary.shown, 0)):
                whole, ends = strings.joined(ids)
                to = ends[last].tolist()
                columns.append([whole[s : e - comma] for s, e in zip([0, *to], to)])  # noqa: B905
            known.update(zip(some, zip(*columns, strict=True), strict=True))

    def keys(self, text: bytes) -> list[bytes]:
        """The chunks that can be encoded apart from each other, each by a key: a chunk is what stands from one space that
        white space does not follow up to the next. The key of a chunk with that space is the rest, that of one without is
        the chunk behind a space; in keys spaces that white space follows are MARK."""
        if not text:
            return []
        if self.special and b"<" in text and (parts := self.special.split(text))[1:]:
            return [k for i, p in enumerate(parts) for k in ([b" " + p] if i % 2 else self.keys(p))]
        first, *rest = IRREGULAR.sub(MARK, text).split(b" ")
        return [b" " + first, *rest] if first else rest

    def digests(self, bodies: list[bytes]) -> Iterator[tuple[int, str, str]]:
        """Tokens, SHA-256 of the decimal ids joined by commas, and SHA-256 of the decoded text, for each text."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.before = {}, self.known
        for t, i in self.vocabulary.special.items():
            self.known[b" " + t] = (str(i).encode(), self.decoded([i]))
        cut = [self.keys(body) for body in bodies]
        self.learn(set().union(*cut))
        for own in cut:
            found = list(map(self.known.__getitem__, own))
            ids = b",".join([x for x, _ in found])
            back = b"".join([x for _, x in found])
            yield ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k in self.keys(text.encode()):
            if (c := chunk_of(k)) in self.vocabulary.special:
                out.append(self.vocabulary.special[c])
            else:
                body, lengths, _ = self.cuts([c])
                out += self.words_ids(body, lengths)[0].tolist()
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return self.decoded(ids).decode("utf-8", "replace")


def chunk_of(key: bytes) -> bytes:
    return key[1:] if key[:1] == b" " else b" " + key


@lru_cache(1)
def worker_encoder(path: str, image: bytes) -> Encoder:
    """The encoder of a Python worker, which its next task goes on with."""
    return Encoder(path, image)


def frequent_words(df: DataFrame, most: int = LEXICON_WORDS, proposed: int = PROPOSED_WORDS) -> list[bytes]:
    """The words of all texts of id_and_text() with the highest counts, at most `most`.

    Each partition proposes its most frequent words with their counts, Spark adds the counts up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for body in common.texts(batch)[1]:
                counts.update(body.split(b" "))
            if len(counts) > 10 * proposed:  # heavy hitters stay, rare words go
                counts = Counter(dict(counts.most_common(5 * proposed)))
        best = [(w, n) for w, n in counts.most_common(proposed) if 0 < len(w) < LONGEST]
        yield pa.RecordBatch.from_pydict({"word": [w for w, _ in best], "n": [n for _, n in best]}, schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    counted = df.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "word").limit(most // 2).collect()
    return [w for r in rows for w in (b" " + bytes(r.word), bytes(r.word))]


def lexicon_image(df: DataFrame, path: str, most: int = LEXICON_WORDS) -> bytes:
    encoder = Encoder(path)
    words = [w for w in frequent_words(df, most) if len(w) <= LONGEST and encoder.pieces(w) == [w]]
    return compiled(words, encoder.encoded_words(words))


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per row of df: the number of tokens and the digests of ids and decoded text."""
    return _mapped(df, id_col, text_col, name, SCHEMA, lambda doc, body, n, ids, back: (doc, n, ids, back))


def _mapped(df: DataFrame, id_col: str, text_col: str, name: str, schema: str, row) -> DataFrame:
    source = common.id_and_text(df, id_col, text_col)
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))
    image = spark.sparkContext.broadcast(lexicon_image(source, vocabulary_path(name)))
    fields = common.arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or worker_encoder(vocabulary_path(name), image.value)
            ids, bodies = common.texts(batch)
            gc.disable()  # many small objects and no cycles: counting references frees them all
            try:
                out = [row(doc, body, *found) for doc, body, found in zip(ids, bodies, encoder.digests(bodies), strict=True)]
            finally:
                gc.enable()
            yield pa.RecordBatch.from_pydict(dict(zip(fields.names, zip(*out, strict=True), strict=True)) if out else {n: [] for n in fields.names}, schema=fields)

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(common.table(spark, sf_dir, "documents"))
