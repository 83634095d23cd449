"""Token counts by linear longest match.

The vocabulary becomes a trie with failure links. Each link carries the number of pieces that following it settles, so a
word's greedy word-piece length comes from one pass over its bytes, without building pieces. All distinct words of a
batch walk the trie together in numpy.

Words are runs without white space and ASCII punctuation; each punctuation character is a word. The query has the whole
vocabulary: where no longer piece starts a word its bare start piece does, and a character without a piece is one token
for each of its bytes. With a vocabulary that lacks those, a word that greedy longest match can't cover counts as one
unknown token. Defined results: null and empty texts have no words; repeated
rows get equal results; only the id and text columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

SPLIT = re.compile(rb"[!-/:-@\[-`{-~]|[^\s!-/:-@\[-`{-~]+")
KNOWN_WORDS = 300_000
TEXT_BYTES = 4 << 20


class Matcher:
    """first: pieces that start a word; rest: pieces that go on. All as UTF-8, bytes of byte pieces as they are.

    With bare, a piece of no characters can start a word too.
    """

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes], bare: bool = False):
        child: list[dict[int, int]] = [{}, {}]  # node 0 starts words, node 1 goes on
        last = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for byte in piece:
                    if byte not in child[node]:
                        child[node][byte] = len(child)
                        child.append({})
                        last.append(False)
                    node = child[node][byte]
                last[node] = node > 1
        fail, pops = [-1] * len(child), [0] * len(child)
        if bare:
            fail[0], pops[0] = 1, 1
        level = [(root, byte, node) for root in (0, 1) for byte, node in child[root].items()]
        while level:
            following = []
            for up, byte, node in level:
                if last[node]:
                    fail[node], pops[node] = 1, 1
                else:
                    at, n = fail[up], pops[up]
                    while at >= 0 and byte not in child[at]:
                        n += pops[at]
                        at = fail[at]
                    if at >= 0:
                        fail[node], pops[node] = child[at][byte], n
                following += [(node, b, x) for b, x in child[node].items()]
            level = following
        arcs = sorted((node << 8 | byte, to) for node, edges in enumerate(child) for byte, to in edges.items())
        self.keys = np.array([k for k, _ in arcs] or [-1], np.int64)
        self.targets = np.array([t for _, t in arcs] or [0], np.int64)
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word, -1 where it can't be covered."""
        size = np.array([len(w) for w in words], np.int64)
        out = np.full(len(words), -1, np.int64)
        if not len(words):
            return out
        body = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        who, at = np.flatnonzero(size > 0), (np.cumsum(size) - size)[size > 0]
        end = at + size[who]
        node, count = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
        while len(who):
            over = at == end
            done = over & (node == 1)
            out[who[done]] = count[done]
            key = node << 8 | body[np.where(over, 0, at)]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            step = (self.keys[arc] == key) & ~over
            count = np.where(step, count, count + self.pops[node])
            node = np.where(step, self.targets[arc], self.fail[node])
            at = at + step
            live = (node >= 0) & ~done
            who, at, end, node, count = who[live], at[live], end[live], node[live], count[live]
        return out


def vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Word-starting and other pieces of a sentencepiece file; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, rest = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        if piece.startswith("▁"):
            first.append(piece[1:].encode())
        else:
            rest.append(piece.encode())
    return [p for p in first if p], rest


def whole_matcher(path: str) -> Matcher:
    """Matcher of all pieces of a sentencepiece file, the bare start piece and the byte pieces included."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, rest = vocabulary(path)
    single = [bytes([int(model.id_to_piece(i)[1:-1], 16)]) for i in range(model.get_piece_size()) if model.is_byte(i)]
    return Matcher(first, rest + single, bare=not model.is_unknown(model.piece_to_id("▁")))


SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long"


def count_documents(df: DataFrame, matcher: Matcher, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: words, tokens (an unknown word is one) and unknown words."""
    held = df.sparkSession.sparkContext.broadcast(matcher)
    fields = common.arrow_schema(df.sparkSession, SCHEMA)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            ids, bodies = common.texts(batch)
            split = [SPLIT.findall(b) for b in bodies]
            if len(known) > KNOWN_WORDS:
                known.clear()
            new = list({w for words in split for w in words}.difference(known))
            known.update(zip(new, held.value.lengths(new).tolist(), strict=True))
            out = [[known[w] for w in words] for words in split]
            unknown = [x.count(-1) for x in out]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": ids, "n_words": list(map(len, out)), "n_tokens": [sum(x) + 2 * u for x, u in zip(out, unknown, strict=True)], "n_unknown": unknown},
                schema=fields,
            )

    return common.id_and_text(df, id_col, text_col).mapInArrow(run, SCHEMA)


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(common.table(spark, sf_dir, "documents"), whole_matcher(vocabulary_path()))
