import re

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from sievemark.llm import wordpiece

FIRST, REST = wordpiece.vocabulary(wordpiece.vocabulary_path())
MATCHER = wordpiece.Matcher(FIRST, REST)


def greedy(word, first, rest):
    n, vocabulary = 0, first
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in vocabulary), 0)
        if not k:
            return -1
        n, word, vocabulary = n + 1, word[k:], rest
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=4)), st.sets(st.text("abc", min_size=1, max_size=4)), st.lists(st.text("abcd", min_size=1, max_size=12)))
def test_small_vocabularies(first, rest, words):
    first, rest = {x.encode() for x in first}, {x.encode() for x in rest}
    got = wordpiece.Matcher(first, rest).lengths([w.encode() for w in words]).tolist()
    assert got == [greedy(w.encode(), first, rest) for w in words]


def test_same_as_the_library(spark):
    vocab = {"[UNK]": 0}
    for piece in [*(x.decode() for x in FIRST), *("##" + x.decode() for x in REST)]:
        vocab.setdefault(piece, len(vocab))
    library = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**6))
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in wordpiece.count_documents(df, MATCHER).collect()}
    for r in df.collect():
        words = re.findall(r"[!-/:-@\[-`{-~]|[^\s!-/:-@\[-`{-~]+", r.text)
        assert got[r.doc_id] == sum(len(library.encode(w).ids) for w in words)


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (2, "", 1), (3, "日本 , a", 1), (None, "the\nthe", 2), (5, "a" * 200_000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(wordpiece.count_documents(df, MATCHER).collect(), key=str)
    assert len(got) == 6 and sorted(r.n_words for r in got) == [0, 0, 0, 1, 2, 3]
    assert wordpiece.count_documents(df.limit(0), MATCHER).count() == 0


def whole_greedy(word, pieces):
    """Tokens of a word by greedy longest match over all pieces of the file, bytes where a character has none."""
    body, at, n = "▁" + word, 0, 0
    while at < len(body):
        ends = range(min(len(body), at + 64), at, -1)
        end = next((e for e in ends if body[at:e] in pieces and (at == 0 or body[at] != "▁")), 0)
        n += 1 if end else len(body[at].encode())
        at = end or at + 1
    return n


def test_whole_vocabulary(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=wordpiece.vocabulary_path())
    ids = range(model.get_piece_size())
    pieces = {model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    assert "▁" in pieces and max(map(len, pieces)) <= 64
    words = ["ñandú", "ñ", "日本語" * 500, "\U0001f9ff", "a\U0001f9ffb", "x鿿y", "é", "the", "(", "á" * 9, "\u0378", "▁a▁"]
    want = [whole_greedy(w, pieces) for w in words]
    assert wordpiece.whole_matcher(wordpiece.vocabulary_path()).lengths([w.encode() for w in words]).tolist() == want
    got = {r.doc_id: r for r in wordpiece.query(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        words = re.findall(r"[!-/:-@\[-`{-~]|[^\s!-/:-@\[-`{-~]+", r.text)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_unknown) == (sum(whole_greedy(w, pieces) for w in words), 0)
