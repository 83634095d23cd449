import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievemark.llm import bpe

PATH = bpe.vocabulary_path()
LIBRARY = Tokenizer.from_file(PATH)
WORDS = [b" the", b"the", b" then", b"tion", b" tion", b"station", b"nation"]
PLAIN = bpe.Encoder(PATH)
IMAGE = bpe.compiled(WORDS, PLAIN.encoded_words(WORDS))
ENCODER = bpe.Encoder(PATH, IMAGE)


def check(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ENCODER.encode(text) == want
    back = LIBRARY.decode(want, skip_special_tokens=False)
    assert ENCODER.decode(want) == back
    digest = hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert [*ENCODER.digests([text.encode()])] == [(len(want), digest, hashlib.sha256(back.encode()).hexdigest())]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aetn oi s.,'\n\t 12é  ñ日🎉<|>$"), max_size=60) | st.text(max_size=40))
def test_same_as_the_library(text):
    check(text)


def test_special_tokens_and_spaces():
    for text in ("", "a<|endoftext|> b<|endoftext|>", "  a  b \n c  ", "I'll don't 's", "x" * 500, " \u0085x  y"):
        check(text)


def test_transducer_finds_its_words_only():
    lexicon = bpe.Lexicon(IMAGE)
    assert lexicon.words_ids(WORDS) == PLAIN.encoded_words(WORDS)
    assert lexicon.words_ids([b"t", b" th", b"thee", b"", b"x" * 99]) == [None] * 5
    assert len(lexicon.finals) < sum(map(len, WORDS)) - 8  # suffixes are shared


def test_documents(spark):
    rows = [(1, "the nation", 9), (1, "the nation", 9), (2, None, 9), (3, "", 9), (4, "é" * 50_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id, r.n_tokens) for r in bpe.encode_documents(df).collect())
    assert got == sorted((i, len(LIBRARY.encode(t or "").ids)) for i, t, _ in rows)
    assert bpe.encode_documents(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé×÷ºª² \u0085ȿɐ日\x1c'.,19\n\t  "), max_size=12), max_size=6))
def test_same_as_the_library_over_many_texts(texts):
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    got = [n for n, *_ in ENCODER.digests([t.encode() for t in texts])]
    assert got == list(map(len, want)) and [ENCODER.encode(t) for t in texts] == want


def test_latin_characters_between_letters():
    for i in range(0x80, 0x260):
        check(f"a{chr(i)}b {chr(i)}1 {chr(i)}")


def test_known_words_last_over_batches(monkeypatch):
    """Words that come again are merged once, however many others a worker has met; what comes once goes."""
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    encoder, merged = bpe.Encoder(PATH), []
    monkeypatch.setattr(encoder.vocabulary, "merged", lambda *x, f=encoder.vocabulary.merged: merged.append(len(x[-1])) or f(*x))
    common = [f"w{'ab'[i % 2] * i}" for i in range(1, 31)]
    for batch in range(20):
        text = " ".join([*common, *(f"{'xyz'[k % 3] * k}{'q' * batch}" for k in range(1, 31))])
        check_one = LIBRARY.encode(text, add_special_tokens=False).ids
        assert next(encoder.digests([text.encode()]))[0] == len(check_one)
        assert len(encoder.known) <= 50 + 62
    assert sum(merged) <= len(common) + 20 * 30 + 1 + len(encoder.vocabulary.special)


def test_overlapping_pairs_and_long_words():
    for text in ("a" * 5, "aaaa aaa", "ababab" * 7, "é" * 33, "日本" * 20, "x" * 3000 + "y", "0" * 77, "-" * 130):
        check(text)
