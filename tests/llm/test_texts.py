"""Splitting and token ids: exact round trips."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notegraph.llm import split as S
from notegraph.llm import tokens as K

ALPHABET = st.lists(st.sampled_from([*"ab.!? \n\t\r#-é👍\u200d\xa0", "word ", "\n\n", "```\n", "# ", "x" * 30]), max_size=200).map("".join)


def check(text, limit, overlap):
    pieces = S.split_text(text, limit, overlap)
    assert "".join(p[o:] for p, o in pieces) == text
    for i, (p, o) in enumerate(pieces):
        assert 0 < len(p) <= limit and o <= overlap and (i > 0 or o == 0) and len(p) > o
        assert o == 0 or pieces[i - 1][0].endswith(p[:o])


@settings(max_examples=150, deadline=None)
@given(ALPHABET)
def test_split_is_lossless(text):
    if text:
        check(text, 60, 12)


def test_split_cuts_at_boundaries():
    text = ("A sentence of some words. " * 60 + "\n\n") * 3
    pieces = S.split_text(text)
    check(text, S.LIMIT, S.OVERLAP)
    assert all(p[o:].startswith("A sentence") for p, o in pieces)
    check("x" * 50_000, S.LIMIT, S.OVERLAP)
    check(" " * 9000, S.LIMIT, S.OVERLAP)


def test_split_rows(spark):
    long, padded = "y " * 1300, " \n" * 3000 + "short"
    rows = [("p", 0, "h", long), ("p", 0, "h", long), ("p", 1, None, padded), ("p", 2, "", None), ("p", 3, "h", ""), (None, 4, None, "z" * 2401), ("p", 5, "h", "z" * 2400)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "path string, seq int, heading string, content string, text string, piece int")
    got = S.split_oversized(df).collect()
    assert {(r.path, r.seq) for r in got} == {("p", 0), (None, 4)} and sum(r.seq == 0 for r in got) == 2
    assert S.split_oversized(df.limit(0)).count() == 0


needs_vocabulary = pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="no vocabulary")


@needs_vocabulary
def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(K.VOCABULARY)
    t.encode_special_tokens = True
    e, rng = K.Encoder(), random.Random(2)
    parts = ["a", "the", " ", "\n", "  ", "é", "🎉", "ing", "‍", "12", "--", "'s", "\t", "あい", "<|endoftext|>", "\x00", "\xa0", "Hello", "_", "İ", "ﬁ"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert e.encode(text) == t.encode(text, add_special_tokens=False).ids, repr(text)
    long = "word" * 3000 + " " * 50 + "é" * 500
    assert e.encode(long) == t.encode(long, add_special_tokens=False).ids


@needs_vocabulary
def test_appends_and_edits_are_exact():
    v, rng = K.Vocabulary(K.VOCABULARY), random.Random(4)
    fresh = lambda b: K.PrefixEncoder(v, b).ids()
    for _ in range(60):
        data = bytes(rng.choice(b"abcdeinorst ") for _ in range(40))
        p = K.PrefixEncoder(v, data[:15])
        p.append(data[15:])
        assert p.ids() == fresh(data)
        p.edit(10, 14, b"ing")
        assert p.ids() == fresh(data[:10] + b"ing" + data[14:])


@needs_vocabulary
def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hi", "x"), (3, "hi", "x"), (None, "hi", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id or 0, r.ids) for r in K.encode_corpus(df).collect())
    assert [x[1] for x in got] == [K.Encoder().encode("hi"), [], [], got[3][1], got[3][1]] and got[0][1] == got[3][1]
    assert K.encode_corpus(df.limit(0)).count() == 0


@needs_vocabulary
def test_edits_stop_near_the_edit():
    v = K.encoder(K.VOCABULARY).v
    piece = ("the quick brown fox jumps over lazy dogs " * 60).encode()
    p = K.PrefixEncoder(v, piece)
    done = p.edit(1000, 1003, b"zqx")
    whole = piece[:1000] + b"zqx" + piece[1003:]
    assert p.ids() == K.PrefixEncoder(v, whole).ids() and p.bytes == whole and done < 20 + 4 * v.longest
    p.edit(5, 5, b"")
    p.edit(len(whole) - 2, len(whole), b"")
    assert p.ids() == K.PrefixEncoder(v, whole[:-2]).ids()
