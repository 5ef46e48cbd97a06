import random

import pytest
from tokenizers import Tokenizer

from gridloom.llm import tokens


@pytest.fixture(scope="module")
def automaton():
    return tokens.Automaton(tokens.vocabulary())


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(tokens.vocabulary())
    t.encode_special_tokens = True
    return t


def _texts():
    r = random.Random(3)
    pool = [chr(c) for c in range(256)] + list("éß日本語กขΩЖ٣²Ⅷ👩‍🔧‏　﻿ ")
    words = ["the", "thethe", " aaaa", "don't", "'ll", "   x", "\n\n\t", "http://a.b/c?d=1", "0000123", "{{", "ﷺ"]
    return ["".join(r.choice(pool) if r.random() < 0.5 else r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(800)]


def test_encoding_equals_the_public_library(automaton, public):
    e = tokens.Encoder(automaton)
    for t in [*_texts(), "", "a" * 5000, " " * 3000, "<|endoftext|>", "ab" * 700]:
        ids = e.encode(t)
        assert ids == public.encode(t, add_special_tokens=False).ids
        assert automaton.decode(ids).decode() == t


def test_each_arc_is_a_correct_pair(automaton, public):
    """The automaton allows two tokens after each other exactly if encoding their bytes gives them back."""
    r = random.Random(8)
    ids = sorted(automaton.labels)
    for _ in range(4000):
        u, v = r.choice(ids[: r.choice([400, 5000, len(ids)])]), r.choice(ids[: r.choice([400, 5000, len(ids)])])
        assert automaton.follows(u, v) == (automaton.encode_word(automaton.labels[u] + automaton.labels[v]) == [u, v])


def test_corpus(spark, public):
    texts = [None, "", " ", "x\r\ny", "a very long text " * 5000, "x\r\ny"]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(None, "z", [2])], "doc_id bigint, text string, ids array<int>")
    got = tokens.encode_corpus(df)
    rows = {r.doc_id: r.ids for r in got.collect()}
    assert rows[0] == rows[1] == []
    assert rows[3] == rows[5] == public.encode("x\r\ny", add_special_tokens=False).ids
    assert len(rows) == 7
    back = {r.doc_id: r.text for r in tokens.decode_corpus(got).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    n = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, ["doc_id"]).collect()}
    assert n == {i: len(x) for i, x in rows.items()}
    assert tokens.encode_corpus(df.limit(0)).count() == 0
