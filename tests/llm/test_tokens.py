"""Encoding, decoding and counts against the tokenizers library."""

import hashlib
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfspan.llm import bpe, tokens

PATH = tokens.vocabulary()
LIBRARY = Tokenizer.from_file(PATH)
TEXT = st.text(alphabet=st.one_of(st.sampled_from("ab  '\n\tsrelv.!<|é日"), st.characters(exclude_categories=["Cs"])), max_size=40)
CASES = [None, "", " ", "a", "<|endoftext|>", "x<|endoftext|> y", "it's  \n\n ok", "日本語😀", "word " * 30000, "a" * 20000]


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def encoded(e, text):
    out = []
    for pieces, added in e.segments(text):
        for p in pieces:
            out += e.encode_piece(p)
        if added is not None:
            out.append(e.added[added])
    return out


@settings(max_examples=300, deadline=None)
@given(TEXT, st.booleans())
def test_encode_as_library(text, special):
    text = text + "<|endoftext|>" + text if special else text
    e = bpe.load(PATH)
    got = encoded(e, text)
    assert got == ids_of(text)
    assert e.decode(np.array(got, dtype=np.int64)).decode("utf-8", "replace") == LIBRARY.decode(got, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.booleans())
def test_every_prefix_count(text, special):
    text = text[:8] + "<|endoftext|>" + text[8:] if special else text
    table = bpe.PrefixTokens(bpe.load(PATH), text)
    want = [len(ids_of(text[:k])) for k in range(len(text) + 1)]
    assert [table.count(k) for k in range(len(text) + 1)] == want
    assert [table.fit(n) for n in range(4)] == [max(k for k, c in enumerate(want) if c <= n) for n in range(4)]


@pytest.mark.parametrize("unit", ["a", " ", "\n", "!", "7", "é", "ab ", "x<|endoftext|>"])
def test_fit_takes_linear_time(unit):
    text = unit * (20_000 // len(unit))
    began = time.process_time()
    table = bpe.PrefixTokens(bpe.load(PATH), text)
    got = [table.fit(n) for n in (0, 5, 1000)]
    assert time.process_time() - began < 1
    for n, c in zip((0, 5, 1000), got, strict=True):
        assert len(ids_of(text[:c])) <= n and (c == len(text) or len(ids_of(text[: c + 1])) > n)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t, "extra", 7) for i, t in enumerate(CASES)] + [(None, "null id", None, None), (3, "a", "extra", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, n_tokens int")


def test_round_trip(frame):
    got = tokens.round_trip(frame, PATH).collect()
    want = []
    for r in frame.collect():
        ids = ids_of(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokens.round_trip(frame.limit(0), PATH).count() == 0


def test_encode_and_decode_columns(frame):
    got = tokens.decode(tokens.encode(frame, PATH), PATH)
    assert got.columns == ["doc_id", "text", "ids_sha256", "n_tokens", "token_ids", "decoded"]
    assert all(r.decoded == (r.text or "") and r.token_ids == ids_of(r.text or "") for r in got.collect())


def test_counts(frame):
    for r in tokens.count(frame, PATH, limit=5).join(frame.select("doc_id", "text").distinct(), "doc_id").collect():
        n = len(ids_of(r.text or ""))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 5)
        assert len(ids_of((r.text or "")[: r.fitting_chars])) <= 5
    assert tokens.count(frame.limit(0), PATH, limit=5).count() == 0
