"""Operators 7 and 9: encodings against the libraries, round trips, and packing."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import bpe, packing

from .conftest import frame

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def words():
    return bpe.vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab's trelvmd \n\t1é½!.中\U0001f600'"), max_size=80))
def test_as_the_library(text):
    ranks = bpe.vocabulary(PATH)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})
    assert ranks.encode(text) == lib.encode_ordinary(text)


def test_long_words(words, library):
    for text in ("x" * 500, "ab" * 400 + " " + "-" * 300, "é" * 200, " " * 100 + "a"):
        assert words.encode(text) == library.encode_ordinary(text)


def test_digests(spark, corpus, words, library):
    got = bpe.digests(frame(spark, corpus), PATH).collect()
    texts = dict(corpus)
    assert len(got) == len(corpus)
    for r in got:
        text = texts[r.doc_id] or ""
        ids = np.array(library.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.digests(frame(spark, []), PATH).collect() == []


def test_round_trip(spark, corpus):
    tokens = bpe.tokenize(frame(spark, corpus), PATH)
    texts = dict(corpus)
    assert all(bytes(r.text).decode() == (texts[r.doc_id] or "") for r in bpe.detokenize(tokens, PATH).collect())


def test_prefixes_under_edits(words):
    rng = random.Random(4)
    p = bpe.Prefixes(words, b"the quick brown fox jumps over the lazy dog " * 10)
    mirror = bytearray(p.text)
    for _ in range(100):
        lo = rng.randrange(len(mirror))
        hi, new = min(len(mirror), lo + rng.randrange(5)), bytes(rng.choice(b"thequick ") for _ in range(rng.randrange(6)))
        p.replace(lo, hi, new)
        mirror[lo:hi] = new
        assert p.text == bytes(mirror) and p.last == words.last_tokens(bytes(mirror), [])
    p.append(b"more")
    assert b"".join(words.tokens[i] for i in p.ids()) == bytes(mirror) + b"more"


def check_pieces(rows, texts, window=1024):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, found in by_doc.items():
        ids = np.array(lib.encode(texts[doc] or "", add_special_tokens=False).ids + [0], "<u4")
        at = {}
        for r in found:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            at.setdefault(r.start, []).append(r.length)
        assert sum(v[0] for v in at.values()) == len(ids)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in places.values():
        end = 0
        for offset, length in sorted(some):
            assert offset == end
            end += length
        assert end <= window
    return places


def test_packing(spark, corpus):
    texts = dict(corpus)
    rows = packing.pack_documents(frame(spark, corpus), packing.rank_path()).collect()
    assert {r.doc_id for r in rows} == set(texts)
    check_pieces(rows, texts)
    assert packing.pack_documents(frame(spark, []), packing.rank_path()).collect() == []


def test_special_strings(spark):
    text = "a<|endoftext|>b c"
    rows = packing.pack_documents(frame(spark, [(1, text), (2, "<|endoftext|>")]), packing.rank_path()).collect()
    check_pieces(rows, {1: text, 2: "<|endoftext|>"})


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    histogram = np.zeros(129, np.int64)
    lengths = rng.integers(1, 129, 3000) if seed else rng.choice([3, 50, 128], 3000)
    np.add.at(histogram, lengths, 1)
    plan = packing.plan_packing(histogram, 128)
    used = np.zeros(129, np.int64)
    for parts, n in plan:
        assert sum(parts) <= 128
        for v in parts:
            used[v] += n
    assert (used == histogram).all()
    waste = sum((128 - sum(parts)) * n for parts, n in plan)
    assert seed == 0 or waste < 0.02 * sum(sum(p) * n for p, n in plan)
    assert packing.plan_packing(np.zeros(129, np.int64), 128) == []
