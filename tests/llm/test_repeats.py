"""Operators 4 and 8 against brute force, and their parts."""

import hashlib
import random
import re

import numpy as np
import pytest

from quillspark.llm import repeats, substring_dedup, suffix_dedup
from quillspark.llm.deep_shallow import BlindTrie, suffix_order

from .conftest import frame


def brute_bytes(rows):
    seen, out = set(), {}
    for doc, text in sorted(set(rows), key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out[doc] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows):
    seen, out = set(), {}
    for doc, text in sorted(set(rows), key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone, mine = [0] * len(words), set()
        for p in range(len(words) - 49):
            w = tuple(words[p : p + 50])
            if w in seen:
                gone[p : p + 50] = [1] * 50
            mine.add(w)
        seen |= mine
        out[doc] = (len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("operator", "brute"), [(suffix_dedup, brute_bytes), (substring_dedup, brute_words)])
def test_against_brute_force(spark, corpus, operator, brute):
    got = operator.dedup(frame(spark, corpus), with_text=False).collect()
    want = brute(corpus)
    assert len(got) == len(corpus)
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert sum(v[1] for v in want.values()) > 0


@pytest.mark.parametrize("operator", [suffix_dedup, substring_dedup])
def test_empty_and_null(spark, operator):
    assert operator.dedup(frame(spark, [])).collect() == []
    rows = [(None, None), (None, "x" * 200), (1, "x" * 200), (2, None), (1, "other text")]
    got = operator.dedup(frame(spark, rows)).collect()
    assert len(got) == 5 and sum(r.doc_id is None for r in got) == 2


def test_null_id_comes_last(spark):
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup(frame(spark, [(None, "abc" * 60), (7, "abcd" * 60), (9, "abc" * 60)])).collect()}
    assert got[None] == 180


def test_rows_keep_their_columns(spark):
    run = "".join(map(str, range(100, 140)))
    rows = [(1, "p" * 50 + run), (2, run), (3, None), (4, "short"), (5, "r" + run)]
    got = {r.doc_id: r.text for r in suffix_dedup.dedup_rows(frame(spark, rows)).collect()}
    assert got == {1: "p" * 50 + run, 3: None, 4: "short", 5: "r"}


def test_wide_and_heavy_keys_give_the_same(spark, corpus, monkeypatch):
    monkeypatch.setattr(repeats, "WIDE", 1)
    monkeypatch.setattr(repeats, "HEAVY_DOCS", 1)
    monkeypatch.setattr(repeats, "SAMPLE", 2)
    got = suffix_dedup.dedup(frame(spark, corpus), with_text=False).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_bytes(corpus)


def test_long_documents_are_cut(corpus):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    plan = repeats.Plan("byte", 100, 24, True, 4)
    docs, offsets = np.array([5]), np.array([0, len(data)])
    whole = [repeats.slices(plan, u) for u in repeats.segments(plan, docs, data, offsets)]
    old = repeats.CHUNK_BYTES
    try:
        repeats.CHUNK_BYTES = 700
        cut = [repeats.slices(plan, u) for u in repeats.segments(plan, docs, data, offsets)]
    finally:
        repeats.CHUNK_BYTES = old
    windows = lambda found: sorted(s + i for f in found for s, c in zip(f[3].tolist(), f[4].tolist()) for i in range(c))
    assert windows(whole) == windows(cut) == list(range(4901))


def test_suffix_order():
    rng = random.Random(5)
    raw = "".join(rng.choice("ab") for _ in range(3000)).encode() + b"ab" * 300
    buffer = np.concatenate([np.frombuffer(raw, np.uint8), np.zeros(120, np.uint8)])
    starts = np.array(rng.sample(range(len(raw)), 2000))
    order, group = suffix_order(buffer, starts, 100)
    text = buffer.tobytes()
    keys = [text[starts[i] : starts[i] + 100] for i in order]
    assert keys == sorted(keys)
    assert all((group[i] == group[i - 1]) == (keys[i] == keys[i - 1]) for i in range(1, len(keys)))


def test_blind_trie():
    rng = random.Random(2)
    items = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(500)]
    trie = BlindTrie()
    for i, t in enumerate(items):
        trie.insert(t, i)
    leaves = trie.leaves()
    assert [items[x[0]] for x in leaves] == sorted(set(items))
    assert sorted(i for x in leaves for i in x) == list(range(500))


def rows_of_ids(rng):
    """Repeated and null ids with many texts, ids of any size, and equal rows."""
    shared = " ".join(str(rng.randrange(10**6)) for _ in range(60))
    text = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(3))
    ids = [None, 5, 6, 1 << 42, (1 << 63) - 1, -(1 << 63)]
    rows = [(i, f"{text()} {shared} {text()}") for i in ids for _ in range(7)]
    return rows + rows[:4] + [(8, text())]


def test_any_id_and_any_number_of_texts(spark, monkeypatch):
    """As many texts of one id as there are bits for: were these fixed, places would meet those of the next id."""
    monkeypatch.setattr(repeats, "SHIFT", 2, raising=False)
    rows = rows_of_ids(random.Random(8))
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest())
    seen, want = set(), {}
    for doc, text in sorted(set(rows), key=key):
        data = text.encode()
        gone = {q for p in range(len(data) - 99) if data[p : p + 100] in seen for q in range(p, p + 100)}
        seen |= {data[p : p + 100] for p in range(len(data) - 99)}
        want[doc, hashlib.sha256(bytes(x for q, x in enumerate(data) if q not in gone)).hexdigest()] = len(gone)
    got = suffix_dedup.dedup(frame(spark, rows), with_text=False).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.kept_sha256): r.n_removed for r in got} == want
    first = {r.n_removed for r in substring_dedup.dedup(frame(spark, rows)).collect() if r.doc_id == -(1 << 63)}
    later = {r.n_removed for r in substring_dedup.dedup(frame(spark, rows)).collect() if r.doc_id in (None, 5, 6, 1 << 42, (1 << 63) - 1)}
    assert first == {0} and later == {60}


def test_places_grow_with_id_and_hash(spark):
    rows = rows_of_ids(random.Random(9))
    placed, shift, ids = repeats.places(frame(spark, rows))
    got = {(r.id, r.text): (r.place, r.many) for r in ids.collect()}
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest())
    order = sorted(set(rows), key=key)
    assert [got[r][0] for r in order] == sorted({p for p, _ in got.values()}) and placed.count() == len(order)
    assert all(got[r][1] == rows.count(r) for r in order)
    assert all((got[a][0] >> shift == got[b][0] >> shift) == (a[0] == b[0]) for a in order for b in order)
