"""Operator 8: removal of words in 50-word windows of earlier documents, found by relative Lempel-Ziv parsing."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, through, word_ranges
from .repeats import covered, find_repeats, over_texts, places, with_ids, with_texts

WINDOW, GRAM = 50, 14


class Reference:
    """Indexed reference blocks (lists of words): where each run of ``window`` words starts."""

    def __init__(self, window: int) -> None:
        self.window, self.blocks, self.index = window, [], {}

    def add(self, words: list[bytes], runs: list[bytes]) -> None:
        number = len(self.blocks)
        self.blocks.append(words)
        for i, run in enumerate(runs):
            self.index.setdefault(run, (number, i))

    def factors(self, words: list[bytes], runs: list[bytes]) -> list[tuple[int, int]]:
        """Starts and numbers of words of the factors of at least ``window`` words, parsed greedily from the left.

        Each factor is extended as far as its block goes on alike.  The runs over a factor's end are looked up too, so
        that no run that occurs in a block is missed because the parse cut it in two.
        """
        out, i = [], 0
        while i < len(runs):
            hit = self.index.get(runs[i])
            if hit is None:
                i += 1
                continue
            block, j = self.blocks[hit[0]], hit[1]
            n = self.window
            while i + n < len(words) and j + n < len(block) and words[i + n] == block[j + n]:
                n += 1
            out.append((i, n))
            i += n - self.window + 1
        return out


def repeated_windows(shift: int):
    def run(key, doc, start, count, size, body: bytes):
        """(doc, start, count) of the windows of each slice that lie in factors relative to slices of smaller ids."""
        out = []
        ends = np.cumsum(size.astype(np.int64))
        order = np.lexsort((start, doc, key))
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and key[order[j]] == key[order[i]]:
                j += 1
            reference, waiting, last = Reference(WINDOW), [], None
            for e in order[i:j].tolist():
                ident = int(doc[e]) >> shift
                if ident != last:
                    for block in waiting:
                        reference.add(*block)
                    waiting, last = [], ident
                text = body[ends[e] - size[e] : ends[e]]
                words = text.split(b" ")
                at = np.cumsum([0, *[len(w) + 1 for w in words]]).tolist()
                runs = [text[at[a] : at[a + WINDOW] - 1] for a in range(int(count[e]))]
                for a, n in reference.factors(words, runs):
                    out.append((int(doc[e]), int(start[e]) + a, n - WINDOW + 1))
                waiting.append((words, runs))
            i = j
        found = np.array(out, np.int64).reshape(-1, 3)
        return found[:, 0].copy(), found[:, 1].copy(), found[:, 2].copy()

    return run


def dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked, kept: the words left of each text, joined by spaces.

    A word goes if a window of WINDOW words over it also starts in a document of smaller id.  Null texts have no words;
    texts of fewer words than WINDOW stay whole.  Rows of one id never count as earlier than each other; null ids come
    last.  Other columns are ignored.
    """
    placed, shift, ids = places(docs)
    found, plan = find_repeats(placed, shift, "word", WINDOW, GRAM, False, repeated_windows(shift))
    names = ["place", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * with_text]
    schema = pa.schema(list(zip(names, kinds)))

    def finish(batches):
        some, size = [], 0
        for place, text, starts, counts in over_texts(batches):
            lo, hi = word_ranges(text)
            n = len(lo)
            words = text.tobytes().split()
            if len(words) != n:  # bytes.split() knows the same six separators
                raise AssertionError("words and separators differ")
            if len(starts):
                gone = covered(n, starts, counts, WINDOW)
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            kept = b" ".join(words)
            some.append((place, n, n - len(words), hashlib.sha256(kept).hexdigest(), *[kept.decode()] * with_text))
            size += len(kept) * with_text + 100
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], schema=schema)
                some, size = [], 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], schema=schema)

    out = with_texts(placed, found, plan.buckets).transform(through, finish, "place long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
    return with_ids(out, ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), with_text=False)
