"""Operator 7: byte-level BPE by prefix dynamic programming, and decoding.

For every prefix of a byte string there is exactly one token that its encoding can end with.  With those of all prefixes
stored, appending a byte takes one step, and after an edit only the prefixes near it are done again.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import BYTE_CODES, U64, mix64, only, prefix_hash, range_hash, ranges, spans_of, table, through, utf8

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Encodings of long words, and pairs of tokens, that a worker remembers; bytes of text of one vectorised step.
REMEMBERED, STEP_BYTES = 20_000, 1 << 20
#: Longer words are encoded one by one.
WIDE = 48
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        _classes = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        _classes[_WHITE] = SPACE
    return _classes


def split_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte starts of the matches of the usual GPT-2 pattern in each of the texts that lie one after the other.

    The pattern: contractions, then letters, numbers or other signs, each with at most one space before, then white
    space, of which the last sign before a word stays alone.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    cp = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    kind = char_classes()[cp]
    n = len(cp)
    begins = np.zeros(n + 1, bool)
    begins[np.searchsorted(at, offsets)] = True
    start = begins[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white space before a word
    before = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~begins[1:n])
    start[before] = True
    start[before[cp[before] == 0x20] + 1] = False
    # contractions
    quote = np.flatnonzero((cp[:-1] == 0x27) & start[:-1] & (kind[1:] == LETTER) & ~begins[1:n])
    if len(quote):
        one = quote[np.isin(cp[quote + 1], [ord(c) for c in "stmd"])]
        padded = np.append(cp, [0, 0])
        nxt, after = padded[quote + 1], padded[quote + 2]
        two = quote[(((nxt == ord("r")) | (nxt == ord("v"))) & (after == ord("e")) | (nxt == ord("l")) & (after == ord("l"))) & ~begins[np.minimum(quote + 2, n)]]
        for where, size in ((one, 2), (two, 3)):
            start[where + 1] = False
            rest = where + size
            rest = rest[rest < n]
            start[rest[kind[rest] == LETTER]] = True
    return at[start]


_LETTERS = np.zeros(256, bool)
_LETTERS[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True


def cuts(data: np.ndarray, step: int) -> list[tuple[int, int]]:
    """Ranges of about ``step`` bytes of one text, cut before a space between two letters, where a match always begins."""
    out, lo = [], 0
    while len(data) - lo > step:
        at, reach = lo + step // 2, step
        while True:
            w = data[at : lo + reach]
            found = np.flatnonzero((w[1:-1] == 0x20) & _LETTERS[w[:-2]] & _LETTERS[w[2:]])
            if len(found) or lo + reach >= len(data):
                break
            at, reach = lo + reach - 2, 2 * reach
        if not len(found):
            break
        cut = at + int(found[-1] if reach == step else found[0]) + 1
        out.append((lo, cut))
        lo = cut
    return [*out, (lo, len(data))]


def tail(a, b, c):
    """A place for three bytes."""
    return (a * 1549 ^ b * 257 << 2 ^ c * 5) & 0x3FFFF


class Table:
    """Hashes with their values, looked up many at a time; each hash lies in one of two places (cuckoo hashing)."""

    BITS = 19

    def __init__(self, hashes: np.ndarray, values: np.ndarray) -> None:
        size, mask = 1 << self.BITS, (1 << self.BITS) - 1
        slots = [-1] * size
        keys = hashes.tolist()
        for i in range(len(keys)):
            at, place = i, keys[i] & mask
            while slots[place] >= 0:
                slots[place], at = at, slots[place]
                one, two = keys[at] & mask, keys[at] >> 40 & mask
                place = two if place == one else one
            slots[place] = at
        slot = np.array(slots)
        self.values = np.append(values, -1)[slot].astype(np.int32)
        self.hashes = np.append(hashes, U64(0))[slot]

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        mask = U64((1 << self.BITS) - 1)
        one = (hashes & mask).astype(np.int64)
        two = (hashes >> U64(40) & mask).astype(np.int64)
        found = np.where(self.hashes[one] == hashes, self.values[one], -1)
        return np.where(self.hashes[two] == hashes, self.values[two], found).astype(np.int64)


class Vocabulary:
    """Ranks of a byte-level BPE whose ids are in the order of the merges."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.ids.values()) + 1
        self.tokens = [b""] * size
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.longest = max(map(len, self.tokens))
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(np.append(0, self.lengths))[:-1]
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[int, bool] = {}
        self.words: dict[bytes, tuple[int, ...]] = {}
        self.known_marks, self.known_ids = np.zeros(0, U64), np.zeros(0, np.uint32)
        self.known_at, self.known_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        get = self.ids.get
        for i, token in enumerate(self.tokens):
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None and a < i and b < i and self.follows(a, b):
                    self.left[i], self.right[i] = a, b
                    self.merged[a, b] = i
                    break
        self.fits.clear()
        known = np.array(sorted(self.ids.values()), np.int64)
        ends = self.starts + self.lengths
        self.by_hash = Table(range_hash(prefix_hash(BYTE_CODES[self.bytes]), self.starts[known], ends[known]), known)
        pairs = np.array([a << 32 | b for a, b in self.merged], U64)
        self.by_pair = Table(mix64(pairs), np.fromiter(self.merged.values(), np.int64, len(pairs)))
        self.tails = np.full(1 << 18, 0b110, U64)  # lengths of tokens (bits) by their last three bytes
        for token in self.tokens:
            if 2 < len(token) <= WIDE:
                self.tails[tail(token[-3], token[-2], token[-1])] |= U64(1 << len(token))
        self.left_of, self.right_of = np.array(self.left), np.array(self.right)

    def follow(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """``follows`` for many pairs at once."""
        out = np.ones(len(first), bool)
        at, limit = np.arange(len(first)), np.full(len(first), len(self.tokens))
        while len(at):
            joined = self.by_pair.get(mix64(first.astype(U64) << U64(32) | second.astype(U64)))
            bad = (joined >= 0) & (joined < limit)
            out[at[bad]] = False
            a, b = self.right_of[first], self.left_of[second]
            whole_a, whole_b = a == first, b == second
            undo_first = ~whole_a & ((first > second) | whole_b)
            limit = np.where(undo_first, first, second + 1)
            go = ~bad & ~(whole_a & whole_b)
            first, second = np.where(undo_first, a, first)[go], np.where(undo_first, second, b)[go]
            at, limit = at[go], limit[go]
        return out

    def encode_many(self, data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of at most WIDE bytes, one after the other, and how many each has.

        The words are taken in alphabetic order, so that a prefix which neighbours share is done once, and all words
        gain a byte together.
        """
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        padded = np.append(data, np.zeros(WIDE + 16, np.uint8))
        view = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
        order = np.lexsort((view[starts + 8], view[starts]))
        s, size = starts[order], sizes[order]
        n, most = len(s), int(size.max())
        last = np.zeros((most + 1, n), np.int32)
        shared = np.zeros(n, bool)
        shared[1:] = True
        number = np.arange(n)
        for end in range(1, most + 1):
            has = size >= end
            sign = padded[s + (end - 1)]
            shared[1:] &= has[1:] & has[:-1] & (sign[1:] == sign[:-1])
            shared &= has
            left = np.flatnonzero(has & ~shared)
            to = s[left] + end
            lengths = self.tails[tail(*(padded[to - i].astype(np.int64) for i in (3, 2, 1)))] if end > 2 else np.full(len(left), 0b110, U64)
            for length in range(min(end, self.longest), 0, -1):
                if not len(left):
                    break
                may = np.flatnonzero(lengths & U64(1 << length))
                if not len(may):
                    continue
                token = self.by_hash.get(range_hash(prefix, to[may] - length, to[may]))
                is_token = token >= 0
                some, token = may[is_token], token[is_token]
                if length < end:
                    fits = self.follow(last[end - length][left[some]], token)
                    some, token = some[fits], token[fits]
                if not len(some):
                    continue
                last[end][left[some]] = token
                rest = np.ones(len(left), bool)
                rest[some] = False
                left, to, lengths = left[rest], to[rest], lengths[rest]
            model = np.maximum.accumulate(np.where(shared, 0, number))
            last[end] = last[end][model]
        back, where, end = [], number, size.copy()
        count = np.zeros(n, np.int64)
        while len(where):
            token = last[end, where]
            back.append((where, token))
            count[where] += 1
            end = end - self.lengths[token]
            go = end > 0
            where, end = where[go], end[go]
        counts = np.zeros(n, np.int64)
        counts[order] = count
        at = np.cumsum(counts)
        flat = np.zeros(int(at[-1]), np.uint32)
        place = at[order] - 1
        for where, token in back:
            flat[place[where]] = token
            place[where] -= 1
        return flat, counts

    def follows(self, first: int, second: int) -> bool:
        """Whether BPE leaves this pair of tokens as it is when it encodes their bytes together.

        The merges that made the two are undone, the latest first; if a pair over the border could have merged before
        the merge undone last, BPE would have taken that.
        """
        limit = len(self.tokens)
        while True:
            joined = self.merged.get((first, second))
            if joined is not None and joined < limit:
                return False
            a, b = self.right[first], self.left[second]
            whole_a, whole_b = a == first, b == second
            if whole_a and whole_b:
                return True
            if not whole_a and (first > second or whole_b):
                limit, first = first, a
            else:
                limit, second = second + 1, b

    def last_tokens(self, text: bytes, last: list[int]) -> list[int]:
        """Extend ``last``, the last token of each prefix done so far, to all prefixes of ``text``."""
        ids, fits, longest = self.ids.get, self.fits, self.longest
        for end in range(len(last) + 1, len(text) + 1):
            for begin in range(max(0, end - longest), end):
                token = ids(text[begin:end])
                if token is None:
                    continue
                if begin:
                    pair = last[begin - 1] << 20 | token
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) > 10 * REMEMBERED:
                            fits.clear()
                        ok = fits[pair] = self.follows(last[begin - 1], token)
                    if not ok:
                        continue
                last.append(token)
                break
        return last

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        known = self.words.get(word)
        if known is not None:
            return known
        whole = self.ids.get(word)
        if whole is not None:
            found = (whole,)
        else:
            last, out, end = self.last_tokens(word, []), [], len(word)
            while end:
                out.append(last[end - 1])
                end -= len(self.tokens[out[-1]])
            found = tuple(reversed(out))
        if len(word) <= 64:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[word] = found
        return found

    def known(self, marks: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``known_ids`` the ids of the words with these (sorted, different) hashes are, and how many; new ones by ``encode``."""
        if len(self.known_marks) > 10 * REMEMBERED:
            self.known_marks, self.known_ids = np.zeros(0, U64), np.zeros(0, np.uint32)
            self.known_at, self.known_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.searchsorted(self.known_marks, marks)
        new = np.ones(len(marks), bool)
        inside = place < len(self.known_marks)
        new[inside] = self.known_marks[place[inside]] != marks[inside]
        flat, counts = encode(new)
        at = len(self.known_ids) + np.cumsum(counts) - counts
        self.known_ids = np.append(self.known_ids, flat)
        self.known_marks, self.known_at, self.known_counts = (np.insert(a, place[new], b) for a, b in ((self.known_marks, marks[new]), (self.known_at, at), (self.known_counts, counts)))
        place = np.searchsorted(self.known_marks, marks)
        return self.known_at[place], self.known_counts[place]

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts that lie one after the other, and the offsets of each text's ids.

        Equal words are encoded once.  They meet by a hash, so the bytes of the result are compared with the text's; if
        they differ, all words are encoded one by one, by their bytes.
        """
        if len(offsets) == 2 and len(data) > 2 * STEP_BYTES:
            parts = [self.encode_texts(data[a:b], np.array([0, b - a]))[0] for a, b in cuts(data, STEP_BYTES)]
            if len(parts) > 1:
                ids = np.concatenate(parts)
                return ids, np.array([0, len(ids)])
        starts = split_words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        sizes = np.append(starts[1:], len(data)) - starts
        short = np.flatnonzero(sizes <= WIDE)
        lo, size = starts[short], sizes[short]
        prefix = prefix_hash(BYTE_CODES[data])
        marks, first, which = np.unique(range_hash(prefix, lo, lo + size), return_index=True, return_inverse=True)
        at, counts = self.known(marks, lambda new: self.encode_many(data, prefix, lo[first[new]], size[first[new]]))
        flat = self.known_ids
        many, place = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        many[short], place[short] = counts[which], at[which]
        alone = np.flatnonzero(sizes > WIDE)
        if len(alone):
            found = [self.encode_word(data[a : a + n].tobytes()) for a, n in zip(starts[alone].tolist(), sizes[alone].tolist())]
            many[alone] = [len(f) for f in found]
            place[alone] = len(flat) + np.cumsum(many[alone]) - many[alone]
            flat = np.append(flat, np.fromiter((i for f in found for i in f), np.uint32))
        ids = flat[ranges(place, many)]
        if not np.array_equal(self.decode(ids), data):
            found = [self.encode_word(data[a : a + n].tobytes()) for a, n in zip(starts.tolist(), sizes.tolist())]
            many, ids = np.array([len(f) for f in found]), np.fromiter((i for f in found for i in f), np.uint32)
        upto = np.append(0, np.cumsum(many))
        return ids, upto[np.searchsorted(starts, offsets)]

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        return self.encode_texts(data, np.array([0, len(data)]))[0].tolist()

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ranges(self.starts[ids], self.lengths[ids])]


class Prefixes:
    """A byte string under edits with the last token of each of its prefixes; encoded as one piece, without the pattern."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b"") -> None:
        self.vocabulary, self.text = vocabulary, text
        self.last = vocabulary.last_tokens(text, [])

    def append(self, more: bytes) -> None:
        self.text += more
        self.vocabulary.last_tokens(self.text, self.last)

    def replace(self, lo: int, hi: int, new: bytes) -> int:
        """Put ``new`` in place of text[lo:hi]; the number of prefixes that had to be done again.

        Once as many prefixes in a row as the longest token has bytes end as before, all later ones do too.
        """
        old_last, moved = self.last, len(new) - (hi - lo)
        self.text = self.text[:lo] + new + self.text[hi:]
        last, alike, end = old_last[:lo], 0, lo
        while end < len(self.text):
            end += 1
            self.vocabulary.last_tokens(self.text[:end] if end - len(last) == 1 and end < 64 else self.text[:end], last)
            if end > lo + len(new):
                alike = alike + 1 if last[-1] == old_last[end - 1 - moved] else 0
                if alike >= self.vocabulary.longest:
                    break
        self.last = last + old_last[end - moved :]
        return end - lo

    def ids(self) -> list[int]:
        out, end = [], len(self.text)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file, read once by each process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows of (doc_id, text): batch, from, to, ids, offsets of each row's ids."""
    words = vocabulary(path)
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for lo, hi in spans_of(offsets, STEP_BYTES):
            ids, at = words.encode_texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield batch, lo, hi, ids, at


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of ints) of each text by the ranks in ``path``; null texts have none."""

    def run(batches):
        for batch, lo, hi, ids, at in encoded(batches, path):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return only(docs, doc_id="long", text="string").transform(through, run, "doc_id long, ids array<int>")


def detokenize(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text (bytes) of each array of ids; null for null."""

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            out = [None if not x.is_valid else words.decode(x.values.to_numpy(zero_copy_only=False)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "text"])

    return only(tokens, doc_id="long", ids="array<int>").transform(through, run, "doc_id long, text binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text encoded and decoded again; null texts are empty.

    Rows are independent: repeated rows repeat, a null doc_id stays null, other columns are ignored.
    """

    def run(batches):
        words = vocabulary(path)
        for batch, lo, hi, ids, at in encoded(batches, path):
            wide, sizes = ids.astype("<u4"), np.append(0, np.cumsum(words.lengths[ids]))
            raw = words.decode(ids)
            cuts = at.tolist()
            pairs = list(zip(cuts[:-1], cuts[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([hashlib.sha256(wide[a:b]).hexdigest() for a, b in pairs]),
                    pa.array([hashlib.sha256(raw[sizes[a] : sizes[b]]).hexdigest() for a, b in pairs]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return only(docs, doc_id="long", text="string").transform(through, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
