"""Text analysis: tokenizers and filters, chains by field type, and Arrow functions that run them over columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import stemming

STOPWORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
_FOLDS = str.maketrans({"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ẞ": "SS"})


@dataclass(frozen=True)
class Token:
    """A term with its place in the stream and, in characters, in the text."""

    term: str
    pos: int
    start: int
    end: int
    length: int = 1


# ---------------------------------------------------------------- tokenizers


def word_segments(text: str) -> list[Token]:
    """Unicode word-boundary segments, without those of white space or punctuation alone."""
    import regex

    out = []
    cuts = [m.start() for m in regex.finditer(r"(?w)\b", text)]
    cuts = sorted({0, *cuts, len(text)})
    for a, b in zip(cuts, cuts[1:]):
        part = text[a:b]
        if any(unicodedata.category(c)[0] in "LNS" or unicodedata.category(c) == "So" for c in part):
            out.append(Token(part, len(out), a, b))
    return out


def simple_words(text: str) -> list[Token]:
    return [Token(m[0], i, m.start(), m.end()) for i, m in enumerate(re.finditer(r"[^\W_]+", text))]


def space_words(text: str) -> list[Token]:
    return [Token(m[0], i, m.start(), m.end()) for i, m in enumerate(re.finditer(r"\S+", text))]


# ---------------------------------------------------------------- filters


def fold(text: str) -> str:
    """Without accents, and with plain letters for some that have none to drop."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn").translate(_FOLDS)


def lower(text: str) -> str:
    """Sign by sign, each by the first sign of its small form."""
    return "".join(c.lower()[:1] or c for c in text)


def delimit(tokens: list[Token]) -> list[Token]:
    """Parts of a word at case changes, digits and other signs; also the word itself, and its parts joined."""
    out, shift = [], 0
    for t in tokens:
        parts = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+|\d+", t.term)]
        cut = []
        for a, b in parts:
            piece, at = t.term[a:b], a
            for m in re.finditer(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])", piece):
                cut.append((at, a + m.start()))
                at = a + m.start()
            cut.append((at, b))
        if not cut or (len(cut) == 1 and cut[0] == (0, len(t.term))):
            out.append(Token(t.term, t.pos + shift, t.start, t.end))
            continue
        n = len(cut)
        base = t.pos + shift
        out.append(Token(t.term, base, t.start, t.end, n))
        joined = "".join(t.term[a:b] for a, b in cut)
        if n > 1 and joined != t.term:
            out.append(Token(joined, base, t.start, t.end, n))
        for k, (a, b) in enumerate(cut):
            if t.term[a:b] != t.term:
                out.append(Token(t.term[a:b], base + k, t.start + a, t.start + b))
        shift += n - 1
    seen, kept = set(), []
    for t in out:
        if (t.term, t.pos) not in seen:
            seen.add((t.term, t.pos))
            kept.append(t)
    return kept


def each(change: Callable[[str], str]) -> Callable[[list[Token]], list[Token]]:
    return lambda tokens: [Token(x, t.pos, t.start, t.end, t.length) for t in tokens if (x := change(t.term))]


def keep(test: Callable[[str], bool]) -> Callable[[list[Token]], list[Token]]:
    return lambda tokens: [t for t in tokens if test(t.term)]


def final_y(term: str) -> str:
    return term[:-1] + "i" if term.isascii() and len(term) > 1 and term.endswith("y") and re.search("[aeiou]", term[:-1]) else term


@dataclass(frozen=True)
class Chain:
    name: str
    tokenizer: Callable[[str], list[Token]]
    filters: tuple[Callable[[list[Token]], list[Token]], ...] = ()

    def __call__(self, text: str | None) -> list[Token]:
        if not text:
            return []
        tokens = self.tokenizer(text)
        for f in self.filters:
            tokens = f(tokens)
        return tokens


def payload_of(token: str) -> tuple[str, float | None]:
    """Term and number of ``term|number``, parted at the last bar; no number if it isn't finite."""
    head, bar, tail = token.rpartition("|")
    try:
        number = float(tail) if bar else None
    except ValueError:
        number = None
    if number is None or number in (float("inf"), float("-inf")) or number != number:
        return token, None
    return head, number


_long = keep(lambda t: 1 <= len(t) <= 32766)
_short = keep(lambda t: len(t.encode()) < 40)
_folded, _lowered = each(fold), each(lower)
_stopped = keep(lambda t: t not in STOPWORDS)

CHAINS: dict[str, Chain] = {
    "simple": Chain("simple", simple_words, (_short, _lowered)),
    "text_general": Chain("text_general", word_segments, (_folded, delimit, _long, _lowered)),
    "text_en": Chain("text_en", word_segments, (_folded, _long, _lowered, _stopped, delimit, each(final_y), each(stemming.english))),
    "dynamic": Chain("dynamic", word_segments, (_folded, keep(lambda t: 1 <= len(t) <= 100), _lowered, _stopped, delimit, each(stemming.english))),
    "payload": Chain("payload", space_words, (each(lambda t: payload_of(t)[0]),)),
}
LANGUAGES = ("ar", "da", "de", "el", "en", "es", "fi", "fr", "hu", "it", "nl", "no", "pt", "ro", "ru", "sv", "ta", "tr")
for _code in LANGUAGES:
    CHAINS.setdefault(f"text_{_code}", Chain(f"text_{_code}", word_segments, (_folded, delimit, _short, _lowered, each(stemming.stemmer(_code)))))


def custom_chain(name: str, filters: list[str], language: str = "en") -> Chain:
    """A chain of the simple tokenizer, the 40-byte cut and the named filters in their order."""
    known = {"lowercase": _lowered, "stopwords": _stopped if language == "en" else keep(lambda t: True), "stemmer": each(stemming.stemmer(language))}
    return Chain(name, simple_words, (_short, *(known[f] for f in filters)))


def with_synonyms(tokens: list[Token], groups: list[list[str]]) -> list[Token]:
    """Each token that a group names, followed by the group's other members at the same place."""
    out = []
    for t in tokens:
        out.append(t)
        for g in groups:
            if t.term in g:
                out += [Token(s, t.pos, t.start, t.end, t.length) for s in g if s != t.term]
    return out


TOKENS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("pos", T.IntegerType())]))


def tokens_column(values: Column, chain: Chain) -> Column:
    """Analyzed tokens of an array of texts; each value starts after the last, so that no phrase spans two values."""

    @F.pandas_udf(TOKENS)
    def run(column: pd.Series) -> pd.Series:
        out = []
        for texts in column:
            found, base = [], 0
            for text in texts if texts is not None else ():
                some = chain(text)
                found += [{"term": t.term, "pos": base + t.pos} for t in some]
                base = max((f["pos"] for f in found), default=base - 2) + 2
            out.append(found if texts is not None else None)
        return pd.Series(out, dtype=object)

    return run(values)


def simple_tokens(text: Column) -> Column:
    """Small letters and digits in runs, inside the JVM: the index of plain tables needs no Python."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def arrow_tokens(chain: Chain) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (doc, texts): (doc, term, pos) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, terms, places = [], [], []
            for doc, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = 0
                for text in texts or ():
                    some = chain(text)
                    docs += [doc] * len(some)
                    terms += [t.term for t in some]
                    places += [base + t.pos for t in some]
                    base = max((base + t.pos for t in some), default=base - 2) + 2
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(terms, pa.string()), pa.array(places, pa.int32())], ["doc_ord", "term", "pos"])

    return run
