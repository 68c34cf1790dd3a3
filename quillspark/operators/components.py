"""Search components: term enumeration, more-like-this, suggestions, spelling and highlighting."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.analysis import STOPWORDS, Chain


def term_counts(docs: DataFrame, terms: Column) -> DataFrame:
    """term, df."""
    return docs.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def enumerate_terms(counts: DataFrame, prefix: str = "", limit: int = 10) -> DataFrame:
    """term, df of the terms with a literal prefix, the most frequent first; a negative limit gives all, 0 none."""
    found = counts.where(F.col("term").startswith(prefix)) if prefix else counts
    found = found.orderBy(F.desc("df"), F.asc("term"))
    return found if limit < 0 else found.limit(limit)


@dataclass(frozen=True)
class MoreLikeThis:
    min_tf: int = 2
    min_df: int = 5
    max_df: int | None = None
    min_length: int = 0
    max_length: int = 0
    max_terms: int = 25
    max_tokens: int = 5000
    boost: bool = False
    stopwords: frozenset[str] = STOPWORDS


def interesting_terms(docs: DataFrame, seed: DataFrame, terms: Column, options: MoreLikeThis = MoreLikeThis()) -> DataFrame:
    """term, tf, df, weight of the seed's best terms by tf * idf; document counts are taken for the seed's terms alone."""
    words = seed.select(F.explode(F.slice(terms, 1, options.max_tokens)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf")).where(F.col("tf") >= options.min_tf)
    if options.min_length:
        words = words.where(F.char_length("term") >= options.min_length)
    if options.max_length:
        words = words.where(F.char_length("term") <= options.max_length)
    if options.stopwords:
        words = words.where(~F.col("term").isin(*sorted(options.stopwords)))
    counts = docs.select(F.explode(F.array_distinct(terms)).alias("term")).join(words, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= options.min_df)
    if options.max_df is not None:
        counts = counts.where(F.col("df") <= options.max_df)
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    weight = F.col("tf") * F.log(1 + (F.greatest(n - F.col("df"), F.lit(0)) + 0.5) / (F.col("df") + 0.5))
    return words.join(counts, "term").withColumn("weight", weight).orderBy(F.desc("weight"), F.asc("term")).limit(options.max_terms)


def more_like(docs: DataFrame, key: str, seed_key: Column, terms: Column, options: MoreLikeThis = MoreLikeThis()) -> DataFrame:
    """key, score of documents other than the seed by the BM25 sum over the seed's best terms, whose table is small by its limit."""
    mined = interesting_terms(docs, docs.where(seed_key), terms, options)
    if options.boost:
        mined = mined.withColumn("factor", F.col("weight") / F.max("weight").over(Window.partitionBy()))
    else:
        mined = mined.withColumn("factor", F.lit(1.0))
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    average = docs.agg(F.avg(F.size(terms)).alias("a")).scalar()
    rest = docs.where(~seed_key).select(F.col(key), F.size(terms).alias("dl"), F.explode(terms).alias("term"))
    hits = rest.join(F.broadcast(mined.select("term", "df", "factor")), "term").groupBy(key, "dl", "term", "df", "factor").agg(F.count(F.lit(1)).alias("tf"))
    one = F.col("factor") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / average))
    return hits.groupBy(key).agg(F.sum(one).alias("score"))


def suggest(docs: DataFrame, tokens: Column, typed: str, order: Column, count: int = 10, tags: Column | None = None, context: str | None = None) -> DataFrame:
    """Documents that have all typed words, the last as a prefix unless white space ends the text; in their order."""
    if count <= 0:
        raise RequestError("count must be positive")
    words = re.findall(r"[^\W_]+", typed.lower())
    if not words:
        return docs.limit(0)
    exact, last = (words, None) if re.search(r"[\W_]$", typed) else (words[:-1], words[-1])
    match = F.lit(True)
    for w in exact:
        match = match & F.array_contains(tokens, w)
    if last:
        match = match & F.exists(tokens, lambda t: t.startswith(last))
    if context and tags is not None:
        match = match & context_filter(tags, context)
    return docs.where(match).orderBy(order).limit(count)


def context_filter(tags: Column, text: str) -> Column:
    """``+a`` and ``+(a b)`` must, ``-a`` must not; of plain ones some must, if none is required."""
    must, some = F.lit(True), []
    required = False
    for sign, group, word in re.findall(r"([+-]?)(?:\(([^)]*)\)|([^\s()]+))", text):
        values = group.split() if group else [word]
        hit = F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(v) for v in values])), F.lit(False))
        if sign == "-":
            must = must & ~hit
        elif sign == "+":
            must, required = must & hit, True
        else:
            some.append(hit)
    if some and not required:
        anyone = some[0]
        for s in some[1:]:
            anyone = anyone | s
        must = must & anyone
    return must


def suggest_highlight(text: str, typed: str) -> str:
    words = re.findall(r"[^\W_]+", typed.lower())
    exact, last = (set(words), None) if re.search(r"[\W_]$", typed) or not words else (set(words[:-1]), words[-1])

    def mark(m: re.Match) -> str:
        low = m[0].lower()
        if low in exact:
            return f"<b>{m[0]}</b>"
        return f"<b>{m[0][: len(last)]}</b>{m[0][len(last) :]}" if last and low.startswith(last) else m[0]

    return re.sub(r"[^\W_]+", mark, text)


def spellcheck(counts: DataFrame, text: str, most: int = 2) -> list[dict]:
    """For each word of the text that isn't in the dictionary: its nearest term, with UTF-16 offsets in the text.

    All words are looked up in one scan of the dictionary; the executors take the distances, and one row a word comes to
    the driver.
    """
    from ..plans.compile import with_distance

    spots = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    words = sorted({w for w, *_ in spots})
    if not words:
        return []
    near = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.levenshtein(F.col("term"), w) <= 2 * most)
    found = counts.select("term", "df", F.explode(near).alias("word")).where(F.abs(F.char_length("term") - F.char_length("word")) <= most)
    rows = with_distance(found, most).groupBy("word").agg(F.min(F.struct("distance", "term", "df")).alias("best")).collect()
    best = {r["word"]: tuple(r["best"]) for r in rows}
    known = {w for w, (d, *_) in best.items() if d == 0}
    utf16 = lambda s: len(s.encode("utf-16-le")) // 2
    return [{"word": w, "start": utf16(text[:a]), "end": utf16(text[:b]), "suggestion": best[w][1], "freq": best[w][2]} for w, a, b in spots if w not in known and w in best]


def collation(text: str, found: list[dict]) -> str:
    raw, out, at = text.encode("utf-16-le"), [], 0
    for f in found:
        out += [raw[2 * at : 2 * f["start"]], f["suggestion"].encode("utf-16-le")]
        at = f["end"]
    return b"".join([*out, raw[2 * at :]]).decode("utf-16-le")


# ---------------------------------------------------------------- highlighting


@dataclass(frozen=True)
class Highlight:
    terms: frozenset[str]
    snippets: int = 1
    size: int = 150
    before: str = "<em>"
    after: str = "</em>"
    escape: bool = False


def fragments(text: str, chain: Chain, options: Highlight) -> list[str]:
    """The best fragments of about ``size`` characters that hold terms; size 0 is the whole text."""
    tokens = chain(text)
    hits = [t for t in tokens if t.term in options.terms]
    if not hits:
        return []
    spots = sorted({(t.start, t.end) for t in hits})

    def render(lo: int, hi: int) -> str:
        out, at = [], lo
        clean = html.escape if options.escape else (lambda s: s)
        for a, b in spots:
            if a >= at and b <= hi:
                out += [clean(text[at:a]), options.before, clean(text[a:b]), options.after]
                at = b
        return "".join([*out, clean(text[at:hi])])

    if options.size <= 0:
        return [render(0, len(text))]
    bounds, lo = [], 0
    ends = sorted({t.end for t in tokens})
    while lo < len(text):
        reach = [e for e in ends if lo < e <= lo + options.size]
        hi = len(text) if lo + options.size >= len(text) else (reach[-1] if reach else lo + options.size)
        bounds.append((lo, hi))
        lo = hi
    scored = []
    for a, b in bounds:
        inside = [t for t in hits if t.start >= a and t.end <= b]
        if inside:
            scored.append((-len({t.term for t in inside}), -len(inside), a, b))
    return [render(a, b).strip() for _, _, a, b in sorted(scored)[: min(options.snippets, 100)]]


def highlight_page(page: DataFrame, key: str, text: str, chain: Chain, options: Highlight) -> DataFrame:
    """key, snippets of the rows of a page; Python runs over the page alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "snippets": [fragments(t, chain, options) if t else [] for t in frame["text"]]})

    return page.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(run, "key string, snippets array<string>")
