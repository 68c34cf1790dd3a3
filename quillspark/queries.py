"""Queries over the shared tables, one or more for each operator, with SQL that gives the same rows.

Points and spans are derived from keys by arithmetic that both sides spell out.  Floats are rounded within the query.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import replace
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import numeric
from .functions.analysis import simple_tokens
from .operators import components, facets, grouping, ordering, stats
from .plans import ast, handlers
from .plans.compile import Index, compile_query, interval_match, payload_score
from .plans.edismax import edismax, minimum
from .plans.grammar import parse_query
from .plans.request import select
from .sources.core import TableCore, copy_fields, delete_keys, delete_where, last_of_each, overwrite, work_folder
from .sources.schema import Schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- documents as an index

_DOCS = Schema.from_dict({
    "unique_key": "doc_id", "default_field": "text",
    "fields": [
        {"name": "doc_id", "type": "string", "stored": True, "fast": True, "required": True},
        {"name": "text", "type": "text_general", "stored": True},
        {"name": "lang", "type": "string", "stored": True, "fast": True},
        {"name": "source", "type": "string", "stored": True, "fast": True},
        {"name": "n_chars", "type": "int", "stored": True, "fast": True},
    ],
})
_PARTS = Schema.from_dict({
    "unique_key": "p_brand", "default_field": "p_name",
    "fields": [
        {"name": "p_brand", "type": "string", "stored": True, "fast": True, "required": True},
        {"name": "p_name", "type": "text_general", "stored": True},
        {"name": "p_type", "type": "text_general", "stored": True},
        {"name": "p_size", "type": "int", "stored": True, "fast": True},
        {"name": "p_retailprice", "type": "float", "stored": True, "fast": True},
    ],
})


def wordless(schema: Schema) -> Schema:
    """The schema without its text fields, for queries that look at no words: a word asked of it is an error."""
    return replace(schema, default_field=None, fields={n: f for n, f in schema.fields.items() if f.kind != "text"})


_DOCS_PLAIN, _PARTS_PLAIN = wordless(_DOCS), wordless(_PARTS)
_INDEXES: dict[tuple, str] = {}
#: Tables of up to so many bytes are spread over all cores before terms are cut; larger ones have enough parts of their own.
SMALL = 64 << 20


def size_of(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def indexed(spark: SparkSession, sf_dir: str, name: str, *columns: str, texts: bool = False) -> DataFrame:
    """The table with the term arrays that the compiler reads, as an index has them: written once in a session, then read.

    Terms are cut inside the JVM, over all cores even where the table is one small file; a large table is not shuffled.
    The texts themselves are in it only if ``texts`` says so: matching and scores read the terms alone.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name, columns, texts)
    if key not in _INDEXES:
        df, wide = read(spark, sf_dir, name), 2 * spark.sparkContext.defaultParallelism
        if size_of(spark, f"{sf_dir}/{name}.parquet") <= SMALL and df.rdd.getNumPartitions() < wide:
            df = df.repartition(wide)
        df = df.withColumns({f"{c}__terms": simple_tokens(F.col(c)) for c in columns})
        path = f"{work_folder(spark)}/index-{name}-{uuid.uuid4().hex}"
        (df if texts else df.drop(*columns)).write.option("compression", "zstd").parquet(path)
        _INDEXES[key] = path
    return spark.read.parquet(_INDEXES[key])


def documents(spark: SparkSession, sf_dir: str, texts: bool = False) -> Index:
    return Index(indexed(spark, sf_dir, "documents", "text", texts=texts), _DOCS)


def plain_documents(spark: SparkSession, sf_dir: str) -> Index:
    """For queries that look at no words: nothing is written, and the scan leaves the texts out."""
    return Index(read(spark, sf_dir, "documents").drop("text"), _DOCS_PLAIN)


def parts(spark: SparkSession, sf_dir: str) -> Index:
    return Index(indexed(spark, sf_dir, "part", "p_name", "p_type"), _PARTS)


def plain_parts(spark: SparkSession, sf_dir: str) -> Index:
    return Index(read(spark, sf_dir, "part").drop("p_name", "p_type"), _PARTS_PLAIN)


def found(index: Index, text: str | ast.Node, *columns: str) -> DataFrame:
    tree = parse_query(text) if isinstance(text, str) else text
    return index.docs.where(compile_query(index, tree).match).select(*columns)


def scored(index: Index, tree: ast.Node, key: str, rows: int = 10) -> DataFrame:
    """The best rows with their scores, rounded; ties by key."""
    c = compile_query(index, tree)
    hits = index.docs.where(c.match).select(key, F.round(c.score, 6).alias("score"))
    return ordering.page(hits, [F.desc("score")], F.asc(key), 0, rows)


_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_NAME = r"regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+')"
_TYPE = r"regexp_extract_all(lower(p_type), '[\p{L}\p{N}]+')"


def _bm25_sql(table: str, key: str, tokens: str, terms: list[str], where: str = "true", rows: int = 10) -> str:
    names = ", ".join(f"'{t}'" for t in terms)
    return f"""
    WITH d AS (SELECT *, {tokens} AS tok FROM {table}),
    s AS (SELECT count(*) AS n, avg(len(tok)) AS a FROM d WHERE len(tok) > 0),
    t AS (SELECT {key} AS k, len(tok) AS dl, unnest(tok) AS term FROM d WHERE {where}),
    g AS (SELECT k, dl, term, count(*) AS tf FROM t WHERE term IN ({names}) GROUP BY k, dl, term),
    f AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT {key}, unnest(tok) AS term FROM d) WHERE term IN ({names}) GROUP BY term)
    SELECT k AS {key}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score
    FROM g JOIN f USING (term), s GROUP BY k ORDER BY score DESC, k LIMIT {rows}"""


@query("p01_match_all", "SELECT count(*) AS n FROM documents")
def p01(spark, sf_dir):
    index = plain_documents(spark, sf_dir)
    return found(index, "*:*", "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("p02_no_query", "SELECT doc_id FROM documents WHERE false")
def p02(spark, sf_dir):
    return found(plain_documents(spark, sf_dir), ast.MatchNone(), "doc_id")


@query("p03_term", f"SELECT doc_id FROM documents WHERE list_contains({_TOK}, 'license')")
def p03(spark, sf_dir):
    return found(documents(spark, sf_dir), "license", "doc_id")


@query("p03_term_string", "SELECT doc_id FROM documents WHERE lang = 'fr'")
def p03s(spark, sf_dir):
    return found(plain_documents(spark, sf_dir), "lang:fr", "doc_id")


_PAIRS = f"(SELECT doc_id, list_zip({_TOK}, {_TOK}[2:]) AS pairs, {_TOK} AS tok FROM documents)"


@query("p04_phrase", f"SELECT doc_id FROM {_PAIRS} WHERE len(list_filter(pairs, lambda p: p[1] = 'apache' AND p[2] = 'license')) > 0")
def p04(spark, sf_dir):
    return found(documents(spark, sf_dir), '"apache license"', "doc_id")


@query("p05_phrase_slop", f"""
SELECT doc_id FROM (SELECT doc_id, {_TOK} AS tok FROM documents)
WHERE len(list_filter(range(1, len(tok) + 1), lambda i: tok[i] = 'licensed' AND (tok[i + 1] = 'apache' OR tok[i + 2] = 'apache' OR tok[i + 3] = 'apache'
  OR (i > 1 AND tok[greatest(i - 1, 1)] = 'apache')))) > 0""")
def p05(spark, sf_dir):
    return found(documents(spark, sf_dir), '"licensed apache"~2', "doc_id")


@query("p06_bool", f"SELECT doc_id FROM documents WHERE list_contains({_TOK}, 'the') AND NOT list_contains({_TOK}, 'and') AND (lang = 'en' OR source = 'src0')")
def p06(spark, sf_dir):
    return found(documents(spark, sf_dir), "+the -and +(lang:en OR source:src0)", "doc_id")


@query("p06_all_negative", f"SELECT doc_id FROM documents WHERE NOT list_contains({_TOK}, 'the') AND lang <> 'fr'")
def p06n(spark, sf_dir):
    return found(documents(spark, sf_dir), "-the -lang:fr", "doc_id")


@query("p06_and_or", f"SELECT doc_id FROM documents WHERE (list_contains({_TOK}, 'the') AND list_contains({_TOK}, 'license')) OR lang = 'es'")
def p06o(spark, sf_dir):
    return found(documents(spark, sf_dir), "the AND license OR lang:es", "doc_id")


@query("p08_fuzzy", f"SELECT p_partkey FROM part WHERE len(list_filter({_NAME}, lambda t: damerau_levenshtein(t, 'rimg') <= 1)) > 0")
def p08(spark, sf_dir):
    return found(parts(spark, sf_dir), "p_name:rimg~1", "p_partkey")


@query("p08_fuzzy_terms", f"""
SELECT term, df FROM (SELECT term, count(*) AS df FROM (SELECT DISTINCT p_partkey, unnest({_NAME}) AS term FROM part) GROUP BY term) WHERE damerau_levenshtein(term, 'gizno') <= 2""")
def p08t(spark, sf_dir):
    from .plans.compile import dictionary, near_terms

    index = parts(spark, sf_dir)
    near = near_terms(dictionary(index, index.field("p_name")), "gizno", 2)
    return spark.createDataFrame([(t, df) for t, _, df in near], "term string, df long")


@query("p09_wildcard", f"SELECT p_partkey FROM part WHERE len(list_filter({_NAME}, lambda t: regexp_full_match(t, 'g.*r'))) > 0")
def p09(spark, sf_dir):
    return found(parts(spark, sf_dir), "p_name:g*r", "p_partkey")


@query("p09_prefix", f"SELECT p_partkey FROM part WHERE len(list_filter({_NAME}, lambda t: starts_with(t, 'wi'))) > 0")
def p09p(spark, sf_dir):
    return found(parts(spark, sf_dir), "p_name:wi*", "p_partkey")


@query("p10_regex", f"SELECT p_partkey FROM part WHERE len(list_filter({_NAME}, lambda t: regexp_full_match(t, '(bolt|g.zmo)'))) > 0")
def p10(spark, sf_dir):
    return found(parts(spark, sf_dir), "p_name:/(bolt|g.zmo)/", "p_partkey")


@query("p11_range_int", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 20")
def p11(spark, sf_dir):
    return found(plain_parts(spark, sf_dir), "p_size:[10 TO 20}", "p_partkey")


@query("p11_range_float", "SELECT p_partkey FROM part WHERE p_retailprice > 950.5")
def p11f(spark, sf_dir):
    return found(plain_parts(spark, sf_dir), "p_retailprice:{950.5 TO *]", "p_partkey")


@query("p11_range_string", "SELECT doc_id FROM documents WHERE source >= 'src1' AND source < 'src2'")
def p11s(spark, sf_dir):
    return found(plain_documents(spark, sf_dir), "source:[src1 TO src2}", "doc_id")


@query("p11_range_date", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-03-31 12:00:00'")
def p11d(spark, sf_dir):
    schema = Schema.from_dict({"unique_key": "o_orderstatus", "fields": [{"name": "o_orderstatus", "type": "string", "required": True}, {"name": "o_orderdate", "type": "date", "fast": True}]})
    orders = read(spark, sf_dir, "orders")
    if dict(orders.dtypes)["o_orderdate"] == "timestamp_ntz":
        orders = orders.withColumn("o_orderdate", F.expr("cast(o_orderdate as timestamp)"))
    return found(Index(orders, schema), "o_orderdate:[1995-01-01T00:00:00Z TO 1995-03-31T12:00:00Z]", "o_orderkey")


@query("p12_exists", "SELECT p_partkey FROM part WHERE p_size IS NOT NULL")
def p12(spark, sf_dir):
    return found(plain_parts(spark, sf_dir), "p_size:*", "p_partkey")


@query("p13_set", "SELECT doc_id FROM documents WHERE lang IN ('de', 'es')")
def p13(spark, sf_dir):
    return found(plain_documents(spark, sf_dir), "lang: IN [de es]", "doc_id")


@query("p14_filters", f"SELECT doc_id FROM documents WHERE list_contains({_TOK}, 'license') AND lang = 'en' AND n_chars >= 1000")
def p14(spark, sf_dir):
    index = documents(spark, sf_dir)
    index.docs = index.docs.where(compile_query(index, parse_query("lang:en")).match).where(compile_query(index, parse_query("n_chars:[1000 TO *]")).match)
    return found(index, "license", "doc_id")


@query("p15_frange", "SELECT p_partkey FROM part WHERE p_size IS NOT NULL AND p_size * 2.0 + 1 >= 21 AND p_size * 2.0 + 1 < 41")
def p15(spark, sf_dir):
    return found(plain_parts(spark, sf_dir), ast.FuncRange("sum(product(p_size,2),1)", 21, 41, True, False), "p_partkey")


@query("p15_frange_missing", "SELECT p_partkey FROM (SELECT p_partkey, nullif(p_size, 7) AS p_size FROM part) WHERE p_size IS NOT NULL AND p_size <= 9")
def p15m(spark, sf_dir):
    index = plain_parts(spark, sf_dir)
    index.docs = index.docs.withColumn("p_size", F.nullif("p_size", F.lit(7)))
    return found(index, ast.FuncRange("p_size", None, 9), "p_partkey")


_LAT, _LON = "CAST((c_custkey * 37) % 170 AS DOUBLE) - 85", "CAST((c_custkey * 73) % 360 AS DOUBLE) - 180"
_HAV = "2 * 6371.0087714 * asin(sqrt(least(1, pow(sin((radians(lat) - radians(40.0)) / 2), 2) + cos(radians(lat)) * cos(radians(40.0)) * pow(sin((radians(lon) - radians(-74.0)) / 2), 2))))"
_POINTS = f"(SELECT c_custkey, c_nationkey, {_LAT} AS lat, {_LON} AS lon FROM customer)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", ((key * 37) % 170).cast("double").__sub__(85).alias("lat"), ((key * 73) % 360).cast("double").__sub__(180).alias("lon"))


@query("p16_geo_circle", f"SELECT c_custkey FROM {_POINTS} WHERE {_HAV} <= 1500")
def p16(spark, sf_dir):
    return points(spark, sf_dir).where(numeric.in_circle(F.col("lat"), F.col("lon"), 40.0, -74.0, 1500)).select("c_custkey")


@query("p17_geo_box", f"SELECT c_custkey FROM {_POINTS} WHERE lat BETWEEN 40 - 1500 / (6371.0087714 * pi() / 180) AND 40 + 1500 / (6371.0087714 * pi() / 180) AND lon BETWEEN -74 - 1500 / (6371.0087714 * pi() / 180 * cos(radians(40.0))) AND -74 + 1500 / (6371.0087714 * pi() / 180 * cos(radians(40.0)))")
def p17(spark, sf_dir):
    return points(spark, sf_dir).where(numeric.in_box(F.col("lat"), F.col("lon"), 40.0, -74.0, 1500)).select("c_custkey")


@query("p18_geo_rectangle", f"SELECT c_custkey FROM {_POINTS} WHERE lat BETWEEN 10 AND 30 AND lon BETWEEN -100 AND 20")
def p18(spark, sf_dir):
    schema = Schema.from_dict({"unique_key": "k", "fields": [{"name": "k", "type": "string", "required": True}, {"name": "loc", "type": "location"}]})
    docs = points(spark, sf_dir).withColumn("loc", F.struct("lat", "lon"))
    return found(Index(docs, schema), ast.Rectangle("loc", 10, -100, 30, 20), "c_custkey")


_SPANS = """(SELECT l_orderkey, list(struct_pack(a := epoch_ms(l_shipdate), b := epoch_ms(l_shipdate) + 864000000)) AS spans FROM lineitem GROUP BY l_orderkey)"""
_FROM, _TO = 796694400000, 801964799999


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten days from each shipment of an order."""
    start = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(start.alias("start_ms"), (start + 864000000).alias("end_ms"))).alias("spans"))


@query("p19_interval_intersects", f"SELECT l_orderkey FROM {_SPANS} WHERE len(list_filter(spans, lambda s: s.a <= {_TO} AND s.b >= {_FROM})) > 0")
def p19i(spark, sf_dir):
    return spans(spark, sf_dir).where(interval_match(F.col("spans"), _FROM, _TO, "intersects")).select("l_orderkey")


@query("p19_interval_within", f"SELECT l_orderkey FROM {_SPANS} WHERE len(list_filter(spans, lambda s: s.a >= {_FROM} AND s.b <= {_TO})) = len(spans)")
def p19w(spark, sf_dir):
    return spans(spark, sf_dir).where(interval_match(F.col("spans"), _FROM, _TO, "within")).select("l_orderkey")


@query("p19_interval_contains", f"""
WITH s AS (SELECT l_orderkey, epoch_ms(l_shipdate) AS a, epoch_ms(l_shipdate) + 864000000 AS b FROM lineitem),
m AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM m),
u AS (SELECT l_orderkey, run, min(a) AS a, max(b) AS b FROM r GROUP BY l_orderkey, run)
SELECT DISTINCT l_orderkey FROM u WHERE a <= {_FROM} AND b >= {_FROM + 1036800000}""")
def p19c(spark, sf_dir):
    return spans(spark, sf_dir).where(interval_match(F.col("spans"), _FROM, _FROM + 1036800000, "contains")).select("l_orderkey")


@query("p20_date_math", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-29' AND o_orderdate < TIMESTAMP '1996-05-01'")
def p20(spark, sf_dir):
    from .functions.dates import date_math

    low, high = date_math("1996-01-31T13:00:00Z/DAY+1MONTH"), date_math("1996-03-31T00:00:00Z+1MONTH/MONTH+1MONTH")
    when = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return read(spark, sf_dir, "orders").where((when >= low) & (when < high)).select("o_orderkey")


@query("p21_truncated_dates", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995 AND month(o_orderdate) = 6")
def p21(spark, sf_dir):
    from .functions.dates import interval

    low, high = interval("1995-06")
    return read(spark, sf_dir, "orders").where(F.unix_millis(F.col("o_orderdate").cast("timestamp")).between(low, high)).select("o_orderkey")


# ---------------------------------------------------------------- scores


@query("c01_bm25", _bm25_sql("documents", "doc_id", _TOK, ["license", "version"]))
def c01(spark, sf_dir):
    return scored(documents(spark, sf_dir), parse_query("license version"), "doc_id")


@query("c01_bm25_filtered", _bm25_sql("documents", "doc_id", _TOK, ["the", "ing"], "lang = 'en'"))
def c01f(spark, sf_dir):
    index = documents(spark, sf_dir)
    c = compile_query(index, parse_query("the ing"))
    hits = index.docs.where("lang = 'en'").where(c.match).select("doc_id", F.round(c.score, 6).alias("score"))
    return ordering.page(hits, [F.desc("score")], F.asc("doc_id"))


def _field_sql(name: str, tokens: str, term: str) -> str:
    return f"""{name} AS (SELECT p_partkey, CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / a)) ELSE 0.0 END AS s
    FROM (SELECT p_partkey, len({tokens}) AS dl, len(list_filter({tokens}, lambda t: t = '{term}')) AS tf FROM part),
    (SELECT count(*) AS n, avg(len({tokens})) AS a, sum(CASE WHEN list_contains({tokens}, '{term}') THEN 1 ELSE 0 END) AS df FROM part WHERE len({tokens}) > 0))"""


@query("c02_dismax", f"""WITH {_field_sql('x', _NAME, 'small')}, {_field_sql('y', _TYPE, 'small')}
SELECT p_partkey, round(greatest(x.s, y.s) + 0.3 * (x.s + y.s - greatest(x.s, y.s)), 6) AS score FROM x JOIN y USING (p_partkey) WHERE x.s + y.s > 0 ORDER BY score DESC, p_partkey LIMIT 10""")
def c02(spark, sf_dir):
    index = parts(spark, sf_dir)
    return scored(index, edismax("small", index.schema, qf="p_name p_type", tie=0.3), "p_partkey")


@query("c03_edismax_boost", f"""WITH {_field_sql('y', _NAME, 'ring')}
SELECT p_partkey, round(2 * y.s * (1.0 / (0.1 * p_size + 1)) + p_size * 0.01, 6) AS score FROM y JOIN part USING (p_partkey) WHERE y.s > 0 ORDER BY score DESC, p_partkey LIMIT 10""")
def c03(spark, sf_dir):
    index = parts(spark, sf_dir)
    return scored(index, edismax("ring", index.schema, qf="p_name^2", boost=["recip(p_size,0.1,1,1)"], bf=["product(p_size,0.01)"]), "p_partkey")


_MM = "SELECT p_partkey FROM part WHERE " + " + ".join(f"CASE WHEN list_contains({_NAME}, '{t}') THEN 1 ELSE 0 END" for t in ("small", "red", "ring"))


@query("c04_minimum_match", _MM + " >= 2")
def c04(spark, sf_dir):
    index = parts(spark, sf_dir)
    return found(index, edismax("small red ring", index.schema, qf="p_name", mm="2<-1"), "p_partkey")


@query("c04_minimum_values", "SELECT * FROM (VALUES ('2', 4, 2), ('-1', 4, 3), ('75%', 4, 3), ('-25%', 5, 4), ('2<75%', 2, 2), ('2<75%', 8, 6), ('3<-1 5<80%', 4, 3), ('3<-1 5<80%', 10, 8), ('9', 3, 3)) AS t(spec, n, least)")
def c04v(spark, sf_dir):
    cases = [("2", 4), ("-1", 4), ("75%", 4), ("-25%", 5), ("2<75%", 2), ("2<75%", 8), ("3<-1 5<80%", 4), ("3<-1 5<80%", 10), ("9", 3)]
    return spark.createDataFrame([(s, n, minimum(s, n)) for s, n in cases], "spec string, n int, least int")


@query("c06_boost_query", f"""WITH {_field_sql('x', _NAME, 'ring')}, {_field_sql('y', _NAME, 'red')}
SELECT p_partkey, round(x.s + CASE WHEN y.s > 0 THEN y.s ELSE 0.0 END, 6) AS score FROM x JOIN y USING (p_partkey) WHERE x.s > 0 ORDER BY score DESC, p_partkey LIMIT 10""")
def c06(spark, sf_dir):
    index = parts(spark, sf_dir)
    return scored(index, edismax("ring", index.schema, qf="p_name", bq=["p_name:red"]), "p_partkey")


@query("c08_functions", """SELECT p_partkey, round(p_size + p_retailprice * 2 + greatest(p_size, 10) - 0 + least(p_size, 5.0), 4) AS a,
round(CASE WHEN p_size - 10 = 0 THEN NULL ELSE 3.0 / (p_size - 10) END, 6) AS b FROM part""")
def c08(spark, sf_dir):
    number = lambda n: F.col(n)
    a = numeric.value(numeric.parse_function("sum(p_size,product(p_retailprice,2),max(p_size,10),min(p_size,5))"), number)
    b = numeric.value(numeric.parse_function("recip(p_size,1,3,-10)"), number)
    return read(spark, sf_dir, "part").select("p_partkey", F.round(a, 4).alias("a"), F.round(F.when(F.abs(b) < float("inf"), b), 6).alias("b"))


@query("c09_func_score", "SELECT p_partkey, round(CAST(CAST(p_size * 3 + 1 AS FLOAT) AS DOUBLE), 6) AS score FROM part ORDER BY score DESC, p_partkey LIMIT 10")
def c09(spark, sf_dir):
    return scored(plain_parts(spark, sf_dir), ast.FuncScore("sum(product(p_size,3),1)"), "p_partkey")


@query("c10_boosted", f"WITH {_field_sql('y', _NAME, 'bolt')} SELECT p_partkey, round(y.s * p_size, 6) AS score FROM y JOIN part USING (p_partkey) WHERE y.s > 0 ORDER BY score DESC, p_partkey LIMIT 10")
def c10(spark, sf_dir):
    return scored(parts(spark, sf_dir), ast.FuncBoost(parse_query("p_name:bolt"), "p_size"), "p_partkey")


@query("c11_payload", """SELECT l_orderkey, round(min(l_quantity), 6) AS lo, round(max(l_quantity), 6) AS hi, round(sum(l_quantity), 6) AS total, round(avg(l_quantity), 6) AS mean
FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey""")
def c11(spark, sf_dir):
    paid = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("term"), F.col("l_quantity").alias("payload"))).alias("p"))
    of = {n: payload_score(F.col("p"), "R", f) for n, f in (("lo", "min"), ("hi", "max"), ("total", "sum"), ("mean", "average"))}
    return paid.where(of["lo"].match).select("l_orderkey", *[F.round(c.score, 6).alias(n) for n, c in of.items()])


@query("c12_distance", f"SELECT c_custkey, round({_HAV}, 3) AS km FROM {_POINTS} ORDER BY km, c_custkey LIMIT 20")
def c12(spark, sf_dir):
    hits = points(spark, sf_dir).select("c_custkey", F.round(numeric.distance_km(F.col("lat"), F.col("lon"), 40.0, -74.0), 3).alias("km"))
    return ordering.page(hits, [ordering.function_key(F.col("km"), False)], F.asc("c_custkey"), 0, 20)


@query("c14_max_score", f"WITH {_field_sql('y', _NAME, 'gear')} SELECT count(*) AS n, round(max(s), 6) AS max_score FROM y WHERE s > 0")
def c14(spark, sf_dir):
    index = parts(spark, sf_dir)
    c = compile_query(index, parse_query("p_name:gear"))
    return index.docs.where(c.match).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(c.score), 6).alias("max_score"))


# ---------------------------------------------------------------- facets


@query("f02_terms_zero", """SELECT v.p AS value, count(o.o_orderkey) AS count FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) v
LEFT JOIN orders o ON o.o_orderpriority = v.p AND o.o_totalprice > 400000 AND o.o_orderpriority <> '5-LOW' GROUP BY v.p""")
def f02(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    hits = orders.where("o_totalprice > 400000 and o_orderpriority <> '5-LOW'")
    return facets.terms(hits, F.col("o_orderpriority"), dictionary=orders.select(F.col("o_orderpriority").alias("value")))


@query("f02_terms_multi", f"SELECT term AS value, count(*) AS count FROM (SELECT DISTINCT p_partkey, unnest({_TYPE}) AS term FROM part WHERE p_size < 10) GROUP BY term ORDER BY count DESC, value LIMIT 100")
def f02m(spark, sf_dir):
    return facets.terms(read(spark, sf_dir, "part").where("p_size < 10"), simple_tokens(F.col("p_type")), multi=True)


@query("f03_terms_numeric", "SELECT l_quantity AS value, count(*) AS count FROM lineitem WHERE l_discount >= 0.05 GROUP BY l_quantity ORDER BY value LIMIT 1000")
def f03(spark, sf_dir):
    return facets.terms(read(spark, sf_dir, "lineitem").where("l_discount >= 0.05"), F.col("l_quantity"), limit=-1, sort="index")


@query("f04_multi_select", """SELECT 'all' AS facet, l_returnflag AS value, count(*) AS count FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag
UNION ALL SELECT 'filtered', l_returnflag, count(*) FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R' GROUP BY l_returnflag
UNION ALL SELECT 'status', l_linestatus, count(*) FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R' GROUP BY l_linestatus""")
def f04(spark, sf_dir):
    hits = read(spark, sf_dir, "lineitem").where("l_quantity > 25")
    chosen = F.col("l_returnflag") == "R"
    return facets.several_terms(hits, {"all": F.col("l_returnflag"), "filtered": F.col("l_returnflag"), "status": F.col("l_linestatus")}, {"filtered": chosen, "status": chosen})


@query("f05_limit_mincount", "SELECT c_nationkey AS value, count(*) AS count FROM customer GROUP BY c_nationkey HAVING count(*) >= 3 ORDER BY value LIMIT 7")
def f05(spark, sf_dir):
    return facets.terms(read(spark, sf_dir, "customer"), F.col("c_nationkey"), limit=7, mincount=3, sort="index")


@query("f06_missing", "SELECT sum(CASE WHEN p_size = 7 THEN 1 ELSE 0 END) AS missing FROM part")
def f06(spark, sf_dir):
    return read(spark, sf_dir, "part").agg(facets.missing(F.nullif("p_size", F.lit(7))).alias("missing"))


@query("f07_queries", "SELECT 'cheap' AS facet, sum(CASE WHEN p_retailprice < 1000 THEN 1 ELSE 0 END) AS count FROM part UNION ALL SELECT 'small', sum(CASE WHEN p_size <= 5 THEN 1 ELSE 0 END) FROM part")
def f07(spark, sf_dir):
    return facets.queries(read(spark, sf_dir, "part"), {"cheap": F.col("p_retailprice") < 1000, "small": F.col("p_size") <= 5})


@query("f08_range_number", "SELECT 10 * r AS lower, count(p_partkey) AS count FROM range(0, 6) t(r) LEFT JOIN part ON p_size >= 10 * r AND p_size < 10 * r + 10 GROUP BY r")
def f08(spark, sf_dir):
    return facets.ranges(read(spark, sf_dir, "part"), F.col("p_size"), 0, 55, 10)


@query("f08_range_date", "SELECT 788918400000 + 604800000 * r AS lower, count(o_orderkey) AS count FROM range(0, 14) t(r) LEFT JOIN orders ON epoch_ms(o_orderdate) >= 788918400000 + 604800000 * r AND epoch_ms(o_orderdate) < 788918400000 + 604800000 * (r + 1) GROUP BY r")
def f08d(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return facets.ranges(orders, F.unix_millis(F.col("o_orderdate").cast("timestamp")), 788918400000, 788918400000 + 13 * 604800000 + 1, facets.date_gap_ms("+1WEEK"))


@query("f10_heatmap", f"""SELECT CAST(greatest(ceil((90.0 - lat) / 180 * 32) - 1, 0) AS INTEGER) AS row, CAST(greatest(ceil((lon + 180) / 360 * 32) - 1, 0) AS INTEGER) AS col, count(*) AS count
FROM {_POINTS} GROUP BY 1, 2""")
def f10(spark, sf_dir):
    return facets.heatmap(points(spark, sf_dir), F.col("lat"), F.col("lon"), 2)


@query("f11_json_nested", """WITH b AS (SELECT r_name, n_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT r_name, count(*) AS count, max(c_acctbal) AS best FROM b GROUP BY r_name),
xr AS (SELECT *, row_number() OVER (ORDER BY count DESC, r_name) AS rank FROM x),
y AS (SELECT r_name, n_name, count(*) AS count, max(c_acctbal) AS best FROM b WHERE r_name IN (SELECT r_name FROM xr WHERE rank <= 3) GROUP BY r_name, n_name),
yr AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY count DESC, n_name) AS rank FROM y)
SELECT 0 AS depth, r_name AS region, NULL AS nation, count, CAST(rank AS INTEGER) AS rank, best FROM xr WHERE rank <= 3
UNION ALL SELECT 1, r_name, n_name, count, CAST(rank AS INTEGER), best FROM yr WHERE rank <= 2""")
def f11(spark, sf_dir):
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    rows = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return facets.nested(rows, [("region", F.col("r_name"), 3, "count desc"), ("nation", F.col("n_name"), 2, "count desc")], {"best": F.col("c_acctbal")})


@query("f12_json_max", "SELECT max(p_size) AS size, max(p_retailprice) AS price FROM part WHERE p_brand = 'Brand#13'")
def f12(spark, sf_dir):
    return read(spark, sf_dir, "part").where("p_brand = 'Brand#13'").agg(F.max("p_size").alias("size"), F.max("p_retailprice").alias("price"))


_STAT = "SELECT '{n}' AS field, min({c}) AS min, max({c}) AS max, count({c}) AS count, count(*) - count({c}) AS missing, round(sum({c}), 2) AS sum, round(sum({c} * {c}), 0) AS sumOfSquares, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'"


@query("f13_stats", _STAT.format(n="price", c="CAST(l_extendedprice AS DOUBLE)") + " UNION ALL " + _STAT.format(n="qty", c="CAST(nullif(l_quantity, 7) AS DOUBLE)"))
def f13(spark, sf_dir):
    hits = read(spark, sf_dir, "lineitem").where("l_shipdate < timestamp '1996-01-01'")
    out = stats.field_stats(hits, {"price": F.col("l_extendedprice"), "qty": F.nullif("l_quantity", F.lit(7.0))})
    for name, digits in (("sum", 2), ("sumOfSquares", 0), ("mean", 4), ("stddev", 4)):
        out = out.withColumn(name, F.round(name, digits))
    return out


@query("f14_group_count", "SELECT count(*) AS matches, count(DISTINCT nullif(p_size, 3)) + max(CASE WHEN p_size = 3 THEN 1 ELSE 0 END) AS ngroups FROM part WHERE p_retailprice < 1500")
def f14(spark, sf_dir):
    return grouping.totals(read(spark, sf_dir, "part").where("p_retailprice < 1500"), F.nullif("p_size", F.lit(3)))


@query("f15_group_facet", "SELECT o_orderpriority AS value, count(DISTINCT nullif(o_orderstatus, 'P')) + max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS count FROM orders GROUP BY o_orderpriority")
def f15(spark, sf_dir):
    return facets.terms(read(spark, sf_dir, "orders"), F.col("o_orderpriority"), distinct=F.nullif("o_orderstatus", F.lit("P")))


# ---------------------------------------------------------------- groups


_BEST = "ORDER BY o_totalprice DESC, o_orderkey"


@query("g01_groups", f"""WITH h AS (SELECT o_orderkey, o_custkey AS g, o_totalprice, row_number() OVER (PARTITION BY o_custkey {_BEST}) AS place, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders WHERE o_orderstatus = 'F'),
p AS (SELECT g, row_number() OVER ({_BEST}) AS rank FROM h WHERE place = 1)
SELECT o_orderkey, g AS customer, CAST(rank AS INTEGER) AS group_rank, CAST(place AS INTEGER) AS place, size AS group_size FROM h JOIN p USING (g) WHERE rank > 5 AND rank <= 15 AND place <= 3""")
def g01(spark, sf_dir):
    hits = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")
    out = grouping.grouped(hits, F.col("o_custkey"), [F.desc("o_totalprice"), F.asc("o_orderkey")], limit=3, rows=10, start=5)
    return out.select("o_orderkey", F.col("_group").alias("customer"), F.col("group_rank").cast("int").alias("group_rank"), F.col("place").cast("int").alias("place"), "group_size")


@query("g02_within_order", """WITH h AS (SELECT o_orderkey, o_orderpriority AS g, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS place FROM orders)
SELECT o_orderkey, g AS priority, CAST(place AS INTEGER) AS place FROM h WHERE place > 2 AND place <= 6""")
def g02(spark, sf_dir):
    hits = read(spark, sf_dir, "orders")
    out = grouping.grouped(hits, F.col("o_orderpriority"), [F.desc("o_totalprice"), F.asc("o_orderkey")], [F.asc("o_orderdate"), F.asc("o_orderkey")], limit=4, offset=2)
    return out.select("o_orderkey", F.col("_group").alias("priority"), F.col("place").cast("int").alias("place"))


@query("g04_totals", "SELECT count(*) AS matches, count(DISTINCT o_custkey) AS ngroups FROM orders WHERE o_totalprice > 200000")
def g04(spark, sf_dir):
    return grouping.totals(read(spark, sf_dir, "orders").where("o_totalprice > 200000"), F.col("o_custkey"))


_FIRST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey {_BEST}) AS n FROM orders) WHERE n = 1)"


@query("g05_truncate_facet", f"SELECT o_orderpriority AS value, count(*) AS count FROM {_FIRST} GROUP BY o_orderpriority")
def g05(spark, sf_dir):
    first = grouping.truncated(read(spark, sf_dir, "orders"), F.col("o_custkey"), [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return facets.terms(first, F.col("o_orderpriority"))


@query("g05_truncate_stats", f"SELECT count(o_totalprice) AS count, round(sum(o_totalprice), 2) AS sum, min(o_totalprice) AS min FROM {_FIRST}")
def g05s(spark, sf_dir):
    first = grouping.truncated(read(spark, sf_dir, "orders"), F.col("o_custkey"), [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return stats.field_stats(first, {"x": F.col("o_totalprice")}).select("count", F.round("sum", 2).alias("sum"), "min")


# ---------------------------------------------------------------- order


@query("o02_multi_sort", """WITH g AS (SELECT l_orderkey, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_orderkey)
SELECT * FROM (SELECT 'asc' AS way, l_orderkey FROM g ORDER BY lo, l_orderkey LIMIT 10) UNION ALL SELECT * FROM (SELECT 'desc' AS way, l_orderkey FROM g ORDER BY hi DESC, l_orderkey LIMIT 10)""")
def o02(spark, sf_dir):
    docs = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    pages = [ordering.page(docs, [ordering.number_key(F.col("q"), d, True)], F.asc("l_orderkey")).select(F.lit(w).alias("way"), "l_orderkey") for w, d in (("asc", False), ("desc", True))]
    return pages[0].unionAll(pages[1])


@query("o03_missing_zero", "SELECT p_partkey FROM part ORDER BY coalesce(nullif(p_size, 1), 0), p_partkey LIMIT 30")
def o03z(spark, sf_dir):
    return ordering.page(read(spark, sf_dir, "part").select("p_partkey", F.nullif("p_size", F.lit(1)).alias("s")), [ordering.number_key(F.col("s"), False)], F.asc("p_partkey"), 0, 30).select("p_partkey")


@query("o03_missing_last", "SELECT p_partkey FROM part ORDER BY nullif(p_brand, 'Brand#9') DESC NULLS LAST, p_partkey LIMIT 50")
def o03l(spark, sf_dir):
    return ordering.page(read(spark, sf_dir, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#9")).alias("b")), [ordering.text_key(F.col("b"), True)], F.asc("p_partkey"), 0, 50).select("p_partkey")


@query("o06_paging", "SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 40")
def o06(spark, sf_dir):
    keys = ordering.parse_sort("o_orderpriority asc, o_totalprice desc")
    order = [F.desc(k.name) if k.descending else F.asc(k.name) for k in keys]
    return ordering.page(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), order, F.asc("o_orderkey"), 40, 15).select("o_orderkey")


# ---------------------------------------------------------------- components


@query("m02_more_like_this", f"""WITH d AS (SELECT p_partkey, {_NAME} AS tok FROM part),
w AS (SELECT term, count(*) AS tf FROM (SELECT unnest(tok) AS term FROM d WHERE p_partkey = 7) GROUP BY term),
f AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT p_partkey, unnest(tok) AS term FROM d) WHERE term IN (SELECT term FROM w) GROUP BY term HAVING count(*) >= 5),
s AS (SELECT count(*) AS n, avg(len(tok)) AS a FROM d),
t AS (SELECT p_partkey, len(tok) AS dl, unnest(tok) AS term FROM d WHERE p_partkey <> 7),
g AS (SELECT p_partkey, dl, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM f) GROUP BY p_partkey, dl, term)
SELECT p_partkey, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM g JOIN f USING (term), s GROUP BY p_partkey ORDER BY score DESC, p_partkey LIMIT 20""")
def m02(spark, sf_dir):
    docs = read(spark, sf_dir, "part")
    like = components.more_like(docs, "p_partkey", F.col("p_partkey") == 7, simple_tokens(F.col("p_name")), components.MoreLikeThis(min_tf=1, stopwords=frozenset()))
    return ordering.page(like.select("p_partkey", F.round("score", 6).alias("score")), [F.desc("score")], F.asc("p_partkey"), 0, 20)


@query("m03_terms", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOK}) AS term FROM documents) WHERE starts_with(term, 'th') GROUP BY term ORDER BY df DESC, term LIMIT 25")
def m03(spark, sf_dir):
    counts = components.term_counts(documents(spark, sf_dir).docs, F.col("text__terms"))
    return components.enumerate_terms(counts, "th", 25)


@query("m04_suggest", f"SELECT p_partkey, p_name FROM part WHERE list_contains({_NAME}, 'red') AND len(list_filter({_NAME}, lambda t: starts_with(t, 'wi'))) > 0 ORDER BY p_partkey LIMIT 10")
def m04(spark, sf_dir):
    return components.suggest(read(spark, sf_dir, "part"), simple_tokens(F.col("p_name")), "Red Wi", F.asc("p_partkey")).select("p_partkey", "p_name")


@query("m05_suggest_context", f"SELECT p_partkey FROM part WHERE len(list_filter({_NAME}, lambda t: starts_with(t, 'gi'))) > 0 AND p_brand IN ('Brand#11', 'Brand#12') AND p_size <> 9 ORDER BY p_partkey LIMIT 10")
def m05(spark, sf_dir):
    tags = F.array("p_brand", F.col("p_size").cast("string"))
    return components.suggest(read(spark, sf_dir, "part"), simple_tokens(F.col("p_name")), "gi", F.asc("p_partkey"), tags=tags, context="+(Brand#11 Brand#12) -9").select("p_partkey")


@query("m08_spellcheck")
def m08(spark, sf_dir):
    counts = components.term_counts(read(spark, sf_dir, "part"), simple_tokens(F.col("p_name")))
    rows = components.spellcheck(counts, "smal rign gizmo")
    return spark.createDataFrame([(r["word"], r["start"], r["end"], r["suggestion"], r["freq"]) for r in rows], "word string, start int, end int, suggestion string, freq long")


@query("h01_highlight")
def h01(spark, sf_dir):
    from .functions.analysis import CHAINS

    index = documents(spark, sf_dir, texts=True)
    page = ordering.page(found(index, "license", "doc_id", "text"), [], F.asc("doc_id"))
    return components.highlight_page(page, "doc_id", "text", CHAINS["text_general"], components.Highlight(frozenset(["license"])))


@query("h05_highlight_string", "SELECT doc_id, CASE WHEN lang IN ('fr', 'de') THEN '<em>' || lang || '</em>' END AS lang FROM documents")
def h05(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang").isin("fr", "de"), F.concat(F.lit("<em>"), "lang", F.lit("</em>"))).alias("lang"))


# ---------------------------------------------------------------- writes


@query("s05_delete_keys", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def s05(spark, sf_dir):
    keys = read(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return delete_keys(read(spark, sf_dir, "orders"), keys, "o_orderkey").select("o_orderkey")


@query("s06_delete_query", f"SELECT doc_id FROM documents WHERE NOT (list_contains({_TOK}, 'license') OR lang = 'es')")
def s06(spark, sf_dir):
    index = documents(spark, sf_dir)
    return delete_where(index.docs, compile_query(index, parse_query("license lang:es")).match).select("doc_id")


@query("s07_overwrite", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def s07(spark, sf_dir):
    old = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return overwrite(old, old.where("c_custkey % 5 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), "c_custkey")


@query("s10_stored_fields", "SELECT doc_id, lang, n_chars FROM documents")
def s10(spark, sf_dir):
    from .sources.core import stored

    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", *[f.name for f in stored(_DOCS, docs.columns, "lang,n_*") if f.name != "doc_id"])


@query("s26_copy_fields", "SELECT p_partkey, [p_name, p_type] AS everything FROM part")
def s26(spark, sf_dir):
    return copy_fields(read(spark, sf_dir, "part"), [("p_name", "everything"), ("p_type", "everything")]).select("p_partkey", "everything")


@query("s28_versions", "SELECT p_partkey, CAST(1000 + row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS version FROM part")
def s28(spark, sf_dir):
    """Consecutive numbers in key order: counts of ranges of keys first, so that no task numbers all rows."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 512).alias("slice"))
    before = rows.groupBy("slice").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("slice", "before")
    n = F.row_number().over(Window.partitionBy("slice").orderBy("p_partkey"))
    return rows.join(before, "slice").select("p_partkey", (F.lit(1000) + F.col("before") + n).cast("long").alias("version"))


@query("t03_last_write_wins", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def t03(spark, sf_dir):
    return last_of_each(read(spark, sf_dir, "events"), "user_id", F.struct("ts", "event_id").desc()).select("user_id", "event_id", "value")


@query("t01_stream_upsert", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events) WHERE n = 1")
def t01(spark, sf_dir):
    from .streaming.upsert import Table, upsert_stream

    folder = f"{work_folder(spark)}/upsert-{uuid.uuid4().hex}".removeprefix("file://")
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(read(spark, sf_dir, "events").schema)
    source = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    table = Table(f"{folder}/table", "user_id", "ts")
    upsert_stream(source, table, f"{folder}/state").awaitTermination()
    return table.read(spark).select("user_id", "event_id")


# ---------------------------------------------------------------- extraction


@query("s14_html")
def s14(spark, sf_dir):
    from .sources.extraction import extract_html

    return extract_html(read(spark, sf_dir, "pages"), "page_id", "html")


@query("a01_info", "SELECT count(*) AS docs, sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS missing FROM documents")
def a01(spark, sf_dir):
    return read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("text").isNull()).alias("missing"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scored words, a filter, and the ten best documents."""
    return c01f(spark, sf_dir)



# ---------------------------------------------------------------- whole requests


def view(spark: SparkSession, sf_dir: str, texts: bool = False) -> TableCore:
    docs = documents(spark, sf_dir, texts).docs
    return TableCore(_DOCS, docs.withColumn("doc_ord", F.col("doc_id").cast("long")))


def plain_view(spark: SparkSession, sf_dir: str) -> TableCore:
    """For requests that look at no words."""
    docs = plain_documents(spark, sf_dir).docs
    return TableCore(_DOCS_PLAIN, docs.withColumn("doc_ord", F.col("doc_id").cast("long")))


def listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of one answer, which its page and its limits bound."""
    return spark.createDataFrame(rows, schema)


@query("rq_page", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, n_chars, (SELECT count(*) FROM documents WHERE list_contains({_TOK}, 'license') AND lang = 'en') AS found FROM documents WHERE list_contains({_TOK}, 'license') AND lang = 'en' ORDER BY n_chars DESC, documents.doc_id LIMIT 7 OFFSET 3")
def rq_page(spark, sf_dir):
    r = select(view(spark, sf_dir), {"q": "license", "fq": "lang:en", "sort": "n_chars desc", "start": 3, "rows": 7, "fl": "doc_id,n_chars"})["response"]
    return listed(spark, [(str(d["doc_id"]), d["n_chars"], r["numFound"]) for d in r["docs"]], "doc_id string, n_chars long, found long")


@query("rq_facet_fields", f"""WITH d AS (SELECT * FROM documents WHERE list_contains({_TOK}, 'the'))
SELECT 'lang' AS field, lang AS value, count(*) AS count FROM d WHERE lang IS NOT NULL GROUP BY lang
UNION ALL (SELECT 'source', source, count(*) FROM d WHERE source IS NOT NULL GROUP BY source ORDER BY count(*) DESC, source LIMIT 5)""")
def rq_facet_fields(spark, sf_dir):
    p = {"q": "the", "rows": 0, "facet": "true", "facet.field": ["lang", "source"], "facet.mincount": 1, "f.source.facet.limit": 5, "json.nl": "arrarr"}
    found = select(view(spark, sf_dir), p)["facet_counts"]["facet_fields"]
    return listed(spark, [(f, v, n) for f, entries in found.items() for v, n in entries], "field string, value string, count long")


@query("rq_multi_select", """SELECT 'all' AS facet, lang AS value, count(*) AS count FROM documents WHERE n_chars >= 500 GROUP BY lang HAVING lang IS NOT NULL
UNION ALL SELECT 'shown', source, count(*) FROM documents WHERE n_chars >= 500 AND lang = 'en' AND source IS NOT NULL GROUP BY source""")
def rq_multi_select(spark, sf_dir):
    p = {"q": "*:*", "fq": ["n_chars:[500 TO *]", "{!tag=l}lang:en"], "rows": 0, "facet": "true", "facet.field": ["{!ex=l key=all}lang", "{!key=shown}source"], "facet.mincount": 1, "facet.limit": -1, "json.nl": "arrarr"}
    found = select(plain_view(spark, sf_dir), p)["facet_counts"]["facet_fields"]
    return listed(spark, [(f, v, n) for f, entries in found.items() for v, n in entries], "facet string, value string, count long")


@query("rq_facet_query", f"SELECT (SELECT count(*) FROM documents WHERE lang = 'en' AND list_contains({_TOK}, 'license')) AS words, (SELECT count(*) FROM documents WHERE lang = 'en' AND n_chars BETWEEN 100 AND 900) AS sizes")
def rq_facet_query(spark, sf_dir):
    p = {"q": "lang:en", "rows": 0, "facet": "true", "facet.query": ["text:license", "n_chars:[100 TO 900]"]}
    found = select(view(spark, sf_dir), p)["facet_counts"]["facet_queries"]
    return listed(spark, [(found["text:license"], found["n_chars:[100 TO 900]"])], "words long, sizes long")


@query("rq_facet_range", """SELECT CAST(CAST(g.lower AS INTEGER) AS VARCHAR) AS lower, count(d.doc_id) AS count FROM (SELECT unnest(range(0, 10000, 2000)) AS lower) g
LEFT JOIN documents d ON d.n_chars >= g.lower AND d.n_chars < g.lower + 2000 GROUP BY g.lower""")
def rq_facet_range(spark, sf_dir):
    p = {"q": "*:*", "rows": 0, "facet": "true", "facet.range": "n_chars", "facet.range.start": 0, "facet.range.end": 10000, "facet.range.gap": 2000}
    counts = select(plain_view(spark, sf_dir), p)["facet_counts"]["facet_ranges"]["n_chars"]["counts"]
    return listed(spark, list(zip(counts[::2], counts[1::2])), "lower string, count long")


@query("rq_json_facet", """WITH x AS (SELECT source, count(*) AS n, max(n_chars) AS best FROM documents WHERE source IS NOT NULL GROUP BY source),
xr AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS rank FROM x),
y AS (SELECT source, lang, count(*) AS n, max(n_chars) AS best FROM documents WHERE lang IS NOT NULL AND source IN (SELECT source FROM xr WHERE rank <= 4) GROUP BY source, lang),
yr AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rank FROM y)
SELECT source, NULL AS lang, n AS count, best FROM xr WHERE rank <= 4 UNION ALL SELECT source, lang, n, best FROM yr WHERE rank <= 2""")
def rq_json_facet(spark, sf_dir):
    spec = {"s": {"type": "terms", "field": "source", "limit": 4, "facet": {"best": "max(n_chars)", "l": {"type": "terms", "field": "lang", "limit": 2, "facet": {"best": "max(n_chars)"}}}}}
    buckets = select(plain_view(spark, sf_dir), {"q": "*:*", "rows": 0, "json.facet": json.dumps(spec)})["facets"]["s"]["buckets"]
    rows = [(b["val"], None, b["count"], b["best"]) for b in buckets] + [(b["val"], x["val"], x["count"], x["best"]) for b in buckets for x in b["l"]["buckets"]]
    return listed(spark, rows, "source string, lang string, count long, best long")


@query("rq_json_max", "SELECT count(*) AS count, max(n_chars) AS best FROM documents WHERE lang = 'fr'")
def rq_json_max(spark, sf_dir):
    found = select(plain_view(spark, sf_dir), {"q": "lang:fr", "rows": 0, "json.facet": '{"best": "max(n_chars)"}'})["facets"]
    return listed(spark, [(found["count"], found["best"])], "count long, best long")


@query("rq_stats", "SELECT CAST(min(n_chars) AS DOUBLE) AS min, CAST(max(n_chars) AS DOUBLE) AS max, count(n_chars) AS count, CAST(sum(n_chars) AS DOUBLE) AS sum FROM documents WHERE lang = 'de'")
def rq_stats(spark, sf_dir):
    s = select(plain_view(spark, sf_dir), {"q": "lang:de", "rows": 0, "stats": "true", "stats.field": "n_chars"})["stats"]["stats_fields"]["n_chars"]
    return listed(spark, [(float(s["min"]), float(s["max"]), s["count"], float(s["sum"]))], "min double, max double, count long, sum double")


@query("rq_groups", """WITH r AS (SELECT lang, doc_id, count(*) OVER (PARTITION BY lang) AS size, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents WHERE n_chars >= 200)
SELECT lang, CAST(doc_id AS VARCHAR) AS doc_id, size, (SELECT count(DISTINCT coalesce(lang, '-')) FROM r) AS ngroups FROM r WHERE place <= 2""")
def rq_groups(spark, sf_dir):
    p = {"q": "n_chars:[200 TO *]", "sort": "n_chars desc", "group": "true", "group.field": "lang", "group.limit": 2, "group.ngroups": "true", "rows": 100, "fl": "doc_id"}
    found = select(plain_view(spark, sf_dir), p)["grouped"]["lang"]
    return listed(spark, [(g["groupValue"], str(d["doc_id"]), g["doclist"]["numFound"], found["ngroups"]) for g in found["groups"] for d in g["doclist"]["docs"]], "lang string, doc_id string, size long, ngroups long")


@query("rq_nested_block", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE list_contains({_TOK}, 'license') AND lang = 'en' ORDER BY n_chars, documents.doc_id LIMIT 20")
def rq_nested_block(spark, sf_dir):
    r = select(view(spark, sf_dir), {"q": "+{!edismax qf=text}license +lang:en", "sort": "n_chars asc", "rows": 20, "fl": "doc_id"})["response"]
    return listed(spark, [(str(d["doc_id"]),) for d in r["docs"]], "doc_id string")


@query("rq_fq_frange", "SELECT count(*) AS found FROM documents WHERE n_chars * 2 >= 1000 AND n_chars * 2 < 3000 AND lang IN ('en', 'fr')")
def rq_fq_frange(spark, sf_dir):
    r = select(plain_view(spark, sf_dir), {"q": "*:*", "fq": ["{!frange l=1000 u=3000 incu=false}product(n_chars,2)", "lang: IN [en fr]"], "rows": 0})["response"]
    return listed(spark, [(r["numFound"],)], "found long")


@query("rq_published", f"""WITH d AS (SELECT * FROM documents WHERE list_contains({_TOK}, 'license') AND lang = 'en')
SELECT source AS value, count(*) AS count, (SELECT count(*) FROM d) AS found FROM d WHERE source IS NOT NULL GROUP BY source""")
def rq_published(spark, sf_dir):
    """Scored words over a field, a filter, a facet, ten documents and their highlights in one request."""
    p = {"q": "license", "defType": "edismax", "qf": "text", "fq": "lang:en", "rows": 10, "fl": "doc_id,score", "facet": "true", "facet.field": "source", "facet.mincount": 1, "facet.limit": -1, "json.nl": "arrarr", "hl": "true", "hl.fl": "text"}
    r = select(view(spark, sf_dir, texts=True), p)
    assert len(r["highlighting"]) == len(r["response"]["docs"])
    return listed(spark, [(v, n, r["response"]["numFound"]) for v, n in r["facet_counts"]["facet_fields"]["source"]], "value string, count long, found long")


@query("rq_terms", f"SELECT t AS term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOK}) AS t FROM documents) WHERE starts_with(t, 'li') GROUP BY t ORDER BY df DESC, t LIMIT 8")
def rq_terms(spark, sf_dir):
    found = handlers.terms(view(spark, sf_dir), {"terms.fl": "text", "terms.prefix": "li", "terms.limit": 8, "json.nl": "arrarr"})["terms"]["text"]
    return listed(spark, [tuple(x) for x in found], "term string, df long")


@query("rq_suggest", f"SELECT p_name FROM part WHERE list_contains({_NAME}, 'red') AND len(list_filter({_NAME}, lambda t: starts_with(t, 'wi'))) > 0 ORDER BY p_partkey LIMIT 10")
def rq_suggest(spark, sf_dir):
    table = indexed(spark, sf_dir, "part", "p_name", "p_type", texts=True)
    core = TableCore(_PARTS, table.withColumn("doc_ord", F.col("p_partkey").cast("long")))
    found = handlers.suggest(core, {"suggest.q": "red wi", "suggest.field": "p_name", "suggest.dictionary": "en", "suggest.highlight": "false"})["suggest"]["en"]["red wi"]
    return listed(spark, [(s["term"],) for s in found["suggestions"]], "p_name string")


@query("rq_more_like_this")
def rq_more_like_this(spark, sf_dir):
    r = handlers.more_like_this(view(spark, sf_dir), {"q": "license", "fq": "lang:en", "mlt.fl": "text", "mlt.mintf": 1, "fl": "doc_id,score", "rows": 10})["response"]
    return listed(spark, [(str(d["doc_id"]), d["score"], r["numFound"]) for d in (r or {"docs": []})["docs"]], "doc_id string, score double, found long")
